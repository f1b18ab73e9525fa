"""Main text of web pages: subtrees that recur across a host's pages are deleted, then what is no article text."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.common import prepare, stored
from segflow.session import small_enough

#: A subtree belongs to the site when it stands on this share of a host's pages, and on this many.
SHARE, PAGES = 0.3, 8

# Element names and class words of pages.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg math object title select".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
CHROME = set("head nav footer aside form menu dialog button header".split())
MAIN = {"article", "main"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
NO_P = set("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
COMMENTS = set("comment comments commentlist disqus respond replies".split())
WORDS = COMMENTS | set(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal overlay newsletter "
    "subscribe signup sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer share sharing social related recommended pagination "
    "pager toolbar login search masthead".split()
)
#: A class name with one of these says what a frame has or lacks, not what it is.
QUALIFIERS = set("has with without no free".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")


def _marked(tag: str, raw: str, inside: bool) -> int:
    """2 for reader comments and hidden elements, 1 for other parts of the page that are no article text."""
    kind = 1 if tag in CHROME and not (inside and tag == "header") else 0
    if not raw or raw.isspace():
        return kind
    for name, value in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and tag not in ("html", "body"):
            found = set()
            for one in value.split():
                parts = set(_SPLIT.split(one))
                if not parts & QUALIFIERS:
                    found |= parts & WORDS
            if found & COMMENTS:
                return 2
            kind = max(kind, 1 if found and tag not in MAIN else 0)
        elif name == "role" and value in ROLES:
            kind = 1
        elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")):
            return 2
    return kind


class Page:
    """Blocks of text of a page with the elements around them, and a hash of each element's subtree."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, tuple[int, ...]]] = []  # text, in the main part, elements around it
        self.hashes: list[int] = []
        self.site: list[bool] = []  # may be judged by recurrence
        self._text: list[str] = []
        # open elements: tag, number (-1: inline), parts of its hash, no article text, in the main part, holds the main part
        self._open: list[list] = [["", -1, [], 0, False, False]]
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while True:
            found = _TAG.search(source, at)
            if found is None:
                self._text.append(source[at:])
                break
            if found.start() > at:
                self._text.append(source[at : found.start()])
            at = found.end()
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[1]:
                self._end(tag)
            elif tag in RAW:
                if not found[3].endswith("/") or tag not in ("svg", "math"):
                    close = re.compile(rf"</{tag}[\s>/]", re.I).search(source, at)
                    at = source.find(">", close.start()) + 1 if close else len(source)
                    at = at or len(source)
            else:
                self._start(tag, found[3])
        self._flush()
        while len(self._open) > 1:
            self._pop()

    def _flush(self) -> None:
        if not self._text:
            return
        text = "".join(self._text)
        self._text = []
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        if text:
            top = self._open[-1]
            top[2].append(text)
            if not top[3]:
                self.blocks.append((text, top[4], tuple(e[1] for e in self._open if e[1] >= 0)))

    def _start(self, tag: str, raw: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        if tag in BLOCK:
            self._flush()
            if tag in NO_P:
                self._close({"p"}, {"td", "th", "table", "div", "section", "article"})
            if tag in CLOSES:
                self._close(CLOSES[tag], SCOPES.get(tag, {"table"}))
        if tag in VOID:
            return
        top = self._open[-1]
        if tag not in BLOCK:
            if tag in ("button", "label"):
                self._flush()
                self._open.append([tag, -1, [], top[3] or 1, top[4], False])
            else:
                mark = _marked(tag, raw, top[4])
                if mark:
                    self._flush()
                self._open.append([tag, -1, top[2], max(top[3], mark), top[4], False])
            return
        mark = _marked(tag, raw, top[4])
        main = tag in MAIN and mark < 2 and top[3] < 2
        if main and not top[4]:
            mark, outer = 0, 0  # the main part is kept within any frame
            for e in self._open:
                e[5] = True
        else:
            outer = top[3]
        number = len(self.hashes)
        self.hashes.append(0)
        inside = top[4] or main
        self.site.append(not (main or (inside and tag in TEXTUAL)))
        self._open.append([tag, number, [tag], max(outer, mark), inside, False])

    def _close(self, tags: set, stop: set) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] in tags:
                while len(self._open) > k:
                    self._pop()
                return
            if self._open[k][0] in stop:
                return

    def _end(self, tag: str) -> None:
        if tag in BLOCK or any(e[0] == tag and (e[1] >= 0 or e[3]) for e in self._open[-1:]):
            self._flush()
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] == tag:
                while len(self._open) > k:
                    self._pop()
                return
            if tag not in BLOCK and self._open[k][1] >= 0:
                return  # an inline end does not close a block

    def _pop(self) -> None:
        top = self._open[-1]
        if top[1] >= 0 or top[2] is not self._open[-2][2]:
            self._flush()
        self._open.pop()
        if top[1] >= 0:
            value = xxhash.xxh64_intdigest("\x00".join(top[2]))
            self.hashes[top[1]] = value
            self.site[top[1]] = self.site[top[1]] and not top[5] and len(top[2]) > 1
            self._open[-1][2].append(str(value))

    def subtrees(self) -> set[int]:
        """Hashes of the subtrees with text that may be part of the site."""
        return {h for h, s in zip(self.hashes, self.site) if s}

    def text(self, recurring: set[int]) -> str:
        gone = {k for k, (h, s) in enumerate(zip(self.hashes, self.site)) if s and h in recurring} if recurring else ()
        kept = [(t, m) for t, m, around in self.blocks if not gone or not any(k in gone for k in around)]
        main = [t for t, m in kept if m]
        return "\n\n".join(main or [t for t, _ in kept])


def hosts(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host): null html is empty, a page without a host has the empty one."""
    prepare(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def site_subtrees(rows: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """(host, subtrees): hashes that stand on ``share`` of the host's pages and on ``least`` of them.

    Counts combine before the shuffle, so a host with a third of all pages is no group in one task.
    """

    def count(stream):
        for batch in stream:
            host, value = [], []
            for h, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                own = Page(source).subtrees()
                host += [h] * len(own)
                value += own
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(np.array(value, np.uint64).view(np.int64))], names=["host", "subtree"])

    size = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)
    seen = rows.select("host", "html").mapInArrow(count, "host string, subtree long").groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    seen = seen.join(size, "host").where(F.col("n") >= F.col("pages") * share)
    return seen.groupBy("host").agg(F.collect_list("subtree").alias("subtrees"))  # at most (subtrees of a page) / share each


def main_text(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """(page_id, url, text, n_chars): one row per page.

    Text inside ``article`` or ``main`` is the main part where there is any, else what is left of the body. Paragraphs of
    the main part are never judged by recurrence: an article that is copied is still an article. Equal rows give equal
    rows; an empty or null page gives an empty text; an empty table no rows.
    """
    rows = hosts(pages)
    site = stored(site_subtrees(rows, share, least), "subtrees")
    # the table of a cluster's hosts may be large: broadcast only when measured small, else an ordinary join
    rows = rows.join(F.broadcast(site) if small_enough(site) else site, "host", "left")

    def extract(stream):
        known: dict[str, set[int]] = {}
        for batch in stream:
            out = []
            for host, source, some in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("subtrees")):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    found = some.as_py() or []
                    known[host] = {v & 0xFFFFFFFFFFFFFFFF for v in found}
                out.append(Page(source).text(known[host]))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "host", "html", "subtrees").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
