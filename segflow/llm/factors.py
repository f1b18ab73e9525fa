"""Substring dedup by relative Lempel-Ziv factors against indexed reference blocks, in words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.common import SPACE, rolling, runs_of, signed, words
from segflow.llm.repeats import NO_ID, Rule, repeat_spans, with_spans

GRAM, WINDOW = 20, 50


def _units(data, at):
    _, _, first, hashes = words(data, at, ~SPACE)
    return hashes, first


def _block(gram: int, window: int):
    """The reference block around each anchor: hashes of the windows that hold it, by words before it (0: none)."""
    before = np.arange(window - gram + 1)

    def surroundings(data, at, hashes, first, doc, place):
        whole = rolling(hashes, window)
        start = place[:, None] - before
        good = (start >= 0) & (start + window <= np.diff(first)[doc][:, None])
        found = np.zeros(start.shape, np.uint64)
        found[good] = whole[(first[doc][:, None] + start)[good]]
        rows = np.arange(len(doc) + 1, dtype=np.int32) * (found.shape[1] * 8)
        return [pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(rows), pa.py_buffer(found.tobytes())])]

    return surroundings


def _factors(width: int):
    """Greedy factor of each anchor against every reference block of its bucket.

    A block matches ``b`` words before the anchor when its window hash there is equal; the longest factor runs from
    the most such words to the last word of the window with the fewest, and each window at its boundary is checked
    by its own hash. Only blocks of documents with smaller ids are references.
    """

    def compare(table: pa.Table):
        doc = table.column("doc_id").to_numpy()
        order = np.argsort(doc, kind="stable")
        raw = b"".join(table.column("block").to_pylist())
        block = np.frombuffer(raw, np.uint64).reshape(len(doc), width)[order]
        doc = doc[order]
        least, most = np.full(len(doc), width), np.full(len(doc), -1)
        for before in range(width):
            column = np.ascontiguousarray(block[:, before])
            at = np.argsort(column, kind="stable")
            value = column[at]
            new = np.concatenate([[True], value[1:] != value[:-1]])
            low = doc[at[np.flatnonzero(new)]][np.cumsum(new) - 1]
            hit = at[(doc[at] > low) & (value != 0)]
            most[hit] = before
            least[hit] = np.minimum(least[hit], before)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return least[back], most[back]

    return compare


def word_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **limits) -> DataFrame:
    """(doc_id, key, start, end): words covered by windows that also start in a document with a smaller id."""
    rule = Rule(_units, gram, window, True)
    return repeat_spans(docs, rule, _block(gram, window), "block binary", _factors(window - gram + 1), **limits)


def _kept(raw: bytes, starts, ends):
    own = raw.split()
    if not len(starts):
        return len(own), 0, own
    starts, ends = runs_of(np.asarray(starts), np.asarray(ends))
    kept, last = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        kept += own[last:a]
        last = b
    kept += own[last:]
    return len(own), len(own) - len(kept), kept


def factor_digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **limits) -> DataFrame:
    """Per document: words, removed words and the hash of the kept words joined by one space.

    Words are runs of bytes other than ASCII white space. A null text has none; a document shorter than the window
    keeps all; copies keep the smallest id; rows that share an id do not remove each other; a null id counts as the
    largest. An empty table gives no rows.
    """

    def finish(raw, starts, ends):
        total, removed, kept = _kept(raw, starts, ends)
        return total, removed, hashlib.sha256(b" ".join(kept)).hexdigest()

    return with_spans(docs, word_spans(docs, window, gram, **limits), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **limits) -> DataFrame:
    """``docs`` with all columns; a text that has repeats is its kept words joined by one space, with its ``n_chars``.

    Every row stays, even if no word does; a text without repeats stays as it is.
    """
    merged = word_spans(docs, window, gram, **limits).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    merged = merged.select(F.col("doc_id").alias("span_doc"), F.col("key").alias("span_key"), "spans")
    row, text = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), F.coalesce(docs["text"], F.lit(""))
    joined = docs.join(merged, (row == merged["span_doc"]) & (F.xxhash64(text) == merged["span_key"]), "left")
    names = docs.columns
    joined = joined.select(*(docs[c] for c in names), merged["spans"].alias("__spans"))
    schema = docs.schema

    def edit(stream):
        for batch in stream:
            lists = batch.column(len(names))
            touched = np.flatnonzero(~np.asarray(lists.is_null()))
            columns = list(batch.columns[: len(names)])
            if len(touched):
                texts, cut = columns[names.index("text")].to_pylist(), np.asarray(lists.offsets)
                starts, ends = (c.to_numpy(zero_copy_only=False) for c in lists.values.flatten())
                sizes = columns[names.index("n_chars")].to_pylist() if "n_chars" in names else None
                for k in touched.tolist():
                    a, b = cut[k], cut[k + 1]
                    texts[k] = b" ".join(_kept(texts[k].encode("utf-8"), starts[a:b], ends[a:b])[2]).decode("utf-8")
                    if sizes:
                        sizes[k] = len(texts[k])
                columns[names.index("text")] = pa.array(texts, batch.schema.field(names.index("text")).type)
                if sizes:
                    columns[names.index("n_chars")] = pa.array(sizes, batch.schema.field(names.index("n_chars")).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(edit, schema)
