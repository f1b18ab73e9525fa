"""Caption text: number and case formatting, overlap, wrapping, display times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segflow.functions.binding import let

# Display time of a caption line, in seconds.
BASE_S, PER_WORD_S, MIN_S, MAX_S = 2.0, 0.2, 2.0, 6.0
# Fixed value: words kept from a finished line to find replayed words.
OVERLAP_WORDS = 5
# Fixed value: marker of a word start in sentence-piece tokens.
WORD_MARK = "▁"

_POINT = "\u0001"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def split_words(text: Column | str) -> Column:
    """Words between runs of white space; an empty array for blank text."""
    clean = F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"(?U)\s+"))


def decimals(text: Column | str, compat: bool = False) -> Column:
    """``3 point 1 4`` becomes ``3.14``.  ``compat`` also drops the space after the number."""
    # a number that follows a point belongs to that match, so it begins no other one
    text = F.regexp_replace(_col(text), r"(?iU)\b(\d+)\s+point\s+(\d+)\b", f"$1{_POINT}$2")
    text = F.regexp_replace(text, rf"(?U)({_POINT}|(?!^)\G)(\d+)\s+(?=\d+\b)", "$1$2")
    if compat:
        text = F.regexp_replace(text, rf"(?U)({_POINT}\d+)\s+(?=\w)", "$1")
    return F.replace(text, F.lit(_POINT), F.lit("."))


def thousands(text: Column | str, compat: bool = False) -> Column:
    """Commas in runs of four or more digits.  ``compat`` also cuts fraction digits."""
    # a run of digits is entered at its start, and goes on where the digits before a comma ended
    start = r"(?<!\d)" if compat else r"(?<![.\d])"
    return F.regexp_replace(_col(text), rf"(?U)(?:{start}|(?!^)\G)(\d{{1,3}}?)(?=(?:\d{{3}})+(?!\d))", "$1,")


def digit_pairs(text: Column | str) -> Column:
    """``12 34`` becomes ``1234`` when no other number is next to the pair."""
    return F.regexp_replace(_col(text), r"(?U)(?<!\d)\b(\d{2})\s+(\d{2})\b(?!\s*\d)", "$1$2")


def cued_years(text: Column | str) -> Column:
    """``in 19 84`` becomes ``in 1984``."""
    return F.regexp_replace(_col(text), r"(?U)\b(in|since|by|year)\s+(\d{2})\s+(\d{2})\b", "$1 $2$3")


def capitals(text: Column | str) -> Column:
    """First character upper case and the pronoun ``I``."""
    text = _col(text)
    text = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))
    return F.regexp_replace(text, r"(?U)\bi\b", "I")


def formatted(text: Column | str, numbers: bool = True, years: bool = False, compat: bool = False) -> Column:
    """A caption line ready for display: numbers first, then capitals."""
    raw = _col(text)
    out = raw
    if numbers:
        out = decimals(out, compat)
        if years:
            out = cued_years(out)
        # a text without digits passes through none of the number patterns
        out = F.when(raw.rlike(r"(?U)\d"), digit_pairs(thousands(out, compat))).otherwise(raw)
    return capitals(out)


def overlap(previous: Column | str, new: Column | str, limit: int = OVERLAP_WORDS) -> Column:
    """Largest k for which the last k words before equal the first k words after, ignoring case."""
    lower = lambda words: F.transform(F.coalesce(_col(words), F.array().cast("array<string>")), lambda w: F.lower(w))

    def longest(both: Column) -> Column:
        before, after = both["before"], both["after"]
        most = F.least(F.size(before), F.size(after), F.lit(limit))
        fits = lambda k: (k <= most) & (
            F.slice(before, F.greatest(F.size(before) - k, F.lit(0)) + 1, k) == F.slice(after, F.lit(1), k)
        )
        return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.lit(limit)), fits)), F.lit(0))

    return let(F.struct(lower(previous).alias("before"), lower(new).alias("after")), longest)


def last_words(words: Column | str, n: int = OVERLAP_WORDS) -> Column:
    words = _col(words)
    return F.slice(words, F.greatest(F.size(words) - n, F.lit(0)) + 1, F.lit(n))


def without_overlap(previous: Column | str, new: Column | str) -> Column:
    """New words with the replayed ones removed."""
    new = _col(new)
    return F.slice(new, overlap(previous, new) + 1, F.greatest(F.size(new), F.lit(1)))


def caption_lines(text: Column | str, width: int) -> Column:
    """Greedy wrap to ``width`` characters; a longer word is cut by characters.

    One pass of a pattern from line start to line start: ``width`` characters of a
    word that goes on, else as many whole words as fit.
    """
    if width < 1:
        raise ValueError("width must be positive")
    flat = F.array_join(split_words(text), " ")
    pattern = rf"(\S{{{width}}}(?=\S)|.{{1,{width}}}(?= |$)) ?"
    return F.regexp_extract_all(flat, F.lit(pattern), F.lit(1))


def caption_chunks(text: Column | str, width: int, max_lines: int = 2) -> Column:
    """Chunks of at most ``max_lines`` wrapped lines, joined by line breaks."""
    if max_lines < 1:
        raise ValueError("max_lines must be positive")

    def cut(lines: Column) -> Column:
        count = F.ceil(F.size(lines) / F.lit(max_lines)).cast("int")
        chunk = lambda i: F.array_join(F.slice(lines, i * max_lines + 1, F.lit(max_lines)), "\n")
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), chunk)
        return F.when(count > 0, chunks).otherwise(F.array().cast("array<string>"))

    return let(caption_lines(text, width), cut)


def display_seconds(text: Column | str) -> Column:
    """How long a line stays: 2 s and 0.2 s per word, between 2 and 6 s."""
    words = F.greatest(F.size(split_words(text)), F.lit(1))
    return F.greatest(F.lit(MIN_S), F.least(F.lit(MAX_S), F.lit(BASE_S) + F.lit(PER_WORD_S) * words))


def token_words(tokens: Column | str, times: Column | str, logps: Column | str, text: Column | str | None = None) -> Column:
    """Words with start, end and confidence from token arrays.

    A word starts at a marked token or at the first one and ends where the next word
    starts; the last ends at the last token's time.  NULL when the arrays do not fit
    together or the word count is far from that of ``text``.
    """
    tokens, times, logps = _col(tokens), _col(times), _col(logps)
    n = F.size(tokens)
    starts = F.filter(
        F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | F.get(tokens, i).startswith(WORD_MARK)
    )
    usable = logps.isNotNull() & (F.size(logps) == n)

    def word(starts: Column, start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(starts, k + 1), n)
        pieces = F.array_join(F.slice(tokens, start + 1, stop - start), "")
        chances = F.slice(logps, start + 1, stop - start)
        mean = F.aggregate(chances, F.lit(0.0), lambda a, v: a + v) / (stop - start)
        return F.struct(
            F.trim(F.replace(pieces, F.lit(WORD_MARK), F.lit(""))).alias("text"),
            F.get(times, start).alias("start"),
            F.get(times, F.least(stop, n - 1)).alias("end"),
            F.when(usable, F.exp(mean)).alias("confidence"),
        )

    pick = lambda at: F.transform(at, lambda start, k: word(at, start, k))
    words = F.filter(let(starts, pick), lambda w: w["text"] != "")
    fits = (n > 0) & (F.size(times) == n)
    if text is not None:
        expected = F.size(split_words(text))
        slack = F.greatest(F.lit(2), F.floor(expected / 4).cast("int"))
        fits = fits & ((expected == 0) | (F.abs(F.size(words) - expected) <= slack))
    return F.when(fits, words)


def unseen_text(text: Column | str, shown_prefix: Column | str) -> Column:
    """Text after the part already shown; the whole text when it was revised."""
    text, prefix = _col(text), F.coalesce(_col(shown_prefix), F.lit(""))
    rest = F.ltrim(F.substring(text, F.length(prefix) + 1, F.length(text)))
    return F.when(text.startswith(prefix), rest).otherwise(F.ltrim(text))
