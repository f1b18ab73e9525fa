"""Splitting caption lines at speaker changes, as data.

An utterance runs to its final text.  Each change is resolved by the first update at or after the time at which its
words must have been decoded, or else by the end of the utterance.  It cuts before the word that was the last known
when the change was decoded: an as-of lookup in the word counts of the partial texts.  The cut positions of an
utterance are a running maximum over its changes, and lines are the words between them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from segflow.functions import text as text_functions
from segflow.operators.lines import DECODE_LAG_S, SETTLE_S
from segflow.operators.ordered import lag, last, ordered, total

CHANGE, UPDATE = 0, 1

_FIELDS = ("emitted_s", "seq", "known", "low", "high", "start_s", "duration_s", "confidence", "cause", "change_s")
_LINE = "struct<emitted_s:double,seq:bigint,known:int,low:int,high:int,start_s:double,duration_s:double,confidence:double,cause:string,change_s:double>"


def merged(updates: DataFrame, changes: DataFrame, key: str, **more: Column) -> DataFrame:
    """Updates and changes as rows of one shape; ``more`` are columns of updates, null for changes."""
    a = updates.select(key, F.lit(UPDATE).alias("kind"), "clock_s", F.col("seq").cast("long").alias("seq"), F.lit(None).cast("double").alias("change_s"), "confidence", *(c.alias(n) for n, c in more.items()))
    b = changes.select(key, F.lit(CHANGE).alias("kind"), F.col("detected_at_s").alias("clock_s"), F.lit(0).cast("long").alias("seq"), F.col("time_s").alias("change_s"))
    return a.unionByName(b, allowMissingColumns=True)


def utterances(
    updates: DataFrame, changes: DataFrame, key: str = "stream_id", decode_lag: float = DECODE_LAG_S, settle: float = SETTLE_S, flush: bool = True
) -> DataFrame:
    """One row per utterance: its ``lines`` as word ranges, late changes, replayed words and whether it ended.

    ``updates``: key, seq, clock_s, partial, final, confidence; ``changes``: key, time_s, detected_at_s.  Texts do not
    travel here: a row carries its number of words and the first few, enough to find words replayed from the
    utterance before.  With ``flush`` an utterance that is still open when the stream ends is closed as well.
    """
    words = text_functions.split_words(F.coalesce("final", "partial", F.lit("")))
    head = F.slice(words, 1, text_functions.OVERLAP_WORDS)
    rows = merged(updates, changes, key, ended=F.col("final").isNotNull(), size=F.size(words), head=head, tail=F.when(F.col("final").isNotNull(), text_functions.last_words(words)))
    closing = F.when(F.col("ended"), F.struct("tail", F.col("clock_s").alias("at")))
    rows = ordered(rows, [key], ["clock_s", "kind", "seq", "change_s"]).columns(__end=F.coalesce("ended", F.lit(False)).cast("long"), __closing=closing)
    rows = rows.scan(__ends=total("__end"), __closed=last("__closing")).scan(__before=lag("__ends"), __last=lag("__closed")).rows()
    again = text_functions.overlap(F.col("__last.tail"), F.col("head"))
    update = F.when(F.col("kind") == UPDATE, F.struct("clock_s", "seq", (F.col("size") - again).cast("int").alias("known"), "ended", "confidence", again.alias("again")))
    change = F.when(F.col("kind") == CHANGE, F.struct(F.col("change_s").alias("at"), F.col("clock_s").alias("seen")))
    # an utterance is bounded by the endpointing rule; only clocks and counts of it meet here
    grouped = rows.groupBy(key, F.coalesce("__before", F.lit(0)).alias("utterance")).agg(
        F.array_sort(F.collect_list(update)).alias("ups"), F.collect_list(change).alias("marks"), F.coalesce(F.max("__last.at"), F.lit(0.0)).alias("begun_s")
    )
    kind = grouped.schema[key].dataType.simpleString()
    shape = f"{key} {kind}, utterance bigint, begun_s double, lines array<{_LINE}>, late bigint, replayed int, ended boolean"
    grouped = grouped.where(F.size("ups") > 0).select(key, "utterance", "begun_s", "ups", "marks")
    kind = to_arrow_type(StructType.fromDDL(f"v array<{_LINE}>")["v"].dataType)
    return grouped.mapInArrow(lambda batches: _folded(batches, decode_lag, settle, flush, kind), shape)


def _folded(batches: Iterable[pa.RecordBatch], decode_lag: float, settle: float, flush: bool, lines_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Lines of each utterance from its sorted updates and its changes."""
    for batch in batches:
        ups, marks = batch.column("ups"), batch.column("marks")
        parts = [np.asarray(c.offsets) for c in (ups, marks)]
        names = ("clock_s", "seq", "known", "ended", "again")
        clock, seq, known, ended, again = (ups.values.field(n).to_numpy(zero_copy_only=False) for n in names)
        confidence = ups.values.field("confidence").to_pylist()
        at, seen = (marks.values.field(n).to_numpy(zero_copy_only=False) for n in ("at", "seen"))
        lines, late, closing = [], [], []
        for (low, high), (first, last), begun in zip(zip(parts[0], parts[0][1:]), zip(parts[1], parts[1][1:]), batch.column("begun_s").to_pylist()):
            done = bool(ended[high - 1])
            found, missed = word_ranges(clock[low:high], known[low:high], done, at[first:last], seen[first:last], begun, decode_lag, settle, done or flush)
            own = []
            for place, begin, end, start, change in found:
                k = low + place
                stop, cause = (clock[k], "final" if done else "flush") if change is None else (change, "change")
                own.append((clock[k], seq[k], known[k], begin, end, start, max(stop - start, 0.0), confidence[k], cause, change))
            lines.append([dict(zip(_FIELDS, line)) for line in own])
            late.append(missed)
            closing.append(high - 1)
        columns = [*(batch.column(k) for k in range(3)), pa.array(lines, lines_type), pa.array(late, pa.int64()), pa.array(again[closing], pa.int32()), pa.array(ended[closing].astype(bool))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:3], "lines", "late", "replayed", "ended"])


def replayed(memory: list[str], words: list[str]) -> int:
    """Number of first words that repeat the end of ``memory``, ignoring case."""
    a, b = ([w.lower() for w in side] for side in (memory, words))
    return max((k for k in range(1, min(len(a), len(b)) + 1) if a[-k:] == b[:k]), default=0)


def word_ranges(clocks: np.ndarray, known: np.ndarray, ended: bool, at: np.ndarray, seen: np.ndarray, begun: float, decode_lag: float, settle: float, closed: bool):
    """The rule of :func:`utterances` for the arrays of one utterance: ([(place, low, high, start, change)], late).

    ``clocks`` and ``known`` are those of its updates, ``at`` and ``seen`` of its changes. With ``ended`` the last
    update is its final text; with ``closed`` the last update resolves what waits. Both lookups are binary searches.
    """
    n = len(clocks)
    place = np.searchsorted(clocks, np.maximum(seen, at + (decode_lag + settle)))
    heard = np.searchsorted(clocks[: n - ended], at + decode_lag, "right")
    if closed:
        place = np.minimum(place, n - 1)
    ready = np.flatnonzero(place < n)
    ready = ready[np.lexsort((at[ready], place[ready]))]
    cut = np.minimum(np.concatenate([[0], known])[heard[ready]], known[place[ready]])
    low, start, late, lines = 0, begun, 0, []
    for p, high, t in zip(place[ready].tolist(), cut.tolist(), at[ready].tolist()):
        if t <= start:
            late += 1
        elif high > low:
            lines.append((p, low, high, start, t))
            low, start = high, t
    if closed and known[-1] > low:
        lines.append((n - 1, low, int(known[-1]), start, None))
    return lines, late


def caption_lines(rows: DataFrame, updates: DataFrame, key: str = "stream_id", display: bool = True) -> DataFrame:
    """The lines of :func:`utterances` with their text, one row each, cut from the update that resolved them.

    The texts of all updates, each with the words of those before it, are many times the stored table that the size of
    a plan is judged by. So they are sorted and merged with the lines, and never broadcast.
    """
    spans = rows.select(key, "utterance", F.posexplode("lines").alias("part", "l")).select(key, "utterance", "part", "l.*")
    texts = updates.select(key, F.col("clock_s").alias("emitted_s"), F.col("seq").cast("long").alias("seq"), F.coalesce("final", "partial", F.lit("")).alias("text"))
    out = spans.hint("merge").join(texts, [key, "emitted_s", "seq"]).withColumn("w", text_functions.split_words("text"))
    body = F.array_join(F.slice("w", F.size("w") - F.col("known") + F.col("low") + 1, F.greatest(F.col("high") - F.col("low"), F.lit(1))), " ")
    out = out.withColumn("text", body)
    if display:
        out = out.withColumn("text", text_functions.formatted("text"))
    return out.select(key, "emitted_s", "part", "text", "start_s", "duration_s", "confidence", "cause", "change_s")


def session_counts(rows: DataFrame, key: str = "stream_id") -> DataFrame:
    """Splits applied, late changes and lines per stream."""
    cuts = F.size(F.filter("lines", lambda l: l["cause"] == "change"))
    return rows.groupBy(key).agg(F.sum(cuts).alias("splits"), F.sum("late").alias("late_changes"), F.sum(F.size("lines")).alias("lines"))
