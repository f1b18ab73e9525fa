"""Batch forms of the live rules: backlog, speech segments, gating, resets, endpointing, display."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segflow.operators.frames import CELL, in_cells
from segflow.operators.ordered import Kernel, Ordered, lag, lead, null_safe_join, ordered, total
from segflow.operators.spacing import gap_islands

# Endpointing limits in seconds, pre-roll chunks, reset gap, clocks of line splits.
RULE1_S, RULE2_S, RULE3_S = 2.4, 1.2, 20.0
PRE_ROLL_CHUNKS, RESET_GAP_S = 4, 1.5
DECODE_LAG_S, SETTLE_S = 0.8, 0.1


def backlog(chunks: DataFrame, keys: Sequence[str], tick: Column, samples: str, capacity: int) -> DataFrame:
    """Samples written and dropped per drain tick; a drain empties the buffer."""
    sums = chunks.groupBy(*keys, tick.alias("tick")).agg(F.sum(samples).alias("written"), F.count(F.lit(1)).alias("chunks"))
    return sums.withColumn("dropped", F.greatest(F.col("written") - capacity, F.lit(0)))


def speech_segments(
    rows: Ordered,
    at: str,
    score: str,
    threshold: float,
    frame: float,
    min_silence: float,
    min_speech: float,
    max_speech: float,
) -> DataFrame:
    """Speech intervals from frame scores: join over short silences, drop short ones, cut long ones."""
    keys = list(rows.keys)
    speech = gap_islands(rows.where(F.col(score) >= threshold), at, min_silence + frame, "segment")
    spans = speech.rows().groupBy(*keys, "segment").agg(
        F.min(at).alias("start"), (F.max(at) + frame).alias("end"), F.count(F.lit(1)).alias("frames")
    )
    length = F.col("end") - F.col("start")
    spans = spans.where(length >= min_speech)
    pieces = F.greatest(F.ceil(length / F.lit(max_speech)), F.lit(1)).cast("int")
    cut = spans.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    begin = F.col("start") + F.col("piece") * F.lit(max_speech)
    return cut.select(*keys, "segment", "piece", begin.alias("start"), F.least(begin + max_speech, F.col("end")).alias("end"))


def admitted(chunks: DataFrame, keys: Sequence[str], index: str, active: str, pre_roll: int = PRE_ROLL_CHUNKS, cell: int = CELL) -> DataFrame:
    """Chunks that reach the detector: active ones and up to ``pre_roll`` before an activation.

    ``index`` counts the chunks of a stream; a chunk looks only ``pre_roll`` rows ahead.
    """
    cells = in_cells(chunks, keys, index, pre_roll, cell)
    ahead = Window.partitionBy(*keys, "cell").orderBy(index).rowsBetween(1, pre_roll)
    soon = F.coalesce(F.max(F.col(active).cast("int")).over(ahead), F.lit(0)) == 1
    out = cells.withColumn("admitted", F.col(active) | soon)
    return out.where("home").drop("cell", "home")


def audio_clock(rows: Ordered, seconds: str, gap_s: float = RESET_GAP_S) -> Ordered:
    """Clock over admitted chunks, and sessions cut where skipped audio reaches ``gap_s``.

    ``audio_clock_s`` never restarts; ``session`` counts the resets.
    """
    taken = F.when(F.col("admitted"), F.col(seconds)).otherwise(F.lit(0))
    skipped = F.when(F.col("admitted"), F.lit(0)).otherwise(F.col(seconds))
    rows = rows.scan(audio_clock=total(taken), __skipped=total(skipped)).where(F.col("admitted"))
    rows = rows.scan(__before=lag("__skipped"))
    gap = F.col("__skipped") - F.coalesce(F.col("__before"), F.lit(0))
    rows = rows.columns(__reset=(gap >= gap_s).cast("long")).scan(session=total("__reset"))
    return rows.with_df(rows.df.drop("__skipped", "__before", "__reset"))


class Endpoints(Kernel):
    """Marks the first update of each line.

    A line ends after ``rule1`` of silence, after ``rule2`` once it has text, or when it has
    lasted ``rule3``.  The state is (line start, last update, has text).
    """

    outputs = {"new_line": "boolean"}

    def __init__(self, at: str, text: str, rule1: float, rule2: float, rule3: float):
        self.at, self.text = at, text
        self.rules = (rule1, rule2, rule3)
        self.inputs = (at, text)

    def start(self):
        return None

    def opens(self, t, state) -> bool:
        if state is None:
            return True
        begun, latest, spoken = state
        silence = t - latest
        rule1, rule2, rule3 = self.rules
        return silence >= rule1 or (spoken and silence >= rule2) or t - begun >= rule3

    def run(self, columns, first, enter, state):
        marks = []
        for i, (t, spoken, new) in enumerate(zip(columns[self.at], columns[self.text], first)):
            if new:
                state = enter.get(i) if enter else None
            fresh = self.opens(t, state)
            state = (t, t, bool(spoken)) if fresh else (state[0], t, state[2] or bool(spoken))
            marks.append(fresh)
        return {"new_line": marks}, state

    def summary(self, columns):
        ts, spoken = columns[self.at], columns[self.text]
        memo: dict[int, tuple] = {}
        n, (rule1, rule2, rule3) = len(ts), self.rules
        # next row, from a row on, after a silence of each rule; and next spoken row
        long_, short, talk = [n] * (n + 1), [n] * (n + 1), [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            silence = ts[i] - ts[i - 1] if i else 0
            long_[i] = i if silence >= rule1 else long_[i + 1]
            short[i] = i if silence >= rule2 else short[i + 1]
            talk[i] = i if spoken[i] else talk[i + 1]

        def after(i: int) -> int:
            aged = bisect.bisect_left(ts, True, lo=i + 1, key=lambda t: t - ts[i] >= rule3)
            said = talk[i]
            return min(aged, long_[i + 1], short[said + 1] if said < n else n)

        def leave(i: int) -> tuple:
            path, at = [], i
            while at not in memo:
                path.append(at)
                nxt = after(at)
                if nxt == n:
                    memo[at] = (ts[at], ts[-1], talk[at] < n)
                    break
                at = nxt
            for p in path:
                memo[p] = memo[at]
            return memo[i]

        # an open line began before this block, so it ends within rule3 of the first row
        entries = []
        for i, t in enumerate(ts):
            entries.append((t, bool(spoken[i]), leave(i)))
            if t - ts[0] >= self.rules[2]:
                break
        return entries

    def follow(self, state, summary):
        for t, spoken, leave in summary:
            if self.opens(t, state):
                return leave
            state = (state[0], t, state[2] or spoken)
        return state


def endpointed(
    rows: Ordered, at: str, text: str, rule1: float = RULE1_S, rule2: float = RULE2_S, rule3: float = RULE3_S
) -> Ordered:
    """Number the lines of each stream (``line``, from 1)."""
    return rows.fold(Endpoints(at, text, rule1, rule2, rule3)).columns(__new=F.col("new_line").cast("long")).scan(line=total("__new"))


def line_spans(rows: Ordered, at: str) -> DataFrame:
    return rows.rows().groupBy(*rows.keys, "line").agg(
        F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("updates")
    )


def gap_sessions(updates: DataFrame, keys: Sequence[str], event_time: str, at: str, spoken: str, rule1_us: int = int(RULE1_S * 1e6), rule2_us: int = int(RULE2_S * 1e6)) -> DataFrame:
    """Lines that end by silence alone (keys, start, end, updates), of a table or of a stream with a watermark.

    A session window whose gap is a column: an update keeps its line open for rule 2 once it holds speech, for rule 1
    before. The length rule has no session form; ``endpointed`` and the keyed stream have all three rules.
    """
    gap = F.when(F.col(spoken), F.lit(f"{rule2_us} microseconds")).otherwise(F.lit(f"{rule1_us} microseconds"))
    grouped = updates.groupBy(*keys, F.session_window(event_time, gap).alias("__session"))
    return grouped.agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("updates")).drop("__session")


def count_changes(rows: Ordered, count: str) -> Ordered:
    """Updates at which the word count differs from the previous one (0 before the first)."""
    rows = rows.scan(__before=lag(count)).where(F.col(count) != F.coalesce(F.col("__before"), F.lit(0)))
    return rows.with_df(rows.df.drop("__before"))


def display_intervals(rows: Ordered, start: Column, seconds: Column) -> Ordered:
    """When each committed line leaves the screen.

    A newer line pulls older ones down to its own end, and at most two are visible, so a
    line also ends when the second next one appears.
    """
    rows = rows.columns(shown_at=start, __own=start + seconds)
    rows = rows.scan(__next_end=lead("__own"), __next=lead("shown_at"))
    rows = rows.scan(__after=lead("__next"))
    ends = F.least(F.col("__own"), F.col("__next_end"), F.col("__after"))
    rows = rows.columns(hidden_at=ends)
    return rows.with_df(rows.df.drop("__own", "__next_end", "__next", "__after"))


def chunk_windows(chunks: DataFrame, keys: Sequence[str], order: Sequence[str], samples: str, size: int = 512) -> DataFrame:
    """Exact ``size``-sample windows over chunks of any length, as pieces with their source range.

    One row per (window, chunk) part; the unfinished last window of a stream is left out.
    """
    rows = ordered(chunks, keys, order).scan(__upto=total(samples))
    upto, n = F.col("__upto"), F.col(samples)
    rows = rows.columns(__from=upto - n)
    whole = rows.df.groupBy(*keys).agg(F.sum(samples).alias("__all"))
    low, high = F.floor(F.col("__from") / F.lit(size)), F.floor((upto - 1) / F.lit(size))
    parts = rows.rows().where(n > 0).withColumn("window_no", F.explode(F.sequence(low, high)))
    start = F.col("window_no") * size
    parts = parts.withColumns(
        {
            "from_sample": F.greatest(start, F.col("__from")) - F.col("__from"),
            "to_sample": F.least(start + size, upto) - F.col("__from"),
        }
    )
    joined = parts.join(whole, list(keys)).where((F.col("window_no") + 1) * size <= F.col("__all"))
    return joined.drop("__upto", "__from", "__all")


def audio_windows(
    chunks: DataFrame, keys: Sequence[str], order: Sequence[str], samples: str, window: int, hop: int, out: str = "wave"
) -> DataFrame:
    """Full sample windows over chunk arrays: ``window_no``, ``start`` and the samples.

    Only lengths are put in order; a window's parts are numbers of samples until they are known, and then each chunk is
    read once more by its place (keys and order) and cut into one slice per window it touches.
    """
    sized = chunks.withColumn("__n", F.size(samples)).where(F.col("__n") > 0)
    rows = ordered(sized.select(*keys, *order, "__n"), keys, order).scan(__upto=total("__n")).rows()
    first = F.col("__upto") - F.col("__n")
    low = F.greatest(F.ceil((first - window + 1) / F.lit(hop)), F.lit(0))
    parts = rows.withColumn("window_no", F.explode(F.sequence(low, F.floor((F.col("__upto") - 1) / F.lit(hop)))))
    begin = F.col("window_no") * hop
    parts = parts.withColumns(
        {"__from": F.greatest(begin - first, F.lit(0)), "__to": F.least(begin + window - first, F.col("__n"))}
    ).where(F.col("__to") > F.col("__from"))
    parts = null_safe_join(parts, sized.select(*keys, *order, samples), [*keys, *order])
    piece = F.slice(samples, (F.col("__from") + 1).cast("int"), (F.col("__to") - F.col("__from")).cast("int"))
    pieces = parts.select(*keys, "window_no", first.alias("__first"), piece.alias("__x"))
    packed = pieces.groupBy(*keys, "window_no").agg(F.array_sort(F.collect_list(F.struct("__first", "__x"))).alias("__ps"))
    joined = packed.select(*keys, "window_no", (F.col("window_no") * hop).alias("start"), F.flatten(F.col("__ps.__x")).alias(out))
    return joined.where(F.size(out) == window)
