"""Frame-score operators in row form: one row per (stream, frame index)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from segflow.functions import signals
from segflow.operators.joins import asof
from segflow.operators.ordered import Ordered, head, lag, null_safe_join, ordered, total
from segflow.operators.spacing import mark_spaced
from segflow.session import stable

#: Frames per cell; a cell and its neighbours' edges are what one window task sorts.
CELL = 1 << 16
WINDOW_S, HOP_S, RATE = 3.0, 0.25, 16000


def in_cells(df: DataFrame, keys: Sequence[str], index: str, reach: int, cell: int = CELL) -> DataFrame:
    """Copy the rows within ``reach`` of a cell edge into the neighbour cell.

    Frame indexes are unique per stream, so a cell holds at most ``cell + 2 reach``
    rows however long the stream is.  Copies carry ``home = false``.
    """
    if cell < 2 * reach:
        raise ValueError("a cell must be at least twice the reach")
    own = F.floor(F.col(index) / F.lit(cell))
    near = F.array_distinct(
        F.array(F.floor((F.col(index) - reach) / F.lit(cell)), own, F.floor((F.col(index) + reach) / F.lit(cell)))
    )
    return df.withColumn("cell", F.explode(near)).withColumn("home", F.col("cell") == own)


def local_peaks(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    score: str,
    threshold: float,
    radius: int,
    cell: int = CELL,
) -> DataFrame:
    """Rows that reach the threshold and the maximum of the ±radius rows around them."""
    cells = in_cells(df, keys, index, radius, cell)
    around = Window.partitionBy(*keys, "cell").orderBy(index).rowsBetween(-radius, radius)
    marked = cells.withColumn("__top", F.max(score).over(around))
    hit = F.col("home") & (F.col(score) >= threshold) & (F.col(score) >= F.col("__top"))
    return marked.where(hit).drop("cell", "home", "__top")


def smooth_rows(
    df: DataFrame, keys: Sequence[str], index: str, score: str, k: int = 5, name: str = "smooth", cell: int = CELL
) -> DataFrame:
    """Centred mean over ``k`` consecutive frames; stream ends are repeated outwards."""
    half = k // 2
    cells = in_cells(df, keys, index, half, cell)
    place = Window.partitionBy(*keys, "cell").orderBy(index)
    # outside the stream lag/lead give NULL; the nearest frame inside stands in
    values = [F.col(score)]
    before, after = [], []
    for step in range(1, half + 1):
        before.append(F.coalesce(F.lag(score, step).over(place), (before or values)[-1]))
        after.append(F.coalesce(F.lead(score, step).over(place), (after or values)[-1]))
    ordered_values = [*reversed(before), *values, *after]
    mean = ordered_values[0]
    for v in ordered_values[1:]:
        mean = mean + v
    return cells.withColumn(name, mean / F.lit(float(k))).where("home").drop("cell", "home")


def frame_runs(rows: Ordered, score: str, threshold: float) -> DataFrame:
    """Maximal runs of consecutive rows with ``score > threshold``: first peak, start, end, size.

    ``rows`` are ordered by a single column (the frame position).
    """
    at = rows.order[0]
    rows = rows.columns(__on=(F.col(score) > threshold).cast("long"))
    rows = rows.scan(__was=lag("__on"))
    rows = rows.columns(__new=F.when((F.col("__on") == 1) & (F.coalesce(F.col("__was"), F.lit(0)) == 0), 1).otherwise(0))
    rows = rows.scan(run=total("__new")).where(F.col("__on") == 1)
    place = F.struct(F.col(score), (-F.col(at)).alias("t"))
    return (
        rows.rows()
        .groupBy(*rows.keys, "run")
        .agg(
            F.max_by(F.col(at), place).alias("peak_at"),
            F.max(score).alias("peak"),
            F.min(at).alias("start"),
            F.max(at).alias("end"),
            F.count(F.lit(1)).alias("frames"),
        )
    )


def frame_events(rows: Ordered, score: str, threshold: float = 0.5, merge: float = 0.3) -> DataFrame:
    """Runs above the threshold as events at their first peak, merged by minimum gap."""
    runs = frame_runs(rows, score, threshold)
    events = ordered(runs, rows.keys, ["peak_at"])
    return mark_spaced(events, "peak_at", merge, "offline").where(F.col("kept")).rows().drop("kept")


def sliding_windows(
    lengths: DataFrame, keys: Sequence[str], samples: str, window: int, hop: int
) -> DataFrame:
    """Full windows over streams of known length: ``window_no``, ``start`` and ``end`` sample.

    A stream's windows are made from its length alone; a long stream is first cut into
    spans of windows so that one row never expands without bound.
    """
    span = 100_000
    count = F.when(F.col(samples) >= window, F.floor((F.col(samples) - window) / F.lit(hop)) + 1).otherwise(F.lit(0))
    sized = lengths.withColumn("__n", count).where(F.col("__n") > 0)
    spans = sized.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(span).cast("long"))))
    numbers = F.sequence(F.col("__from"), F.least(F.col("__from") + span, F.col("__n")) - 1)
    out = spans.withColumn("window_no", F.explode(numbers)).withColumn("start", F.col("window_no") * hop)
    return out.withColumn("end", F.col("start") + window).drop("__n", "__from")


def window_frames(
    df: DataFrame, index: str, window: int, hop: int, origin: str | None = None
) -> DataFrame:
    """Put each frame into every window that covers it: ``window_no`` and ``offset``.

    Only windows starting at or after the origin; drop the unfinished last ones by
    comparing with the stream's end.
    """
    at = F.col(index) - F.col(origin) if origin else F.col(index)
    low = F.greatest(F.ceil((at - window + 1) / F.lit(hop)), F.lit(0))
    rows = df.withColumn("window_no", F.explode(F.sequence(low, F.floor(at / F.lit(hop)))))
    return rows.withColumn("offset", at - F.col("window_no") * hop)


def newest_due(df: DataFrame, keys: Sequence[str], order: str, limit: int = 8) -> DataFrame:
    """Catch-up rule: of the windows due together keep the newest ``limit``."""
    return head(df, keys, [F.col(order).desc()], limit)


# -- energy of sample ranges -----------------------------------------------------


def energy_table(chunks: DataFrame, keys: Sequence[str], order: Sequence[str], samples: str) -> DataFrame:
    """Two-level prefix sums (keys, begin, before, inner) of the squares of chunked streams.

    A chunk is a block: ``begin`` is its first sample of the stream, ``before`` the energy before it and ``inner`` the
    running energy inside it, from 0. Only lengths and sums are put in order; a chunk without samples is left out.
    """
    square = lambda v: v.cast("double") * v.cast("double")

    @F.pandas_udf("array<double>")
    def inner(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: np.concatenate([[0.0], np.cumsum(np.square(np.asarray(v, dtype=np.float64)))]))

    sized = chunks.where(F.size(samples) > 0)
    sums = sized.select(*keys, *order, F.size(samples).alias("__n"), F.aggregate(samples, F.lit(0.0), lambda acc, v: acc + square(v)).alias("__e"))
    rows = ordered(sums, keys, order).scan(__upto=total("__n"), __sum=total("__e")).rows()
    places = rows.select(*keys, *order, (F.col("__upto") - F.col("__n")).alias("begin"), (F.col("__sum") - F.col("__e")).alias("before"))
    return null_safe_join(places, sized.select(*keys, *order, inner(samples).alias("inner")), [*keys, *order]).select(*keys, "begin", "before", "inner")


def range_energy(table: DataFrame, ranges: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """``ranges`` with ``energy`` and ``rms`` of the samples [low, high) of their stream, cut to the samples it has.

    Both ends of a range are one lookup each: the block that a place is in, found in time order, and one value of it.
    A range without samples has energy 0 and no level; a stream without samples too.
    """
    keys, names = list(keys), ranges.columns
    ranges = stable(ranges.withColumn("__range", F.monotonically_increasing_id()))
    ends = ranges.select(*keys, "__range", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.greatest(F.col(low), F.lit(0)).cast("long").alias("at")), F.struct(F.lit(1).alias("end"), F.greatest(F.col(high), F.lit(0)).cast("long").alias("at")))).alias("e"))
    blocks = table.select(*keys, F.col("begin").alias("at"), "begin")
    placed = asof(ends.select(*keys, "__range", "e.end", "e.at"), blocks, keys, "at", "begin", tie="__range")
    found = null_safe_join(placed.where("begin is not null"), table, [*keys, "begin"])
    inside = F.least(F.col("at") - F.col("begin"), F.size("inner") - 1).cast("int")
    upto = F.struct((F.col("before") + F.get("inner", inside)).alias("sum"), (F.col("begin") + inside).alias("at"))
    both = found.groupBy("__range").agg(F.max(F.when(F.col("end") == 0, upto)).alias("a"), F.max(F.when(F.col("end") == 1, upto)).alias("b"))
    out = ranges.join(both, "__range", "left")
    n = F.col("b.at") - F.col("a.at")
    energy = F.when(n > 0, F.col("b.sum") - F.col("a.sum")).otherwise(F.lit(0.0))
    return out.select(*names, energy.alias("energy"), F.when(n > 0, F.sqrt(F.greatest(energy, F.lit(0.0)) / n)).alias("rms"))


# -- scoring -------------------------------------------------------------------

Scorer = Callable[[np.ndarray], np.ndarray]
_SCORERS: dict[str, Callable[[], Scorer | None]] = {"noop": lambda: None}


def register_scorer(name: str, factory: Callable[[], Scorer]) -> None:
    """Make a scorer known; ``factory`` runs once per task and returns batch -> scores."""
    _SCORERS[name] = factory


def score_windows(
    windows: DataFrame, wave: str, name: str, frames: int, out: str = "p"
) -> DataFrame:
    """Score each window with a registered scorer, in Arrow batches.

    The scorer maps an array (batch, samples) to (batch, frames); another output length
    is an error.  ``noop`` gives no rows.
    """
    if name not in _SCORERS:
        raise ValueError(f"no scorer is registered as {name!r}, known are {sorted(_SCORERS)}")
    factory = _SCORERS[name]
    kept = [c for c in windows.columns if c != wave]
    if name == "noop":
        return windows.select(*kept, F.array().cast("array<double>").alias(out)).where(F.lit(False))
    schema = windows.select(*kept).schema
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields] + [f"`{out}` array<double>"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = factory()
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(wave))
            matrix = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            scores = np.asarray(scorer(matrix), dtype=np.float64)
            if scores.shape != (batch.num_rows, frames):
                raise ValueError(f"scorer output {scores.shape} is not ({batch.num_rows}, {frames})")
            offsets = np.arange(0, (batch.num_rows + 1) * frames, frames, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(scores.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [lists], [*kept, out])

    return windows.mapInArrow(run, ddl)


def predicted_windows(windows: DataFrame, wave: str, name: str, samples: int, frames: int, out: str = "p", batch: int = 256) -> DataFrame:
    """The same by Spark's batch inference function: the model is made once per worker and gets tensors (batch, samples).

    A window of another length or a score of another length is an error; a null window has a null score.
    """
    from pyspark.ml.functions import predict_batch_udf  # a large package that other workers need not load

    if name not in _SCORERS:
        raise ValueError(f"no scorer is registered as {name!r}, known are {sorted(_SCORERS)}")
    factory = _SCORERS[name]
    if name == "noop":
        return score_windows(windows, wave, name, frames, out)

    def make():
        scorer = factory()

        def predict(matrix: np.ndarray) -> np.ndarray:
            scores = np.asarray(scorer(matrix), dtype=np.float64)
            if scores.shape != (len(matrix), frames):
                raise ValueError(f"scorer output {scores.shape} is not ({len(matrix)}, {frames})")
            return scores

        return predict

    score = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[[samples]])
    kept = [c for c in windows.columns if c != wave]
    full = windows.where(F.col(wave).isNotNull())
    # the function reshapes what it gets, so lengths are looked at before
    sound = F.when(F.size(wave) == samples, F.col(wave)).otherwise(F.raise_error(F.concat(F.lit(f"a window has {samples} samples, not "), F.size(wave).cast("string"))).cast(full.schema[wave].dataType))
    scored = full.withColumn(wave, sound).select(*kept, score(F.col(wave)).alias(out))
    return scored.unionByName(windows.where(F.col(wave).isNull()).select(*kept, F.lit(None).cast("array<double>").alias(out)))


def replay_predictions(
    scored: DataFrame,
    keys: Sequence[str],
    window_s: float = WINDOW_S,
    hop_s: float = 1.0,
    threshold: float = 0.5,
    merge_s: float = 0.3,
    chunk_s: float = 0.032,
    duration: str = "duration_s",
) -> DataFrame:
    """Detector replay: peaks of every scored window, suppressed in emission order.

    ``scored`` has keys, ``window_no``, ``p`` and the stream duration.  A prediction is
    emitted when the chunk that completes its window has been read.
    """
    n = F.size("p")
    step = F.lit(window_s) / n
    # the frame count is the same for all windows of a scorer; the radius follows from it
    found = scored.withColumn("__radius", F.round(F.lit(merge_s) / step).cast("int"))
    around = lambda i: F.array_max(
        F.slice(
            F.col("p"),
            F.greatest(i - F.col("__radius"), F.lit(0)) + 1,
            F.least(i + F.col("__radius") + 1, n) - F.greatest(i - F.col("__radius"), F.lit(0)),
        )
    )
    peaks = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (F.get("p", i) >= threshold) & (F.get("p", i) == around(i)),
    )
    rows = found.select(
        *keys, "window_no", duration, step.alias("__step"), F.explode(F.transform(peaks, lambda i: F.struct(i.alias("frame"), F.get("p", i).alias("confidence")))).alias("k")
    ).select(
        *keys,
        "window_no",
        duration,
        F.col("k.frame"),
        F.col("k.confidence"),
        (F.col("window_no") * F.lit(hop_s) + F.col("k.frame") * F.col("__step")).alias("boundary_time_s"),
    )
    kept = mark_spaced(ordered(rows, keys, ["window_no", "frame"]), "boundary_time_s", merge_s, "harness", False)
    ready = F.col("window_no") * F.lit(hop_s) + F.lit(window_s)
    emitted = F.least(F.ceil(ready / F.lit(chunk_s) - F.lit(1e-9)) * F.lit(chunk_s), F.col(duration))
    return kept.where(F.col("kept")).rows().select(*keys, emitted.alias("emitted_at_s"), "boundary_time_s", "confidence")


def live_changes(
    scored: DataFrame,
    keys: Sequence[str],
    threshold: float = 0.5,
    k: int = 5,
    left_s: float = 0.5,
    right_s: float = 1.0,
    gap_s: float = 1.0,
    radius_s: float = 0.1,
    frame_s: float = signals.FRAME_S,
) -> DataFrame:
    """Live decision rule over scored windows (``win_start_s``, ``win_end_s``, ``p``).

    Smooth, pick peaks in the trusted band, keep those at least ``gap_s`` from the last
    kept one in either direction, in the order in which windows arrive.
    """
    radius = max(1, int(radius_s / frame_s))
    smooth = scored.withColumn("p", signals.smoothed("p", k))
    peaks = signals.trusted_peaks("p", threshold, radius, int(left_s / frame_s), int(right_s / frame_s))
    rows = smooth.select(
        *keys,
        "win_start_s",
        "win_end_s",
        F.explode(F.transform(peaks, lambda i: F.struct(i.alias("frame"), F.get("p", i).alias("prob")))).alias("k"),
    ).select(
        *keys,
        "win_end_s",
        F.col("k.frame"),
        F.col("k.prob"),
        (F.col("win_start_s") + F.col("k.frame") * F.lit(frame_s)).alias("time_s"),
    )
    kept = mark_spaced(ordered(rows, keys, ["win_end_s", "frame"]), "time_s", gap_s, "live", False)
    return kept.where(F.col("kept")).rows().select(*keys, "time_s", "prob", F.col("win_end_s").alias("detected_at_s"))
