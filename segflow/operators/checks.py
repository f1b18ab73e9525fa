"""Pool summaries and integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow.functions import draw, signals

RATE = 16000
# Edges of the clip-length histogram, in seconds; the last bin is closed.
LENGTH_EDGES = (0.0, 2.0, 3.0, 3.5, 5.0, 10.0, 15.0, 30.0)


def straddling(members: DataFrame, id_column: str, split: str = "split") -> DataFrame:
    """Ids that occur in more than one split; empty when the splits are disjoint."""
    # one shuffle: the set of split names of an id is tiny and merges map-side
    names = F.size(F.collect_set(split)).cast("long").alias("splits")
    return members.groupBy(id_column).agg(names).where("splits > 1")


def pool_summary(clips: DataFrame, by: Sequence[str], speaker: str, length: str) -> DataFrame:
    """Speakers, clips, samples and hours.

    Clips are counted per speaker first, so distinct speakers need no second copy of the rows.
    """
    per = clips.groupBy(*by, speaker).agg(F.count(F.lit(1)).alias("c"), F.sum(length).alias("s"))
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("speakers"),
        F.sum("c").alias("clips"),
        F.sum("s").alias("samples"),
        F.round(F.sum("s") / F.lit(RATE * 3600.0), 3).alias("hours"),
    )


def length_histogram(clips: DataFrame, seconds: Column, edges: Sequence[float] = LENGTH_EDGES) -> DataFrame:
    """Counts per length bin [lo, hi); the last bin includes its upper edge; empty bins stay."""
    s = F.col("__s")
    bin_no, end = None, len(edges) - 2
    for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        test = (s >= lo) & ((s <= hi) if b == end else (s < hi))
        bin_no = F.when(test, b) if bin_no is None else bin_no.when(test, b)
    found = clips.select(seconds.alias("__s")).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("clips"))
    rows = F.array(
        *[F.struct(F.lit(b).alias("bin"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))]
    )
    bins = clips.sparkSession.range(1).select(F.inline(rows))
    return bins.join(found, "bin", "left").select("lo", "hi", F.coalesce("clips", F.lit(0)).alias("clips"))


def short_share(clips: DataFrame, seconds: Column, limit: float = 3.0) -> DataFrame:
    return clips.agg(
        F.count(F.lit(1)).alias("clips"),
        F.sum((seconds < limit).cast("long")).alias("short"),
        F.avg((seconds < limit).cast("double")).alias("share"),
    )


def speaker_coverage(clips: DataFrame, speaker: str, length: str) -> DataFrame:
    """Longest clip per speaker, and whether it is too short for a window or a stretched segment."""
    top = clips.groupBy(speaker).agg(F.max(length).alias("longest"), F.count(F.lit(1)).alias("clips"))
    return top.withColumns(
        {"no_window": F.col("longest") < 3.0 * RATE, "needs_stitching": F.col("longest") < 3.5 * RATE}
    )


def bound_violations(index: DataFrame, start: str, length: str, size: DataFrame, size_column: str) -> DataFrame:
    """Clips whose end lies beyond the pool; ``size`` has one row."""
    joined = index.crossJoin(F.broadcast(size.select(size_column)))
    return joined.agg(
        F.count(F.lit(1)).alias("clips"),
        F.sum((F.col(start) + F.col(length) > F.col(size_column)).cast("long")).alias("violations"),
    )


def spot_check(clips: DataFrame, clip: str, pcm: str, length: Column, n: int = 20, seed: int = 42) -> DataFrame:
    """``n`` seeded clips with their length and silence checks; the draw needs ids only."""
    picked = clips.select(clip).orderBy(draw.bits(seed, clip), clip).limit(n)
    rows = clips.join(F.broadcast(picked), clip, "left_semi")
    return rows.select(clip, (F.size(pcm) == length).alias("length_ok"), (signals.peak(pcm) > 0).alias("audible"))


def room_category(path: Column) -> Column:
    """Category of an impulse response from the folders in its path."""
    parts = F.split(path, "/")
    has = lambda name: F.array_contains(parts, name)
    return (
        F.when(has("simulated_rirs") & has("smallroom"), "smallroom")
        .when(has("simulated_rirs") & has("mediumroom"), "mediumroom")
        .when(has("simulated_rirs") & has("largeroom"), "largeroom")
        .when(~has("simulated_rirs") & has("real_rirs_isotropic_noises"), "real")
        .otherwise("other")
    )


def class_weight(positions: DataFrame, at: str, p_change: float = 0.4, window_s: float = 3.0, hop_ms: float = 10.0, tolerance_ms: float = 150.0) -> DataFrame:
    """Negative to positive frame mass over change positions, as weight modes.

    Each position contributes its soft frames only; positions are reduced by an average.
    """
    tol, hop = tolerance_ms / 1000.0, hop_ms / 1000.0
    n = int(window_s * 1000 / hop_ms)
    sigma = tol * 0.5
    t = F.col(at)
    low = F.greatest(F.floor((t - tol) / hop) - 1, F.lit(0))
    high = F.least(F.ceil((t + tol) / hop) + 1, F.lit(n - 1))

    def mass(acc: Column, i: Column) -> Column:
        d = F.abs(i * F.lit(hop) - t)
        return acc + F.when(d <= tol, F.exp(-0.5 * F.pow(d / sigma, F.lit(2.0)))).otherwise(0.0)

    one = positions.select(F.aggregate(F.sequence(low, high), F.lit(0.0), mass).alias("m")).agg(F.avg("m").alias("m"))
    pos = F.lit(p_change) * F.col("m")
    ratio = (F.lit(float(n)) - pos) / F.greatest(pos, F.lit(1e-9))
    return one.select(F.col("m").alias("soft_frames"), F.lit(1.0).alias("one"), F.sqrt(ratio).alias("sqrt"), ratio.alias("full"))
