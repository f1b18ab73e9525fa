"""Speaker turns and the boundaries between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow.operators.ordered import lag, ordered
from segflow.functions import signals

#: Frames of a block in which boundaries meet.
BLOCK = 64


def boundaries(turns: DataFrame, tie_break: str | None = None) -> DataFrame:
    """One row per turn whose speaker differs from the previous turn of the file."""
    order = ["start_s", tie_break] if tie_break else ["start_s", "end_s", "speaker_id"]
    flag = F.coalesce(F.col("has_overlap"), F.lit(False)) if "has_overlap" in turns.columns else F.lit(False)
    rows = ordered(turns.withColumn("__overlap", flag), ["file_id"], order).scan(
        prev_speaker=lag("speaker_id"), prev_end_s=lag("end_s"), prev_overlap=lag("__overlap")
    )
    return (
        rows.where(F.col("prev_speaker") != F.col("speaker_id"))
        .rows()
        .select(
            "file_id",
            F.col("start_s").alias("boundary_time_s"),
            "prev_speaker",
            F.col("speaker_id").alias("new_speaker"),
            "prev_end_s",
            F.col("start_s").alias("new_start_s"),
            (F.col("__overlap") | F.col("prev_overlap")).alias("has_overlap"),
        )
    )


def frame_labels(
    turns: DataFrame,
    duration_s: float | None = None,
    hop_ms: float = 10.0,
    tolerance_ms: float = 150.0,
    shape: str = "after",
    tie_break: str | None = None,
) -> DataFrame:
    """Non-zero frame labels per file, from the turn boundaries; without ``duration_s`` a file ends with its last turn.

    Each boundary touches only the frames within the tolerance. Boundaries meet by blocks of frames, one or two for each,
    and the frames of a block are made behind the shuffle, as the maximum over its boundaries; so no task has a group
    for each frame.
    """
    hop, tol = hop_ms / 1000.0, tolerance_ms / 1000.0
    at, marks = F.col("boundary_time_s"), boundaries(turns, tie_break)
    if duration_s is None:
        ends = turns.groupBy("file_id").agg(F.max("end_s").alias("__end"))
        marks = marks.join(ends, "file_id").withColumn("__n", F.round(F.col("__end") / hop).cast("long"))
    else:
        marks = marks.withColumns({"__end": F.lit(float(duration_s)), "__n": F.lit(signals.frame_count(duration_s, hop_ms)).cast("long")})
    n = F.col("__n")
    low = F.floor((at - (0.0 if shape == "after" else tol)) / hop) - 1
    high = F.ceil((at + tol) / hop) + 1
    block = lambda frame: F.floor(frame / F.lit(BLOCK))
    touched = marks.where((high >= 0) & (low <= n - 1) & (n > 0) & (at - tol <= F.col("__end")))
    blocks = touched.select("file_id", at, n, F.explode(F.sequence(block(F.greatest(low, F.lit(0))), block(F.least(high, n - 1)))).alias("__block"))
    held = blocks.groupBy("file_id", "__block").agg(F.collect_set(at).alias("__at"), F.max("__n").alias("__n"))
    first = F.col("__block") * BLOCK
    rows = held.select("file_id", "__at", F.explode(F.sequence(first, F.least(first + (BLOCK - 1), n - 1))).alias("frame"))
    value = F.array_max(F.transform("__at", lambda change: label_value(F.col("frame") * F.lit(hop), change, tol, shape)))
    return rows.select("file_id", "frame", value.alias("label")).where("label > 0")


def label_value(t: Column, change: Column, tol: float, shape: str, scale: float = 0.5) -> Column:
    d = t - change
    if shape == "hard":
        return F.when(F.abs(d) <= tol, 1.0).otherwise(0.0)
    bump = F.exp(F.lit(-0.5) * F.pow(d / (tol * scale), F.lit(2.0)))
    inside = (t >= change) & (t <= change + tol) if shape == "after" else F.abs(d) <= tol
    return F.when(inside, bump).otherwise(0.0)
