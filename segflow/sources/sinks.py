"""Sinks: frame scores, transcript lines, result tables and frozen window sets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_SCHEMA = "stream_id bigint, win_start_s double, p array<double>"


def write_frame_scores(windows: DataFrame, path: str) -> None:
    """Window scores as JSON lines with three decimals, for retuning offline."""
    rows = windows.select(
        "stream_id", F.round("win_start_s", 3).alias("win_start_s"), F.transform("p", lambda v: F.round(v.cast("double"), 3)).alias("p")
    )
    rows.write.mode("append").json(path)


def read_frame_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAME_SCHEMA).json(path)


def transcript_json(time: Column, text: Column, confidence: Column, duration: Column, start: Column | None = None) -> Column:
    """One transcript entry: confidence stays as an explicit null, the start is left out when NULL."""
    stamp = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    base = [
        stamp.alias("timestamp"),
        text.alias("text"),
        confidence.alias("confidence"),
        F.round(duration, 3).alias("duration_seconds"),
    ]
    keep = {"ignoreNullFields": "false"}
    short = F.to_json(F.struct(*base), keep)
    if start is None:
        return short
    full = F.to_json(F.struct(*base, F.round(start, 3).alias("segment_start_seconds")), keep)
    return F.when(start.isNull(), short).otherwise(full)


def write_transcript(lines: DataFrame, path: str) -> None:
    """Append entries (column ``value``) to a folder of JSON-lines files."""
    lines.select("value").write.mode("append").text(path)


def write_transcript_batch(lines: DataFrame, batch_id: int, path: str) -> None:
    """Entries of one micro-batch as the folder of that batch: a batch that comes again replaces itself."""
    lines.select("value").write.mode("overwrite").text(f"{path}/batch_id={batch_id}")


def stream_transcript(lines: DataFrame, path: str, checkpoint: str):
    """Entries (column ``value``) of a stream, each exactly once; returns the writer.

    After a failure the engine gives the last batch again under its old number, so nothing is written twice.
    """
    write = lambda batch, number: write_transcript_batch(batch, number, path)
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """All entries (column ``value``) of a streamed transcript."""
    return spark.read.schema("value string, batch_id bigint").text(path).select("value")


def write_results(boundaries: DataFrame, predictions: DataFrame, stats: DataFrame, path: str, form: str = "parquet") -> None:
    """The three result tables of a detector run; predictions and statistics by algorithm."""
    writer = lambda df: df.write.mode("append").option("header", True).format(form)
    writer(boundaries).save(f"{path}/ground_truth_boundaries")
    writer(predictions).partitionBy("algorithm").save(f"{path}/predictions")
    writer(stats).partitionBy("algorithm").save(f"{path}/runtime_stats")


def read_results(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{table}")


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows of a table and a hash of their content that does not depend on their order."""
    row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns])
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("h")).first()
    return found["n"], str(found["h"] or 0)


def frozen_set(spark: SparkSession, path: str, make: Callable[[], DataFrame], seed: int | None = None, recipe: object = None) -> DataFrame:
    """A window set made once and reused, tied to its ``seed`` and ``recipe``.

    The set goes to a folder of its own and the manifest (seed, recipe, rows, content hash, folder) is published last, so
    a broken first write leaves no manifest and the set is made again. A set of another seed or recipe is an error, and so
    is one whose files no longer have the content that the manifest names.
    """
    wanted = {"seed": seed, "recipe": None if recipe is None else repr(recipe)}
    try:
        manifest = json.loads(spark.read.option("wholetext", True).text(f"{path}/manifest").first()["value"])
    except (AnalysisException, TypeError):  # no manifest, or an empty one
        folder = f"set-{uuid.uuid4().hex}"
        make().write.parquet(f"{path}/{folder}")
        rows, content = fingerprint(spark.read.parquet(f"{path}/{folder}"))
        manifest = wanted | {"rows": rows, "content": content, "folder": folder}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
        return spark.read.parquet(f"{path}/{folder}")
    for name, value in wanted.items():
        if manifest[name] != value:
            raise ValueError(f"the set at {path} was made with {name} {manifest[name]}, not {value}")
    found = spark.read.parquet(f"{path}/{manifest['folder']}")
    if fingerprint(found) != (manifest["rows"], manifest["content"]):
        raise ValueError(f"the set at {path} has changed since it was made")
    return found
