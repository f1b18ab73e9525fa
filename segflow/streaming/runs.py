"""Running a streaming plan to the end of its available input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segflow.session import scratch_path, stable


def parts_to_stream(spark: SparkSession, parts: list[DataFrame], label: str, files_per_trigger: int | None = None) -> DataFrame:
    """Write the parts one after the other to the shared folder and read them as a stream."""
    path = scratch_path(spark, label)
    for part in parts:
        part.write.mode("append").parquet(path)
    reader = spark.readStream.schema(parts[0].schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


#: Rows of one key (of the table, without a key) that a trigger of a prepared stream takes at most, about, and those of a file.
TRIGGER_ROWS = 500_000


def in_triggers(spark: SparkSession, df: DataFrame, at: str, label: str, key: str | None = None, rows: int = TRIGGER_ROWS) -> DataFrame:
    """``df`` as a stream of micro-batches, two at least, in the order of ``at``; none has more than about ``rows`` rows of one ``key``.

    Each part is dealt evenly over as many files as a trigger takes, so no row comes behind the watermark of a part
    before it, and what a key has in memory is bounded by ``rows``, not by its history. A key costs state calls in each
    trigger that has rows of it. So the number of triggers follows the largest key: with one for so many rows of the
    table, more keys would each be woken more often, and the time would grow with the square of the table.
    """
    frame = stable(df)
    count = frame.count()
    largest = count if key is None else frame.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    triggers = max(2, -(-largest // rows))
    marks = frame.select(F.percentile_approx(at, [i / triggers for i in range(1, triggers)], F.lit(max(1000, 10 * triggers))).alias("m")).first()["m"] or []
    edges = [None, *sorted(set(marks)), None]
    files, parts = max(1, min(8, count // (8 * len(edges))), -(-count // (rows * (len(edges) - 1)))), []
    for low, high in zip(edges, edges[1:]):
        part = frame if low is None else frame.where(F.col(at) >= low)
        parts.append((part if high is None else part.where(F.col(at) < high)).repartition(files))
    return parts_to_stream(spark, parts, label, files)


def drained(spark: SparkSession, stream: DataFrame, label: str, out: str | None = None, checkpoint: str | None = None, totals: dict | None = None) -> DataFrame:
    """Run the stream over what is available into a file sink and read the result.

    With the paths of an earlier run the query goes on where that one stopped. ``totals`` gets the sums of the metrics
    that the stream observes.

    Offsets, state and sink live in the shared folder, so a lost executor or driver
    resumes where it was.
    """
    out, checkpoint = out or scratch_path(spark, f"{label}-out"), checkpoint or scratch_path(spark, f"{label}-checkpoint")
    if totals is not None:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if totals is not None:
        for progress in query.recentProgress:  # one for each micro-batch
            for metrics in progress.observedMetrics.values():
                for name, value in metrics.asDict().items():
                    totals[name] = totals.get(name, 0) + (value or 0)
    return spark.read.schema(stream.schema).parquet(out)
