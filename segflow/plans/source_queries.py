"""Source and sink queries: each writes derived rows to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.functions import signals
from segflow.operators import metrics, turns, windows
from segflow.plans import frame_queries as FQ
from segflow.plans import inputs as I
from segflow.plans import metric_queries as MQ
from segflow.plans import pool_queries as PQ
from segflow.plans.registry import Tables, query
from segflow.session import scratch_path
from segflow.sources import listings, sinks
from segflow.streaming.runs import in_triggers


@query("s1_manifest", f"WITH {I.TURNS} SELECT file_id::VARCHAR AS file_id, start_s, end_s, speaker_id, has_overlap FROM turns")
def manifest(t: Tables) -> DataFrame:
    """Turn manifest as CSV with text flags."""
    path = scratch_path(t.spark, "manifest")
    flag = F.when(F.col("has_overlap"), "True").otherwise("False")
    I.turns(t).select("file_id", "start_s", "end_s", "speaker_id", flag.alias("has_overlap")).write.option("header", True).csv(path)
    return listings.load_manifest(t.spark, path)


@query(
    "s2_speakers",
    "SELECT s_suppkey::VARCHAR AS speaker_id, CASE s_suppkey % 3 WHEN 0 THEN 'M' ELSE 'F' END AS gender FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 3 <> 2",
)
def speakers(t: Tables) -> DataFrame:
    """Pipe-delimited speaker list with comments, blanks and unknown genders."""
    path = scratch_path(t.spark, "speakers")
    key = F.col("s_suppkey")
    gender = F.when(key % 3 == 0, "m").when(key % 3 == 1, " F ").otherwise("x")
    line = F.when(key % 14 == 0, F.concat(F.lit("; note "), key)).when(key % 7 == 0, F.lit("  "))
    line = line.otherwise(F.concat(key.cast("string"), F.lit(" | "), gender, F.lit(" | clean | "), F.col("s_name")))
    t.supplier.select(line.alias("value")).write.text(path)
    return listings.load_speakers(t.spark, path)


@query("s3_clip_catalogue", "SELECT 'speaker=' || source AS speaker_id, count(DISTINCT doc_id % 3) AS files, sum(length(doc_id::VARCHAR) + 1)::BIGINT AS bytes FROM documents GROUP BY 1")
def clip_catalogue(t: Tables) -> DataFrame:
    """Speakers, files and bytes found from a folder tree; file contents are not read."""
    path = scratch_path(t.spark, "clips")
    rows = t.documents.select(F.col("source").alias("speaker"), (F.col("doc_id") % 3).alias("part"), F.col("doc_id").cast("string").alias("value"))
    rows.repartition("speaker", "part").write.partitionBy("speaker", "part").text(path)
    files = listings.clip_catalogue(t.spark, path, (".txt",))
    return files.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@query("s4_bank_listing", "SELECT DISTINCT p_type || '/' || p_brand || '.wav' AS path FROM part")
def bank_listing(t: Tables) -> DataFrame:
    """List lines of a bank: last token, root folder stripped, distinct."""
    root = F.when(F.col("p_partkey") % 2 == 0, "BANK/").otherwise("")
    line = F.concat(F.lit("--id "), F.col("p_partkey"), F.lit("  "), root, F.col("p_type"), F.lit("/"), F.col("p_brand"), F.lit(".wav "))
    path = scratch_path(t.spark, "list")
    t.part.select(line.alias("value")).write.text(path)
    return listings.parse_bank_lines(t.spark.read.text(path), "BANK")


@query(
    "s7_frame_scores",
    f"WITH {FQ._SLIDING}, s AS (SELECT stream_id, window_no, {FQ._SMOOTH} AS y FROM (SELECT *, p AS x FROM sliding)) SELECT stream_id, window_no * 1.0::DOUBLE AS win_start_s, i AS frame, round((y[i + 1]::VARCHAR)::DECIMAL(30, 20), 3)::DOUBLE AS p FROM s, unnest(range(0, 12)) u(i)",
)
def frame_scores(t: Tables) -> DataFrame:
    """Smoothed window scores written as JSON lines with three decimals and read again."""
    path = scratch_path(t.spark, "scores")
    sinks.write_frame_scores(FQ.sliding(t).select("stream_id", F.col("window_no").cast("double").alias("win_start_s"), signals.smoothed("p").alias("p")), path)
    return sinks.read_frame_scores(t.spark, path).select("stream_id", "win_start_s", F.posexplode("p").alias("frame", "p"))


_TRANSCRIPT = """SELECT conv_id, turn, text, CASE WHEN turn % 3 <> 0 THEN round(1.0 / (turn + 2), 6)::DOUBLE END AS confidence, round(turn * 1.23456, 3)::DOUBLE AS duration_seconds,
  CASE WHEN turn % 2 = 1 THEN round(turn * 0.77771, 3)::DOUBLE END AS segment_start_seconds, true AS keeps_confidence, turn % 2 = 1 AS has_start,
  '2024-01-01T00:0' || turn || ':00.000000+00:00' AS stamp FROM conversations"""


def _entries(t: Tables) -> DataFrame:
    """(turn, value): one transcript entry per turn behind its ids, with the null and optional field rules."""
    turn = F.col("turn")
    start = F.when(turn % 2 == 1, turn * F.lit(0.77771))
    stamp = F.timestamp_seconds(F.lit(1704067200) + turn * 60)
    entry = sinks.transcript_json(stamp, F.col("text"), F.when(turn % 3 != 0, 1.0 / (turn + 2)), turn * F.lit(1.23456), start)
    return t.conversations.select("turn", F.concat_ws("\t", "conv_id", "turn", entry).alias("value"))


def _parsed(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "\t", 3)
    body = F.get(parts, F.lit(2))
    schema = "timestamp string, text string, confidence double, duration_seconds double, segment_start_seconds double"
    back = lines.select(
        F.get(parts, F.lit(0)).cast("long").alias("conv_id"), F.get(parts, F.lit(1)).cast("long").alias("turn"), F.from_json(body, schema).alias("j"), body.alias("b")
    )
    keys = F.json_object_keys("b")
    return back.select(
        "conv_id",
        "turn",
        "j.text",
        "j.confidence",
        "j.duration_seconds",
        "j.segment_start_seconds",
        F.array_contains(keys, "confidence").alias("keeps_confidence"),
        F.array_contains(keys, "segment_start_seconds").alias("has_start"),
        F.col("j.timestamp").alias("stamp"),
    )


@query("s8_transcript", _TRANSCRIPT)
def transcript(t: Tables) -> DataFrame:
    """Transcript lines written as JSON and parsed back, with the null and optional field rules."""
    path = scratch_path(t.spark, "transcript")
    sinks.write_transcript(_entries(t), path)
    return _parsed(t.spark.read.text(path))


@query("s8_stream_transcript", _TRANSCRIPT)
def stream_transcript(t: Tables) -> DataFrame:
    """The same entries through the exactly-once stream sink, a folder per micro-batch."""
    path, checkpoint = scratch_path(t.spark, "live-transcript"), scratch_path(t.spark, "live-transcript-checkpoint")
    source = in_triggers(t.spark, _entries(t), "turn", "entries")
    sinks.stream_transcript(source, path, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return _parsed(sinks.read_transcript(t.spark, path))


@query(
    "s9_result_tables",
    f"""WITH {I.MATCHING} SELECT 'boundaries' AS name, 'all' AS algorithm, count(*) AS n FROM (WITH {I.TURNS}, l AS (SELECT speaker_id, lag(speaker_id) OVER (PARTITION BY file_id ORDER BY start_s, turn) AS prev FROM turns) SELECT * FROM l WHERE prev <> speaker_id)
UNION ALL SELECT 'predictions', 'alg' || file_id % 3, count(*) FROM predictions GROUP BY ALL
UNION ALL SELECT 'stats', 'calls', count(DISTINCT stream_id) FROM stream""",
)
def result_tables(t: Tables) -> DataFrame:
    """The three result tables written (by algorithm) and counted after reading."""
    path = scratch_path(t.spark, "results")
    made = I.predictions(t).withColumn("algorithm", F.concat(F.lit("alg"), (F.col("file_id") % 3).cast("string")))
    stats = MQ._stats(t).withColumn("algorithm", F.lit("calls"))
    sinks.write_results(turns.boundaries(I.turns(t), "turn"), made, stats, path)
    n = F.count(F.lit(1)).alias("n")
    read = lambda table: sinks.read_results(t.spark, path, table)
    name = lambda v: F.lit(v).alias("name")
    bounds = read("ground_truth_boundaries").groupBy().agg(n).select(name("boundaries"), F.lit("all").alias("algorithm"), "n")
    by = lambda table, label: read(table).groupBy("algorithm").agg(n).select(name(label), "algorithm", "n")
    return bounds.unionByName(by("predictions", "predictions")).unionByName(by("runtime_stats", "stats"))


@query("s10_frozen_set", f"WITH {PQ._SPECS} SELECT spec_id, kind, round(t_change, 6)::DOUBLE AS t_change, gap FROM specs")
def frozen_set(t: Tables) -> DataFrame:
    """A window set made once; the second call reads it and does not make it again."""
    path = scratch_path(t.spark, "frozen")
    sinks.frozen_set(t.spark, path, lambda: PQ.specs(t).select("spec_id", "kind", "t_change", "gap"), 42, windows.Recipe())

    def never() -> DataFrame:
        raise RuntimeError("a finished set must be reused")

    return sinks.frozen_set(t.spark, path, never, 42, windows.Recipe())
