"""How the given tables stand in for turns, streams, windows, clips and histories.

Each input comes as a DataFrame and as a SQL common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.operators.ordered import number, ordered
from segflow.plans.registry import Tables

ORIGIN = "2024-01-01 00:00:00"
DAY_US = 86_400_000_000
#: frames per stand-in window and their distance: 12 x 0.25 s = 3 s
WINDOW_FRAMES, HOP_S = 12, 0.25

TURNS = """turns AS (
  SELECT conv_id AS file_id, turn::DOUBLE AS start_s, (turn + 1)::DOUBLE AS end_s, role AS speaker_id,
         turn % 5 = 0 AS has_overlap, text, turn
  FROM conversations)"""


def turns(t: Tables) -> DataFrame:
    return t.conversations.select(
        F.col("conv_id").alias("file_id"),
        F.col("turn").cast("double").alias("start_s"),
        (F.col("turn") + 1).cast("double").alias("end_s"),
        F.col("role").alias("speaker_id"),
        (F.col("turn") % 5 == 0).alias("has_overlap"),
        "text",
        "turn",
    )


STREAM = f"""stream AS (
  SELECT event_id, user_id AS stream_id, event_type, value,
         epoch_us(ts) - epoch_us(TIMESTAMP '{ORIGIN}') AS at_us, least(value / 500, 1.0) AS score
  FROM events)"""


def stream(t: Tables) -> DataFrame:
    """Events as a keyed stream with a whole-microsecond clock."""
    clock = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(ORIGIN).cast("timestamp"))
    return t.events.select(
        "event_id",
        F.col("user_id").alias("stream_id"),
        "event_type",
        "value",
        clock.alias("at_us"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("score"),
    )


FRAMES = f"""{STREAM}, frames AS (
  SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY at_us, event_id) - 1 AS frame FROM stream)"""


def frames(t: Tables) -> DataFrame:
    """The stream with a frame index per stream, from 0."""
    rows = ordered(stream(t), ["stream_id"], ["at_us", "event_id"]).scan(frame=number())
    return rows.rows().withColumn("frame", F.col("frame") - 1)


WINDOWS = f"""{FRAMES}, windows AS (
  SELECT stream_id, frame // {WINDOW_FRAMES} AS window_no,
         list(score ORDER BY frame) AS p,
         list(CASE WHEN event_type = 'error' AND value >= 50 THEN 1.0 ELSE 0.0 END ORDER BY frame) AS labels
  FROM frames GROUP BY ALL HAVING count(*) = {WINDOW_FRAMES}),
kinds AS (
  SELECT *, CASE WHEN list_max(labels) > 0.5 THEN 'change' WHEN (stream_id + window_no) % 2 = 0 THEN 'nochange' ELSE 'fake' END AS kind
  FROM windows)"""


def windows(t: Tables) -> DataFrame:
    """Windows of 12 consecutive frames: score and label arrays of fixed length, and a kind."""
    n = WINDOW_FRAMES
    label = F.when((F.col("event_type") == "error") & (F.col("value") >= 50), 1.0).otherwise(0.0)
    packed = (
        frames(t)
        .groupBy("stream_id", F.floor(F.col("frame") / n).alias("window_no"))
        .agg(F.array_sort(F.collect_list(F.struct("frame", "score", label.alias("label")))).alias("rows"))
        .where(F.size("rows") == n)
    )
    out = packed.select("stream_id", "window_no", F.col("rows.score").alias("p"), F.col("rows.label").alias("labels"))
    quiet = F.when((F.col("stream_id") + F.col("window_no")) % 2 == 0, "nochange").otherwise("fake")
    return out.withColumn("kind", F.when(F.array_max("labels") > 0.5, "change").otherwise(quiet))


# smooth over 5 frames with repeated edges, keep frames 2..10 (0.5 s to 2.5 s), reduce to the peak
PEAKS = f"""{WINDOWS}, smoothed AS (
  SELECT *, list_transform(range(0, {WINDOW_FRAMES}), lambda i: CASE WHEN i BETWEEN 2 AND 10 THEN
     (p[greatest(i - 2, 0) + 1] + p[greatest(i - 1, 0) + 1] + p[i + 1]
      + p[least(i + 1, {WINDOW_FRAMES - 1}) + 1] + p[least(i + 2, {WINDOW_FRAMES - 1}) + 1]) / 5.0 ELSE 0.0 END) AS q
  FROM kinds),
peaks AS (
  SELECT stream_id, window_no, kind, list_max(labels) > 0.5 AS has,
    CASE WHEN list_max(labels) > 0.5 THEN (list_position(labels, list_max(labels)) - 1) * {HOP_S} END AS t_true,
    (list_position(q, list_max(q)) - 1) * {HOP_S} AS t_pred, list_max(q) AS score
  FROM smoothed)"""


def peaks(t: Tables) -> DataFrame:
    from segflow.operators.metrics import window_peaks

    return window_peaks(windows(t), hop_s=HOP_S)


MATCHING = f"""{STREAM}, truth AS (
  SELECT stream_id AS file_id, event_id AS id, at_us FROM stream WHERE event_type = 'error'),
predictions AS (
  SELECT stream_id AS file_id, event_id AS id, at_us, score AS confidence FROM stream WHERE event_type = 'click')"""


def truth(t: Tables) -> DataFrame:
    return stream(t).where("event_type = 'error'").select(F.col("stream_id").alias("file_id"), F.col("event_id").alias("id"), "at_us")


def predictions(t: Tables) -> DataFrame:
    return (
        stream(t)
        .where("event_type = 'click'")
        .select(F.col("stream_id").alias("file_id"), F.col("event_id").alias("id"), "at_us", F.col("score").alias("confidence"))
    )


RANKED = """ranked AS (
  SELECT l.doc_id, l.toxic, l.quality, d.lang, d.source, round(least(d.n_chars / 33047.0, 1.0), 4) AS score
  FROM labels l JOIN documents d USING (doc_id))"""


def ranked(t: Tables) -> DataFrame:
    score = F.round(F.least(F.col("n_chars") / F.lit(33047.0), F.lit(1.0)), 4)
    documents = t.documents.select("doc_id", "lang", "source", score.alias("score"))
    return t.labels.join(documents, "doc_id")


CLIPS = """clips AS (
  SELECT doc_id AS clip_id, source AS speaker_id, lang AS category, n_chars * 16 AS frames FROM documents)"""
RATE = 16000


def clips(t: Tables) -> DataFrame:
    """Documents as clips: speaker = source, length in samples = 16 per character."""
    return t.documents.select(
        F.col("doc_id").alias("clip_id"),
        F.col("source").alias("speaker_id"),
        F.col("lang").alias("category"),
        (F.col("n_chars") * 16).alias("frames"),
    )


def u_sql(seed: int | str, key: str) -> str:
    """The seeded draw in SQL."""
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0)"
