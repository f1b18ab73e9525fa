"""Structured Streaming forms of the live rules, run over all given rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.operators import lines
from segflow.plans import inputs as I
from segflow.plans import line_queries as L
from segflow.plans.registry import ORACLES, Tables, query
from segflow.streaming import processors as p
from segflow.streaming.runs import drained, in_triggers, parts_to_stream

HOUR_US = 3_600_000_000


def _line_updates(t: Tables) -> DataFrame:
    rows = I.stream(t).select(
        "stream_id", "event_id", "at_us", F.col("event_type").isin("click", "view", "purchase").alias("spoken"), F.lit(p.UPDATE).alias("kind")
    )
    # one end marker per stream flushes its open line
    ends = rows.groupBy("stream_id").agg(F.max("at_us").alias("at_us")).select(
        "stream_id", F.lit((1 << 62)).alias("event_id"), "at_us", F.lit(False).alias("spoken"), F.lit(p.FLUSH).alias("kind")
    )
    return rows.unionByName(ends)


@query("k5_stream_lines", ORACLES["k5_line_endpoints"])
def stream_lines(t: Tables) -> DataFrame:
    """Line endpointing with keyed state and event-time timers; the end marker flushes open lines (K11)."""
    source = in_triggers(t.spark, _line_updates(t), "at_us", "lines", "stream_id")
    return drained(t.spark, p.stream_lines(source, *L._RULES), "lines")


_R = L._RULES


@query(
    "k13_forced_cuts",
    f"""WITH {I.STREAM}, s AS (SELECT stream_id, list_reduce(list([at_us, (event_type IN ('click', 'view', 'purchase'))::BIGINT, (event_type = 'signup')::BIGINT] ORDER BY at_us, event_id), lambda a, v:
  CASE WHEN v[3] = 1 THEN list_concat([0::BIGINT], a[2:])
       WHEN a[1] = 0 OR v[1] - a[3] >= {_R[0]} OR (a[4] = 1 AND v[1] - a[3] >= {_R[1]}) OR v[1] - a[2] >= {_R[2]} THEN list_concat([1::BIGINT, v[1], v[1], v[2]], list_append(a[5:], v[1]))
       ELSE list_concat([1::BIGINT, a[2], v[1], greatest(a[4], v[2])], a[5:]) END, [0, 0, 0, 0]::BIGINT[])[5:] AS starts FROM stream GROUP BY stream_id),
l AS (SELECT st.stream_id, st.at_us, len(list_filter(starts, lambda b: b <= st.at_us)) AS line FROM stream st JOIN s USING (stream_id) WHERE event_type <> 'signup')
SELECT stream_id, line, min(at_us) AS "start", max(at_us) AS "end", count(*) AS updates FROM l GROUP BY ALL""",
)
def forced_cuts(t: Tables) -> DataFrame:
    """The same with a forced cut at every sign-up."""
    rows = _line_updates(t).join(
        I.stream(t).select("event_id", (F.col("event_type") == "signup").alias("cut")), "event_id", "left"
    )
    kind = F.when(F.coalesce("cut", F.lit(False)), p.FORCE).otherwise(F.col("kind"))
    source = in_triggers(t.spark, rows.withColumn("kind", kind).drop("cut"), "at_us", "cuts", "stream_id")
    return drained(t.spark, p.stream_lines(source, *L._RULES), "cuts")


@query("k4_stream_gate", ORACLES["k4_sessions"])
def stream_gate(t: Tables) -> DataFrame:
    """Gating with pre-roll, clock and session resets (K3, K4) as a stateful stream."""
    chunks = I.frames(t).select(
        "stream_id", "frame", "at_us", F.rint("value").cast("long").alias("ms"), (F.col("value") >= 100).alias("active")
    )
    source = in_triggers(t.spark, chunks, "at_us", "gate", "stream_id")
    return drained(t.spark, p.stream_gate(source, 4, 150), "gate")


@query(
    "k6_stream_captions",
    f"""WITH {L._cuts_sql('true')} SELECT sid AS stream_id, array_to_string(w[again + low + 1:again + cut], ' ') AS text, round(start, 6) AS start_s, round(chg - start, 6) AS duration_s, 'change' AS cause, round(chg, 6) AS change_s FROM cl
UNION ALL SELECT sid, array_to_string(w[again + low + 1:], ' '), round(start, 6), round(greatest(stop - start, 0), 6), 'final', NULL FROM cf WHERE n - again > low""",
)
def stream_captions(t: Tables) -> DataFrame:
    """Caption lines with replay removal, change splits and finals (K6 to K8) as a stateful stream.

    When a line is emitted depends on triggers and timers; which lines there are does not.
    """
    source = in_triggers(t.spark, p.caption_input(*L.recogniser_rows(t)), "clock_s", "captions", "stream_id")
    out = drained(t.spark, p.stream_caption_rows(source), "captions")
    return out.select("stream_id", "text", "start_s", "duration_s", "cause", "change_s")


@query("k12_stream_counts", f"SELECT sum(splits)::BIGINT AS splits, sum(late_changes)::BIGINT AS late_changes, sum(lines)::BIGINT AS lines FROM ({ORACLES['k12_session_counts']})")
def stream_counts(t: Tables) -> DataFrame:
    """Session counters as observed metrics of the caption stream, read from its progress."""
    source, totals = in_triggers(t.spark, p.caption_input(*L.recogniser_rows(t)), "clock_s", "counted", "stream_id"), {}
    drained(t.spark, p.session_observed(p.stream_caption_rows(source)), "counted", totals=totals)
    return t.spark.createDataFrame([tuple(totals[n] for n in ("splits", "late_changes", "lines"))], "splits bigint, late_changes bigint, lines bigint")


@query("k10_stream_throttle", ORACLES["k10_partial_throttle"])
def stream_throttle(t: Tables) -> DataFrame:
    """Redraw limit as a stateful stream."""
    rows = I.stream(t).select("stream_id", "event_id", "at_us", F.col("event_type").alias("text"), F.lit(None).cast("string").alias("promote"))
    source = in_triggers(t.spark, rows, "at_us", "partials", "stream_id")
    return drained(t.spark, p.stream_partials(source, 12 * HOUR_US), "partials").withColumnRenamed("text", "event_type")


def _level_scorer():
    return lambda batch: np.abs(batch).reshape(len(batch), batch.shape[1], 1).mean(axis=2)


@query(
    "k14_stream_changes",
    f"""WITH {I.FRAMES}, g AS ({ORACLES["k4_sessions"]}),
x AS (SELECT stream_id, session, abs(score) AS v, row_number() OVER (PARTITION BY stream_id ORDER BY at_us, frame) - 1 AS pos FROM g JOIN frames USING (stream_id, frame)),
s AS (SELECT *, min(pos) OVER (PARTITION BY stream_id, session) AS t0, count(*) OVER (PARTITION BY stream_id, session) AS n, (lag(v) OVER w + v + lead(v) OVER w) / 3 AS sm FROM x WINDOW w AS (PARTITION BY stream_id, session ORDER BY pos)),
m AS (SELECT *, greatest(lag(sm) OVER w, sm, lead(sm) OVER w) AS top FROM s WINDOW w AS (PARTITION BY stream_id, session ORDER BY pos)),
c AS (SELECT stream_id, pos, sm, t0 + 4 * e + 12 AS stop, row_number() OVER (PARTITION BY stream_id ORDER BY t0 + 4 * e, pos) AS rn FROM m, unnest(range(0, (n - 12) // 4 + 1)) r(e) WHERE n >= 12 AND pos - t0 - 4 * e BETWEEN 2 AND 8 AND sm >= 0.15 AND sm >= top),
k AS (SELECT stream_id, list_reduce(list([pos, rn] ORDER BY rn), lambda a, v: CASE WHEN abs(v[1] - a[1]) >= 4 THEN list_concat([v[1]], a[2:], [v[2]]) ELSE a END, [-1000000]::BIGINT[])[2:] AS kept FROM c GROUP BY 1)
SELECT stream_id, round(pos * 0.25::DOUBLE, 6) AS time_s, round(sm, 6) AS prob, round(stop / 4.0::DOUBLE, 6) AS detected_at_s FROM c JOIN k USING (stream_id) WHERE list_contains(kept, rn)""",
)
def stream_changes(t: Tables) -> DataFrame:
    """Raw chunks in, live detections out (K4 and K14 chained): one sample per event, twelve samples per window."""
    chunks = I.frames(t).select(
        "stream_id", "frame", "at_us", F.rint("value").cast("long").alias("ms"), (F.col("value") >= 100).alias("active"), F.array("score").alias("samples")
    )
    source = in_triggers(t.spark, chunks, "at_us", "chunks", "stream_id")
    found = p.stream_live_changes(source, _level_scorer, 4, 3.0, 1.0, 0.15, 3, 0.5, 0.75, 0.25, 1.0, 0.25, pre_roll=4, reset_gap_ms=150)
    return drained(t.spark, found, "changes")


@query(
    "k5_session_lines",
    f"""WITH {I.STREAM}, s AS (SELECT stream_id, at_us, event_id, at_us + CASE WHEN event_type IN ('click', 'view', 'purchase') THEN {_R[1]} ELSE {_R[0]} END AS stop FROM stream),
n AS (SELECT *, at_us >= coalesce(max(stop) OVER (PARTITION BY stream_id ORDER BY at_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fresh FROM s),
l AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY stream_id ORDER BY at_us, event_id) AS line FROM n)
SELECT stream_id, min(at_us) AS "start", max(at_us) AS "end", count(*) AS updates FROM l GROUP BY stream_id, line""",
)
def session_lines(t: Tables) -> DataFrame:
    """Lines by silence alone as session windows with a gap column, in append mode; a late marker row closes the last."""
    rows = _line_updates(t).where(F.col("kind") == p.UPDATE).select("stream_id", "at_us", "spoken")
    closing = rows.agg((F.max("at_us") + 1000 * HOUR_US).alias("at_us")).select(F.lit(-1).cast("long").alias("stream_id"), "at_us", F.lit(False).alias("spoken"))
    timed = p.with_event_time(in_triggers(t.spark, rows.unionByName(closing), "at_us", "sessions"), F.col("at_us"), "1 hour")
    return drained(t.spark, lines.gap_sessions(timed, ["stream_id"], "event_time", "at_us", "spoken", _R[0], _R[1]), "sessions").where("stream_id >= 0")


@query(
    "k1_windowed_backlog",
    f"""WITH {I.STREAM} SELECT stream_id, at_us // {HOUR_US} AS tick, count(*) AS chunks, round(sum(value), 6) AS written FROM stream GROUP BY ALL""",
)
def windowed_backlog(t: Tables) -> DataFrame:
    """Tumbling event-time windows per stream with a watermark, closed by a late marker row."""
    rows = I.stream(t).select("stream_id", "at_us", "value")
    closing = rows.agg((F.max("at_us") + 400 * HOUR_US).alias("at_us")).select(F.lit(-1).cast("long").alias("stream_id"), "at_us", F.lit(0.0).alias("value"))
    source = parts_to_stream(t.spark, [rows, closing], "backlog")
    timed = p.with_event_time(source, F.col("at_us"), "1 hour")
    sums = timed.groupBy("stream_id", F.window("event_time", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("value").alias("written")
    )
    base = F.unix_micros(F.lit(I.ORIGIN).cast("timestamp"))
    tick = F.floor((F.unix_micros("w.start") - base) / F.lit(HOUR_US)).alias("tick")
    out = drained(t.spark, sums.select("stream_id", tick, "chunks", "written"), "backlog")
    return out.where("stream_id >= 0")
