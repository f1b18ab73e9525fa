"""Turn, frame-score, peak and suppression queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.functions import draw, signals
from segflow.operators import frames as fr
from segflow.operators import metrics, turns
from segflow.operators.ordered import lag, lead, ordered, percentiles
from segflow.operators.spacing import mark_spaced, spaced
from segflow.plans import inputs as I
from segflow.plans.registry import ORACLES, Tables, query

HOUR_US = 3_600_000_000
SPAN, HOP = 12, 4  # frames per sliding window, frames between windows


@query(
    "w1_turn_boundaries",
    f"""WITH {I.TURNS}, l AS (SELECT *, lag(speaker_id) OVER w AS prev_speaker, lag(end_s) OVER w AS prev_end_s, lag(has_overlap) OVER w AS po
  FROM turns WINDOW w AS (PARTITION BY file_id ORDER BY start_s, turn))
SELECT file_id, start_s AS boundary_time_s, prev_speaker, speaker_id AS new_speaker, prev_end_s, start_s AS new_start_s, has_overlap OR po AS has_overlap
FROM l WHERE prev_speaker <> speaker_id""",
)
def turn_boundaries(t: Tables) -> DataFrame:
    return turns.boundaries(I.turns(t), "turn")


@query(
    "w1_stream_boundaries",
    f"""WITH {I.STREAM}, l AS (SELECT *, lag(event_type) OVER w AS before, lag(at_us) OVER w AS before_us FROM stream WINDOW w AS (PARTITION BY stream_id ORDER BY at_us, event_id))
SELECT stream_id, event_id, before, event_type AS after, at_us - before_us AS pause_us FROM l WHERE before <> event_type""",
)
def stream_boundaries(t: Tables) -> DataFrame:
    """The boundary rule over the event stream (speaker = event type)."""
    rows = ordered(I.stream(t), ["stream_id"], ["at_us", "event_id"]).scan(before=lag("event_type"), before_us=lag("at_us"))
    return rows.where(F.col("before") != F.col("event_type")).rows().select(
        "stream_id", "event_id", "before", F.col("event_type").alias("after"), (F.col("at_us") - F.col("before_us")).alias("pause_us")
    )


_SLIDING = f"""{I.FRAMES}, placed AS (
  SELECT stream_id, w AS window_no, frame - w * {HOP} AS pos, score, at_us
  FROM frames, unnest(range(greatest(ceil((frame - {SPAN} + 1) / {HOP})::BIGINT, 0), frame // {HOP} + 1)) u(w)),
sliding AS (
  SELECT stream_id, window_no, list(score ORDER BY pos) AS p, max(at_us) AS end_us FROM placed
  GROUP BY ALL HAVING count(*) = {SPAN})"""


def sliding(t: Tables) -> DataFrame:
    """Sliding windows of 12 frames every 4 frames, full ones only, as arrays of fixed length."""
    placed = fr.window_frames(I.frames(t), "frame", SPAN, HOP)
    packed = placed.groupBy("stream_id", "window_no").agg(
        F.array_sort(F.collect_list(F.struct("offset", "score"))).alias("rows"), F.max("at_us").alias("end_us")
    )
    return packed.where(F.size("rows") == SPAN).select("stream_id", "window_no", F.col("rows.score").alias("p"), "end_us")


@query("f1_sliding_windows", f"WITH {_SLIDING} SELECT stream_id, window_no, end_us, round(list_max(p), 6) AS top, round(list_sum(p), 6) AS mass FROM sliding")
def sliding_windows(t: Tables) -> DataFrame:
    return sliding(t).select(
        "stream_id", "window_no", "end_us", F.array_max("p").alias("top"), signals.total_of("p").alias("mass")
    )


@query(
    "f1_window_index",
    f"""WITH {I.STREAM}, n AS (SELECT stream_id, sum(value::BIGINT)::BIGINT AS samples FROM stream GROUP BY 1)
SELECT stream_id, w AS window_no, w * 40 AS "start", w * 40 + 300 AS "end" FROM n, unnest(range(0, CASE WHEN samples >= 300 THEN (samples - 300) // 40 + 1 ELSE 0 END)) u(w)""",
)
def window_index(t: Tables) -> DataFrame:
    """Windows over sample indexes from stream lengths alone."""
    samples = I.stream(t).groupBy("stream_id").agg(F.sum(F.rint("value").cast("long")).alias("samples"))
    return fr.sliding_windows(samples, ["stream_id"], "samples", 300, 40).drop("samples")


@query(
    "f2_smooth_rows",
    f"""WITH {I.FRAMES}, w AS (SELECT *, lag(score, 1) OVER o AS a1, lag(score, 2) OVER o AS a2, lead(score, 1) OVER o AS b1, lead(score, 2) OVER o AS b2
  FROM frames WINDOW o AS (PARTITION BY stream_id ORDER BY frame))
SELECT stream_id, frame, round((coalesce(a2, a1, score) + coalesce(a1, score) + score + coalesce(b1, score) + coalesce(b2, b1, score)) / 5, 6) AS smooth FROM w""",
)
def smooth_rows(t: Tables) -> DataFrame:
    return fr.smooth_rows(I.frames(t), ["stream_id"], "frame", "score").select("stream_id", "frame", "smooth")


_EMB = "e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)"
_SMOOTH = """list_transform(range(0, len(x)), lambda i: (x[greatest(i - 2, 0) + 1] + x[greatest(i - 1, 0) + 1] + x[i + 1]
  + x[least(i + 1, len(x) - 1) + 1] + x[least(i + 2, len(x) - 1) + 1]) / 5)"""


def embedded(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", signals.as_doubles("embedding").alias("x"))


#: Each vector and the one after it, the first after the last.
_NEXT = "nx AS (SELECT vec_id, coalesce(lead(vec_id) OVER (ORDER BY vec_id), min(vec_id) OVER ()) AS next_id FROM embeddings)"


def followed(t: Tables) -> DataFrame:
    """(vec_id, next_id): every vector with the one after it, the last with the first."""
    ids = t.embeddings.select("vec_id")
    rows = ordered(ids, [], ["vec_id"]).scan(next_id=lead("vec_id")).rows()
    return rows.crossJoin(F.broadcast(ids.agg(F.min("vec_id").alias("__first")))).select("vec_id", F.coalesce("next_id", "__first").alias("next_id"))


def exploded(df: DataFrame, array: str, name: str = "v") -> DataFrame:
    """Array as rows (i, value)."""
    return df.select("vec_id", F.posexplode(array).alias("i", name))


@query("f2_smooth_arrays", f"WITH {_EMB}, s AS (SELECT vec_id, {_SMOOTH} AS y FROM e) SELECT vec_id, i - 1 AS i, round(y[i], 6) AS v FROM s, unnest(range(1, len(y) + 1)) u(i)")
def smooth_arrays(t: Tables) -> DataFrame:
    return exploded(embedded(t).select("vec_id", signals.smoothed("x").alias("y")), "y")


@query(
    "f3_region",
    f"WITH {_EMB}, s AS (SELECT vec_id, {_SMOOTH} AS y FROM e) SELECT vec_id, i - 1 AS i, round(CASE WHEN i - 1 BETWEEN 10 AND 50 THEN y[i] ELSE 0 END, 6) AS v FROM s, unnest(range(1, len(y) + 1)) u(i)",
)
def region(t: Tables) -> DataFrame:
    return exploded(embedded(t).select("vec_id", signals.prepared("x", 5, (0.1, 0.5)).alias("y")), "y")


@query(
    "f4_change_time",
    f"WITH {_EMB} SELECT vec_id, list_max(x) > 0.3 AS has, CASE WHEN list_max(x) > 0.3 THEN round((list_position(x, list_max(x)) - 1) * 0.01::DOUBLE, 6) END AS t_change FROM e",
)
def change_time(t: Tables) -> DataFrame:
    return embedded(t).select("vec_id", (F.array_max("x") > 0.3).alias("has"), signals.change_time("x", 0.01, 0.3).alias("t_change"))


@query(
    "f5_local_peaks",
    f"""WITH {I.FRAMES}, m AS (SELECT *, max(score) OVER (PARTITION BY stream_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM frames)
SELECT stream_id, frame, round(score, 6) AS score FROM m WHERE score >= 0.1 AND score >= top""",
)
def local_peaks(t: Tables) -> DataFrame:
    return fr.local_peaks(I.frames(t), ["stream_id"], "frame", "score", 0.1, 3).select("stream_id", "frame", "score")


@query(
    "f5_trusted_peaks",
    f"""WITH {_EMB}, c AS (SELECT vec_id, x, i FROM e, unnest(range(8, least(len(x) - 12, len(x) - 5))) u(i))
SELECT vec_id, i AS frame, round(x[i + 1], 6) AS score FROM c WHERE x[i + 1] >= 0.1 AND x[i + 1] >= list_max(x[i - 4:i + 6])""",
)
def trusted_peaks(t: Tables) -> DataFrame:
    rows = embedded(t).select("vec_id", "x", F.explode(signals.trusted_peaks("x", 0.1, 5, 8, 12)).alias("frame"))
    return rows.select("vec_id", "frame", F.get("x", F.col("frame")).alias("score"))


@query(
    "f6_edge_peaks",
    f"""WITH {_EMB}, c AS (SELECT vec_id, x, i FROM e, unnest(range(0, len(x))) u(i))
SELECT vec_id, i AS frame, round(x[i + 1], 6) AS score FROM c WHERE x[i + 1] >= 0.1 AND x[i + 1] = list_max(x[greatest(i - 6, 0) + 1:i + 7])""",
)
def edge_peaks(t: Tables) -> DataFrame:
    rows = embedded(t).select("vec_id", "x", F.explode(signals.edge_peaks("x", 0.1, 6)).alias("frame"))
    return rows.select("vec_id", "frame", F.get("x", F.col("frame")).alias("score"))


def _keep_sql(test: str, source: str, key: str, value: str, order: str, kind: str = "BIGINT") -> str:
    """Greedy suppression as a fold; the kept values are the list that is built up."""
    return f"""SELECT {key}, unnest(list_reduce(list([{value}] ORDER BY {order}), lambda a, x:
    CASE WHEN len(a) = 0 OR {test} THEN list_concat(a, x) ELSE a END, []::{kind}[])) AS kept FROM {source} GROUP BY {key}"""


_GAP = 6 * HOUR_US


@query(
    "f7_offline_gap",
    f"WITH {I.STREAM}, s AS ({_keep_sql(f'x[1] - a[-1] >= {_GAP}', 'stream', 'stream_id', 'at_us', 'at_us, event_id')}) SELECT stream_id, kept AS at_us FROM s",
)
def offline_gap(t: Tables) -> DataFrame:
    rows = I.stream(t).select("stream_id", "at_us", "event_id")
    return spaced(rows, ["stream_id"], ["at_us", "event_id"], "at_us", _GAP, "offline").select("stream_id", "at_us")


@query(
    "f7_harness_gap",
    f"WITH {I.STREAM}, s AS ({_keep_sql(f'x[1] - a[-1] > {_GAP}', 'stream', 'stream_id', 'at_us', f'at_us // {4 * HOUR_US}, score, event_id')}) SELECT stream_id, kept AS at_us FROM s",
)
def harness_gap(t: Tables) -> DataFrame:
    """One-sided rule in an emission order that is not the time order."""
    rows = I.stream(t).select("stream_id", "at_us", "score", "event_id", F.floor(F.col("at_us") / F.lit(4 * HOUR_US)).alias("batch"))
    return spaced(rows, ["stream_id"], ["batch", "score", "event_id"], "at_us", _GAP, "harness").select("stream_id", "at_us")


@query(
    "f7_live_gap",
    f"WITH {I.STREAM}, s AS ({_keep_sql(f'abs(x[1] - a[-1]) >= {_GAP}', 'stream', 'stream_id', 'at_us', f'at_us // {12 * HOUR_US}, score, event_id')}) SELECT stream_id, kept AS at_us FROM s",
)
def live_gap(t: Tables) -> DataFrame:
    """Two-sided rule against the last kept position, in emission order."""
    rows = I.stream(t).select("stream_id", "at_us", "score", "event_id", F.floor(F.col("at_us") / F.lit(12 * HOUR_US)).alias("batch"))
    return spaced(rows, ["stream_id"], ["batch", "score", "event_id"], "at_us", _GAP, "live").select("stream_id", "at_us")


@query(
    "f8_frame_events",
    f"""WITH {I.STREAM}, a AS (SELECT *, score > 0.05 AS hot, lag(score > 0.05, 1, false) OVER w AS was FROM stream WINDOW w AS (PARTITION BY stream_id ORDER BY at_us)),
r AS (SELECT *, sum((hot AND NOT was)::INT) OVER (PARTITION BY stream_id ORDER BY at_us) AS run FROM a),
p AS (SELECT stream_id, run, arg_min(at_us, (-score, at_us)) AS peak_at FROM r WHERE hot GROUP BY ALL),
s AS ({_keep_sql(f'x[1] - a[-1] >= {12 * HOUR_US}', 'p', 'stream_id', 'peak_at', 'peak_at')}) SELECT stream_id, kept AS peak_at FROM s""",
)
def frame_events(t: Tables) -> DataFrame:
    rows = ordered(I.stream(t), ["stream_id"], ["at_us", "event_id"])
    return fr.frame_events(rows, "score", 0.05, 12 * HOUR_US).select("stream_id", "peak_at")


@query(
    "f9_newest_due",
    f"""WITH {_SLIDING} SELECT stream_id, end_us // {I.DAY_US} AS batch, window_no FROM sliding
QUALIFY row_number() OVER (PARTITION BY stream_id, end_us // {I.DAY_US} ORDER BY window_no DESC) <= 2""",
)
def newest_due(t: Tables) -> DataFrame:
    """Windows that fall due together (here: in one day) beyond the newest two are skipped."""
    due = sliding(t).select("stream_id", "window_no", F.floor(F.col("end_us") / F.lit(I.DAY_US)).alias("batch"))
    return fr.newest_due(due, ["stream_id", "batch"], "window_no", 2)


def _labels_sql(value: str, where: str) -> str:
    return f"""WITH {I.TURNS}, l AS (SELECT *, lag(speaker_id) OVER (PARTITION BY file_id ORDER BY start_s, turn) AS prev FROM turns),
b AS (SELECT file_id, start_s AS cp FROM l WHERE prev <> speaker_id),
n AS (SELECT file_id, round(max(end_s) / 0.01)::BIGINT AS frames FROM turns GROUP BY 1),
f AS (SELECT file_id, cp, i AS frame, i * 0.01::DOUBLE AS t FROM b JOIN n USING (file_id), unnest(range(greatest((cp * 100)::BIGINT - 20, 0), least((cp * 100)::BIGINT + 20, frames))) r(i))
SELECT file_id, frame, round(max({value}), 6) AS label FROM f WHERE {where} GROUP BY ALL"""


@query("f10_soft_labels", _labels_sql("exp(-0.5 * pow((t - cp) / 0.075, 2))", "t >= cp AND t <= cp + 0.15"))
def soft_labels(t: Tables) -> DataFrame:
    return turns.frame_labels(I.turns(t), tie_break="turn")


@query("f11_hard_labels", _labels_sql("1.0::DOUBLE", "abs(t - cp) <= 0.15"))
def hard_labels(t: Tables) -> DataFrame:
    return turns.frame_labels(I.turns(t), shape="hard", tie_break="turn")


@query(
    "f12_window_labels",
    f"""WITH c AS (SELECT event_id, 0.5 + {I.u_sql('7-at', 'event_id')} * 2.0 AS tc FROM events),
f AS (SELECT i * 0.01::DOUBLE AS t FROM range(0, 300) r(i))
SELECT event_id, round(sum(CASE WHEN abs(t - tc) <= 0.15 THEN exp(-0.5 * pow((t - tc) / 0.075, 2)) ELSE 0 END), 6) AS mass,
  round(max(CASE WHEN abs(t - tc) <= 0.15 THEN exp(-0.5 * pow((t - tc) / 0.075, 2)) ELSE 0 END), 6) AS top, count(*) FILTER (t >= tc) AS after
FROM c, f GROUP BY ALL""",
)
def window_labels(t: Tables) -> DataFrame:
    """Symmetric bump and step target of one window per event."""
    rows = t.events.select("event_id", draw.between(0.5, 2.5, "7-at", "event_id").alias("tc"))
    rows = rows.select(
        "event_id", signals.label_frames(F.array("tc"), 3.0, shape="both").alias("label"), signals.step_frames("tc", 3.0).alias("step")
    )
    return rows.select(
        "event_id",
        signals.total_of("label").alias("mass"),
        F.array_max("label").alias("top"),
        signals.total_of("step").cast("long").alias("after"),
    )


def _mean_scorer():
    return lambda batch: np.abs(batch).reshape(len(batch), batch.shape[1] // 4, 4).mean(axis=2)


fr.register_scorer("mean_level", _mean_scorer)


@query(
    "f13_window_scores",
    f"WITH {_EMB} SELECT vec_id, i, round((abs(x[4 * i + 1]) + abs(x[4 * i + 2]) + abs(x[4 * i + 3]) + abs(x[4 * i + 4])) / 4, 6) AS v FROM e, unnest(range(0, len(x) // 4)) u(i)",
)
def window_scores(t: Tables) -> DataFrame:
    """A pluggable scorer over whole windows, in Arrow batches."""
    return exploded(fr.score_windows(embedded(t), "x", "mean_level", 16), "p")


@query("f13_batch_scores", ORACLES["f13_window_scores"])
def batch_scores(t: Tables) -> DataFrame:
    """The same scorer through batch inference on tensors of one shape."""
    return exploded(fr.predicted_windows(embedded(t), "x", "mean_level", 64, 16), "p")


_REPLAY_PEAKS = f"""{_SLIDING}, k AS (SELECT stream_id, window_no, i AS frame, p[i + 1] AS confidence, window_no * 1.0::DOUBLE + i * 0.25::DOUBLE AS at_s
  FROM sliding, unnest(range(0, {SPAN})) u(i) WHERE p[i + 1] >= 0.1 AND p[i + 1] = list_max(p[greatest(i - 3, 0) + 1:i + 4])),
n AS (SELECT stream_id, count(*) * 0.25::DOUBLE AS duration_s FROM frames GROUP BY 1)"""


@query(
    "f14_detector_replay",
    f"""WITH {_REPLAY_PEAKS}, s AS (SELECT stream_id, list_reduce(list([at_s, window_no, confidence] ORDER BY window_no, frame), lambda a, x:
  CASE WHEN len(a) = 0 OR x[1] - a[-3] > 0.75 THEN list_concat(a, x) ELSE a END, []::DOUBLE[]) AS l FROM k GROUP BY stream_id),
r AS (SELECT stream_id, l[3 * j + 1] AS boundary_time_s, l[3 * j + 2] AS window_no, l[3 * j + 3] AS confidence FROM s, unnest(range(0, len(l) // 3)) u(j))
SELECT stream_id, round(least(ceil((window_no + 3.0) / 0.4 - 1e-9) * 0.4::DOUBLE, duration_s), 6) AS emitted_at_s, boundary_time_s, round(confidence, 6) AS confidence FROM r JOIN n USING (stream_id)""",
)
def detector_replay(t: Tables) -> DataFrame:
    """Windows, peaks and one-sided suppression in emission order; emit time on the chunk grid."""
    lengths = I.stream(t).groupBy("stream_id").agg((F.count(F.lit(1)) * 0.25).alias("duration_s"))
    scored = sliding(t).join(lengths, "stream_id")
    return fr.replay_predictions(scored, ["stream_id"], 3.0, 1.0, 0.1, 0.75, 0.4)


def live(t: Tables) -> DataFrame:
    scored = sliding(t).select(
        "stream_id", F.col("window_no").cast("double").alias("win_start_s"), (F.col("window_no") + 3.0).alias("win_end_s"), "p"
    )
    return fr.live_changes(scored, ["stream_id"], 0.08, 5, 0.5, 1.0, 1.0, 0.5, 0.25)


def _live_sql(select: str) -> str:
    smooth = _SMOOTH.replace("len(x)", "len(p)").replace("x[", "p[")
    return f"""WITH {_SLIDING}, sm AS (SELECT stream_id, window_no, {smooth} AS q FROM sliding),
k AS (SELECT stream_id, window_no, i AS frame, q[i + 1] AS prob, window_no * 1.0::DOUBLE + i * 0.25::DOUBLE AS at_s
  FROM sm, unnest(range(2, 8)) u(i) WHERE q[i + 1] >= 0.08 AND q[i + 1] >= list_max(q[i - 1:i + 3])),
s AS (SELECT stream_id, list_reduce(list([at_s, window_no + 3.0] ORDER BY window_no, frame), lambda a, x:
  CASE WHEN len(a) = 0 OR abs(x[1] - a[-2]) >= 1.0 THEN list_concat(a, x) ELSE a END, []::DOUBLE[]) AS l FROM k GROUP BY stream_id),
live AS (SELECT stream_id, l[2 * j + 1] AS time_s, l[2 * j + 2] AS detected_at_s FROM s, unnest(range(0, len(l) // 2)) u(j)) {select}"""


@query("f5_live_changes", _live_sql("SELECT * FROM live"))
def live_changes(t: Tables) -> DataFrame:
    return live(t).drop("prob")


@query(
    "w5_emission_latency",
    _live_sql(
        """SELECT count(*) AS changes, round(avg(detected_at_s - time_s), 6) AS mean_s, round(quantile_cont(detected_at_s - time_s, 0.5), 6) AS p50_s,
  round(quantile_cont(detected_at_s - time_s, 0.95), 6) AS p95_s, round(max(detected_at_s - time_s), 6) AS max_s FROM live"""
    ),
)
def emission_latency(t: Tables) -> DataFrame:
    rows = live(t).select((F.col("detected_at_s") - F.col("time_s")).alias("latency"))
    sums = rows.agg(F.count(F.lit(1)).alias("changes"), F.avg("latency").alias("mean_s"), F.max("latency").alias("max_s"))
    return sums.crossJoin(percentiles(rows, [], "latency", {"p50_s": 0.5, "p95_s": 0.95}))


@query(
    "w4_energy_prefix",
    f"""WITH {_EMB} SELECT vec_id, round(sqrt(list_sum(list_transform(x[9:48], lambda v: v * v)) / 40), 6) AS rms_active FROM e""",
)
def energy_prefix(t: Tables) -> DataFrame:
    """RMS over a sample range: the range is cut first, so only its samples are read."""
    return embedded(t).select("vec_id", signals.rms(F.slice("x", 9, 40)).alias("rms_active"))


_RANGED = "r AS (SELECT k, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS part FROM (SELECT DISTINCT vec_id % 7 AS k FROM embeddings)), q AS (SELECT k, part, (part * part * 37 + k * 11)::BIGINT AS low, (part * part * 37 + k * 11 + part * 90)::BIGINT AS high FROM r)"


@query(
    "w4_range_levels",
    f"""WITH {_EMB}, s AS (SELECT vec_id % 7 AS k, v, row_number() OVER (PARTITION BY vec_id % 7 ORDER BY vec_id, i) - 1 AS pos FROM (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e)), {_RANGED}
SELECT q.k, part, low, high, round(coalesce(sum(v * v), 0), 6)::DOUBLE AS energy, round(sqrt(sum(v * v) / count(v)), 6)::DOUBLE AS rms FROM q LEFT JOIN s ON s.k = q.k AND pos >= low AND pos < high GROUP BY ALL""",
)
def range_levels(t: Tables) -> DataFrame:
    """Eight ranges of each of seven streams of vectors, over block borders, from a table of prefix sums."""
    chunks = embedded(t).withColumn("k", F.col("vec_id") % 7)
    part = F.col("part")
    ranges = chunks.select("k").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(7))))
    low = (part * part * 37 + F.col("k") * 11).cast("long")
    ranges = ranges.select("k", "part", low.alias("low"), (low + part * 90).alias("high"))
    return fr.range_energy(fr.energy_table(chunks, ["k"], ["vec_id"], "x"), ranges, ["k"], "low", "high")
