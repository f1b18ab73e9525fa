"""Signal queries over the embeddings, each taken as one short signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.functions import signals as s
from segflow.plans.registry import Tables, query
from segflow.plans.frame_queries import _EMB, _NEXT, embedded, exploded, followed
from segflow.operators import lines
from segflow.operators.joins import join_small
from segflow.plans import inputs as I

_POWER = "list_sum(list_transform(x, lambda v: v * v)) / len(x)"
_PEAK = "list_max(list_transform(x, lambda v: abs(v)))"
_UNNEST = "SELECT vec_id, i - 1 AS i, round(y[i], 6) + 0.0 AS v FROM y, unnest(range(1, len(y) + 1)) u(i)"


@query("g1_levels", f"WITH {_EMB} SELECT vec_id, round(sqrt({_POWER}), 6) AS rms, round(20 * log10(sqrt({_POWER}) + 1e-9), 6) AS level_db, round({_PEAK}, 6) AS peak FROM e")
def levels(t: Tables) -> DataFrame:
    return embedded(t).select("vec_id", s.rms("x").alias("rms"), s.level_db("x").alias("level_db"), s.peak("x").alias("peak"))


@query(
    "g2_normalised",
    f"""WITH {_EMB}, g AS (SELECT vec_id, x, pow(10, (-23 - 20 * log10(sqrt({_POWER}) + 1e-9)) / 20) AS gain FROM e),
y AS (SELECT vec_id, list_transform(x, lambda v: v * gain) AS y FROM g) {_UNNEST}""",
)
def normalised(t: Tables) -> DataFrame:
    return exploded(embedded(t).select("vec_id", s.normalised("x").alias("y")), "y")


@query(
    "g2_jittered_level",
    f"""WITH {_EMB}, j AS (SELECT vec_id, x, -23 - 4 + 8 * {I.u_sql('42-level', 'vec_id')} AS target FROM e),
g AS (SELECT vec_id, target, x, pow(10, (target - 20 * log10(sqrt({_POWER}) + 1e-9)) / 20) AS gain FROM j)
SELECT vec_id, round(target, 6)::DOUBLE AS target_db, round(gain * sqrt({_POWER}), 6) AS rms FROM g""",
)
def jittered_level(t: Tables) -> DataFrame:
    """Loudness with a seeded jitter of 4 dB either way."""
    from segflow.functions import draw

    target = F.lit(-23.0) + draw.between(-4.0, 4.0, "42-level", "vec_id")
    rows = embedded(t).withColumn("target_db", target)
    return rows.select("vec_id", "target_db", s.rms(s.normalised("x", F.col("target_db"))).alias("rms"))


@query(
    "g3_peak_limited",
    f"""WITH {_EMB}, l AS (SELECT vec_id, list_transform(x, lambda v: v * 4) AS x FROM e), p AS (SELECT vec_id, x, {_PEAK} AS top FROM l),
y AS (SELECT vec_id, CASE WHEN top > 0.99 THEN list_transform(x, lambda v: v / top * 0.99) ELSE x END AS y FROM p) {_UNNEST}""",
)
def peak_limited(t: Tables) -> DataFrame:
    return exploded(embedded(t).select("vec_id", s.peak_limited(s.scaled("x", F.lit(4.0))).alias("y")), "y")


@query(
    "g4_active_ratio",
    f"""WITH {_EMB}, m AS (SELECT vec_id, list_transform(range(0, len(x) // 8), lambda i: list_sum(list_transform(x[8 * i + 1:8 * i + 8], lambda v: pow(v, 6))) / 8) AS m FROM e)
SELECT vec_id, round(len(list_filter(m, lambda v: v > greatest(0.01 * list_sort(m)[least(len(m) - 1, floor(0.95 * len(m))::INT) + 1], 1e-10))) / len(m), 6) AS ratio FROM m""",
)
def active_ratio(t: Tables) -> DataFrame:
    """Active share of 8-sample frames; the samples are cubed to have quiet frames."""
    cubed = F.transform("x", lambda v: v * v * v)
    return embedded(t).select("vec_id", s.active_ratio(cubed, 8).alias("ratio"))


@query(
    "g6_faded",
    f"""WITH {_EMB}, y AS (SELECT vec_id, list_transform(range(0, len(x)), lambda i: x[i + 1] * CASE WHEN i < 10 THEN i / 9 ELSE 1 END
  * CASE WHEN i >= len(x) - 12 THEN 1 - (i - (len(x) - 12)) / 11 ELSE 1 END) AS y FROM e) {_UNNEST}""",
)
def faded(t: Tables) -> DataFrame:
    return exploded(embedded(t).select("vec_id", s.faded(s.faded("x", 10, False), 12, True).alias("y")), "y")


@query(
    "g7_noise_mix",
    f"""WITH {_EMB}, {_NEXT}, p AS (SELECT a.vec_id, list_concat(a.x, a.x) AS x, list_transform(range(0, 2 * len(a.x)), lambda i: b.x[i % len(b.x) + 1]) AS n FROM e a JOIN nx USING (vec_id) JOIN e b ON b.vec_id = next_id),
q AS (SELECT *, {_POWER} AS loud, {_POWER.replace('x,', 'n,').replace('(x)', '(n)')} AS hum FROM p),
y AS (SELECT vec_id, CASE WHEN loud < 1e-9 OR hum < 1e-9 THEN x ELSE list_transform(range(1, len(x) + 1), lambda i: x[i] + n[i] * sqrt(loud / pow(10, 1.5) / hum)) END AS y FROM q) {_UNNEST}""",
)
def noise_mix(t: Tables) -> DataFrame:
    """Each signal, played twice, with the next one (tiled to its length) as noise at 15 dB."""
    noise = embedded(t).select(F.col("vec_id").alias("next_id"), F.col("x").alias("n"))
    both = embedded(t).withColumn("x", F.concat("x", "x")).join(followed(t), "vec_id").join(noise, "next_id").withColumn("n", s.tiled("n", F.size("x")))
    return exploded(both.select("vec_id", s.mixed("x", "n", 15.0).alias("y")), "y")


@query(
    "g8_two_segments",
    f"""WITH {_EMB}, {_NEXT}, c AS (SELECT a.vec_id, list_transform(range(0, 124), lambda i: CASE WHEN i < 64 THEN a.x[i + 1] ELSE 0 END + CASE WHEN i >= 60 THEN b.x[i - 60 + 1] ELSE 0 END) AS x
  FROM e a JOIN nx USING (vec_id) JOIN e b ON b.vec_id = next_id), p AS (SELECT vec_id, x, {_PEAK} AS top FROM c),
y AS (SELECT vec_id, CASE WHEN top > 0.99 THEN list_transform(x, lambda v: v / top * 0.99) ELSE x END AS y FROM p) {_UNNEST}""",
)
def two_segments(t: Tables) -> DataFrame:
    """A from sample 0, B from sample 60, overlapping by four samples."""
    b = embedded(t).select(F.col("vec_id").alias("next_id"), F.col("x").alias("b"))
    both = embedded(t).select("vec_id", F.col("x").alias("a")).join(followed(t), "vec_id").join(b, "next_id")
    return exploded(both.select("vec_id", s.assembled("a", "b", 60, 124).alias("y")), "y")


@query("p5_quality_gate", f"WITH {_EMB} SELECT vec_id, round(sqrt({_POWER}) * 80, 6) AS rms FROM e WHERE sqrt({_POWER}) * 80 >= 10 AND sqrt(list_sum(list_transform(x, lambda v: v * v))) >= 1e-6")
def quality_gate(t: Tables) -> DataFrame:
    """Signals with enough level and energy (scaled so that the limit of 10 counts bites)."""
    rows = embedded(t).withColumn("rms", s.rms("x") * 80)
    return rows.where((F.col("rms") >= 10) & (F.sqrt(s.energy("x")) >= 1e-6)).select("vec_id", "rms")


@query(
    "g11_chunk_windows",
    f"""WITH {I.STREAM}, c AS (SELECT stream_id, event_id, at_us, (value * 10)::BIGINT AS n FROM stream),
u AS (SELECT *, sum(n) OVER (PARTITION BY stream_id ORDER BY at_us, event_id)::BIGINT AS upto, sum(n) OVER (PARTITION BY stream_id)::BIGINT AS total FROM c),
p AS (SELECT *, upto - n AS begun FROM u WHERE n > 0)
SELECT stream_id, event_id, w AS window_no, greatest(w * 512, begun) - begun AS from_sample, least(w * 512 + 512, upto) - begun AS to_sample
FROM p, unnest(range(begun // 512, (upto - 1) // 512 + 1)) q(w) WHERE (w + 1) * 512 <= total""",
)
def chunk_windows(t: Tables) -> DataFrame:
    """Chunks of any length regrouped into exact 512-sample windows with carry-over."""
    chunks = I.stream(t).select("stream_id", "event_id", "at_us", F.rint(F.col("value") * 10).cast("long").alias("n"))
    return lines.chunk_windows(chunks, ["stream_id"], ["at_us", "event_id"], "n").select(
        "stream_id", "event_id", "window_no", "from_sample", "to_sample"
    )


@query("j8_bank_lookup", f"WITH {_EMB}, b AS (SELECT vec_id AS rir, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS level FROM e) SELECT e.vec_id, b.rir IS NOT NULL AS wet, round(coalesce(level, 0), 6) AS level FROM e LEFT JOIN b ON b.rir = CASE WHEN e.vec_id % 3 = 0 THEN -1 ELSE e.vec_id - 1 END")
def bank_lookup(t: Tables) -> DataFrame:
    """Bank rows by id, here the vector before; -1 means none."""
    bank = embedded(t).select(F.col("vec_id").alias("rir"), s.rms("x").alias("level"))
    rows = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 3 == 0, -1).otherwise(F.col("vec_id") - 1).alias("rir"))
    return join_small(rows, bank, ["rir"], "left").select("vec_id", F.col("level").isNotNull().alias("wet"), F.coalesce("level", F.lit(0.0)).alias("level"))


@query(
    "f1_audio_windows",
    f"""WITH {_EMB}, s AS (SELECT vec_id % 10 AS stream_id, flatten(list(x ORDER BY vec_id)) AS w FROM e GROUP BY 1)
SELECT stream_id, i AS window_no, i * 40 AS "start", round(list_sum(list_transform(w[40 * i + 1:40 * i + 160], lambda v: v * v)), 6) AS energy, round(w[40 * i + 1], 6) AS first, round(w[40 * i + 160], 6) AS last
FROM s, unnest(range(0, (len(w) - 160) // 40 + 1)) u(i)""",
)
def audio_windows(t: Tables) -> DataFrame:
    """Overlapping sample windows over a stream of chunk arrays (here: embeddings in id order)."""
    chunks = embedded(t).withColumn("stream_id", F.col("vec_id") % 10)
    found = lines.audio_windows(chunks, ["stream_id"], ["vec_id"], "x", 160, 40)
    return found.select(
        "stream_id", "window_no", "start", s.energy("wave").alias("energy"), F.get("wave", F.lit(0)).alias("first"), F.get("wave", F.lit(159)).alias("last")
    )
