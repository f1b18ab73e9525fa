"""Split, pool, schedule and window-specification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.functions import draw
from segflow.operators import checks, splits, windows
from segflow.operators.joins import join_small, with_default
from segflow.operators.ordered import number, ordered
from segflow.plans import inputs as I
from segflow.plans.frame_queries import _NEXT, followed
from segflow.plans.inputs import RATE, u_sql
from segflow.plans.registry import Tables, query
from segflow.session import stable

# Clip limits in samples.
MIN_CLIP, MAX_CLIP, PER_SPEAKER = int(3.5 * RATE), 10 * RATE, 20


def _bits(seed: int | str, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


@query("p2_minimum_length", f"WITH {I.CLIPS} SELECT * FROM clips WHERE frames >= 1.2 * {RATE}")
def minimum_length(t: Tables) -> DataFrame:
    return I.clips(t).where(F.col("frames") >= 1.2 * RATE)


_CROP = f"""{I.CLIPS}, crops AS (SELECT clip_id, speaker_id, category, frames,
  CASE WHEN frames > {MAX_CLIP} THEN floor({u_sql(42, 'clip_id')} * (frames - {MAX_CLIP} + 1))::BIGINT ELSE 0 END AS crop_start,
  least(frames, {MAX_CLIP}) AS crop_len FROM clips WHERE frames >= {MIN_CLIP})"""


@query("p3_crop_long_clips", f"WITH {_CROP} SELECT clip_id, frames, crop_start, crop_len FROM crops")
def crop_long_clips(t: Tables) -> DataFrame:
    clips = I.clips(t).where(F.col("frames") >= MIN_CLIP)
    return splits.cropped(clips, "clip_id", "frames", MAX_CLIP).select("clip_id", "frames", "crop_start", "crop_len")


@query(
    "p4_first_files",
    f"""WITH {I.TURNS}, f AS (SELECT file_id, min(file_id * 1000 + turn) AS first FROM turns GROUP BY 1 ORDER BY first LIMIT 25)
SELECT file_id, turn, speaker_id FROM turns SEMI JOIN f USING (file_id)""",
)
def first_files(t: Tables) -> DataFrame:
    """Turns of the first 25 files in manifest order (the limit is the feature)."""
    rows = I.turns(t).withColumn("row_no", F.col("file_id") * 1000 + F.col("turn"))
    return splits.first_files(rows, "row_no", 25).select("file_id", "turn", "speaker_id")


@query("p4_single_file", f"WITH {I.TURNS} SELECT file_id, turn, speaker_id FROM turns WHERE file_id = 7")
def single_file(t: Tables) -> DataFrame:
    return I.turns(t).where("file_id = 7").select("file_id", "turn", "speaker_id")


_DIM = "genders AS (SELECT 'src' || s_suppkey % 15 AS speaker_id, CASE WHEN min(s_suppkey) % 2 = 0 THEN 'M' ELSE 'F' END AS gender FROM supplier GROUP BY 1)"


def genders(t: Tables) -> DataFrame:
    """A speaker dimension that covers only part of the speakers."""
    name = F.concat(F.lit("src"), (F.col("s_suppkey") % 15).cast("string")).alias("speaker_id")
    return t.supplier.groupBy(name).agg(F.when(F.min("s_suppkey") % 2 == 0, "M").otherwise("F").alias("gender"))


@query("j1_speaker_gender", f"WITH {I.CLIPS}, {_DIM} SELECT clip_id, speaker_id, coalesce(gender, 'U') AS gender FROM clips LEFT JOIN genders USING (speaker_id)")
def speaker_gender(t: Tables) -> DataFrame:
    return with_default(I.clips(t), genders(t), "speaker_id", "gender", "U").select("clip_id", "speaker_id", "gender")


_SPLIT = f"""ids AS (SELECT DISTINCT c_custkey FROM customer),
r AS (SELECT c_custkey, row_number() OVER (ORDER BY {_bits(42, 'c_custkey')}, c_custkey) - 1 AS pos, (SELECT count(*) FROM ids) AS n FROM ids),
split AS (SELECT c_custkey, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r)"""


@query("u1_entity_split", f"WITH {_SPLIT} SELECT * FROM split")
def entity_split(t: Tables) -> DataFrame:
    return splits.entity_split(t.customer, "c_custkey")


@query(
    "u1_threshold_split",
    f"""SELECT o_orderkey, CASE WHEN {u_sql(42, 'o_custkey')} < 0.7 THEN 'train' WHEN {u_sql(42, 'o_custkey')} < 0.85 THEN 'val' ELSE 'test' END AS split FROM orders""",
)
def threshold_split(t: Tables) -> DataFrame:
    """Orders split by their customer: an entity never straddles splits, and nothing is shuffled."""
    return splits.threshold_split(t.orders.select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "split")


@query(
    "j5_straddling_entities",
    f"""WITH m AS (SELECT c_custkey AS id, c_nationkey % 3 AS split FROM customer UNION ALL SELECT o_custkey, o_orderkey % 2 FROM orders)
SELECT id, count(DISTINCT split) AS splits FROM m GROUP BY id HAVING count(DISTINCT split) > 1""",
)
def straddling_entities(t: Tables) -> DataFrame:
    """Ids found in more than one split, for a membership that does leak."""
    a = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).cast("long").alias("split"))
    b = t.orders.select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 2).alias("split"))
    return checks.straddling(a.unionByName(b), "id")


@query("j5_disjoint_splits", f"WITH {_SPLIT} SELECT c_custkey, count(DISTINCT split) AS splits FROM split GROUP BY 1 HAVING count(DISTINCT split) > 1")
def disjoint_splits(t: Tables) -> DataFrame:
    """The same check over the entity split: no rows."""
    return checks.straddling(entity_split(t), "c_custkey")


@query("j6_speaker_pairs", "SELECT a.n_nationkey::BIGINT AS speaker_a, b.n_nationkey::BIGINT AS speaker_b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def speaker_pairs(t: Tables) -> DataFrame:
    return splits.unordered_pairs(t.nation, "n_nationkey")


_PAIRS = f"""pairs AS (SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey),
numbered AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS k FROM pairs),
ranked AS (SELECT a, b, p AS pair_no FROM range(0, 300) r(p) JOIN numbered ON k = (p * 262229 + 42) % 300),
schedule AS (SELECT s_suppkey AS job, pair_no, CASE WHEN {u_sql('42-flip', 's_suppkey')} < 0.5 THEN b ELSE a END AS speaker_a,
  CASE WHEN {u_sql('42-flip', 's_suppkey')} < 0.5 THEN a ELSE b END AS speaker_b
  FROM supplier JOIN ranked ON s_suppkey % (SELECT count(*) FROM pairs) = pair_no)"""


def schedule(t: Tables) -> DataFrame:
    jobs = t.supplier.select(F.col("s_suppkey").alias("job"))
    ids = t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    return splits.pair_schedule(ids, "n_nationkey", jobs, "job").select("job", "pair_no", "speaker_a", "speaker_b")


@query("u5_pair_schedule", f"WITH {_PAIRS} SELECT * FROM schedule")
def pair_schedule(t: Tables) -> DataFrame:
    return schedule(t)


@query(
    "w6_clip_cursors",
    f"""WITH {_PAIRS}, uses AS (SELECT job, 0 AS side, speaker_a AS speaker FROM schedule UNION ALL SELECT job, 1, speaker_b FROM schedule)
SELECT job, side::BIGINT AS side, speaker, 2 * (row_number() OVER (PARTITION BY speaker ORDER BY job, side) - 1) AS cursor FROM uses""",
)
def clip_cursors(t: Tables) -> DataFrame:
    return splits.clip_cursors(schedule(t), "job")


_GAP_LIST = "[" + ", ".join(f"{g}::DOUBLE" for g in splits.GAPS) + "]"


@query(
    "u6_position_grid",
    f"""WITH j AS (SELECT s_suppkey AS job, p AS position FROM supplier, range(0, 3) r(p)),
d AS (SELECT *, {u_sql(42, "job || ':' || position")} AS u, {u_sql('42-gap', "job || ':' || position")} AS g, {u_sql('42-noise', "job || ':' || position")} AS n FROM j)
SELECT job, position, round(least(greatest(1.0 + position * 0.5 - 0.15 + u * 0.3::DOUBLE, 1.0), 2.0), 6) AS change_time_s,
  {_GAP_LIST}[floor(g * 7)::INT + 1] AS gap_s, CASE WHEN n < 0.5 THEN 'zero' WHEN n < 0.75 THEN 'mild' ELSE 'moderate' END AS noise_level FROM d""",
)
def position_grid(t: Tables) -> DataFrame:
    """Change times, gaps (seven choices) and noise levels (weights 2:1:1) of every job."""
    return splits.position_grid(t.supplier.select(F.col("s_suppkey").alias("job")), "job")


@query(
    "u7_weighted_choice",
    f"""SELECT event_id, CASE WHEN {u_sql(9, 'event_id')} < 0.5 THEN 'zero' WHEN {u_sql(9, 'event_id')} < 0.75 THEN 'mild' ELSE 'moderate' END AS noise_level,
  {_GAP_LIST}[floor({u_sql('9-gap', 'event_id')} * 7)::INT + 1] AS gap_s FROM events""",
)
def weighted_choice(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        draw.weighted(splits.NOISE_LEVELS, splits.NOISE_WEIGHTS, 9, "event_id").alias("noise_level"),
        draw.choice(splits.GAPS, "9-gap", "event_id").alias("gap_s"),
    )


@query(
    "u2_seeded_draws",
    f"""SELECT event_id, {_bits(42, 'event_id')} AS bits, round({u_sql(42, 'event_id')}, 6) AS u, floor({u_sql(42, 'event_id')} * 10)::BIGINT AS below_ten,
  {u_sql(42, 'event_id')} < 0.3 AS chance, ['a', 'b', 'c'][floor({u_sql(42, 'event_id')} * 3)::INT + 1] AS pick FROM events""",
)
def seeded_draws(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        draw.bits(42, "event_id").alias("bits"),
        draw.uniform(42, "event_id").alias("u"),
        draw.integer(10, 42, "event_id").alias("below_ten"),
        draw.chance(0.3, 42, "event_id").alias("chance"),
        draw.choice(["a", "b", "c"], 42, "event_id").alias("pick"),
    )


_HELD = f"""g AS (SELECT DISTINCT p_type, p_brand FROM part),
gr AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY {_bits(42, "p_type || ':' || p_brand")}, p_brand) AS pos, count(*) OVER (PARTITION BY p_type) AS n FROM g),
held AS (SELECT p_partkey, p_type, p_brand, CASE WHEN pos <= greatest(1, floor(n * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM part JOIN gr USING (p_type, p_brand))"""


@query(
    "u3_group_holdout",
    f"""WITH {_HELD} SELECT p_partkey, p_type, p_brand, split FROM held
QUALIFY row_number() OVER (PARTITION BY p_type, split ORDER BY ('0x' || substr(md5('42-' || split || ':' || p_partkey), 1, 8))::BIGINT, p_partkey) <= CASE split WHEN 'train' THEN 250 ELSE 12 END""",
)
def group_holdout(t: Tables) -> DataFrame:
    """Brands held out per part type (one in ten, at least one), items then capped at a quarter of the targets."""
    items = t.part.select("p_partkey", "p_type", "p_brand")
    held = splits.group_holdout(items, "p_type", "p_brand", "p_partkey", caps={"train": 1000 // 4, "val": 50 // 4})
    return held.select("p_partkey", "p_type", "p_brand", "split")


@query(
    "u4_file_holdout",
    f"""WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY {_bits(42, "p_type || ':' || p_partkey")}, p_partkey) AS pos,
  count(*) OVER (PARTITION BY p_type) AS n FROM part)
SELECT p_partkey, p_type, CASE WHEN pos <= greatest(1, floor(n * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM r""",
)
def file_holdout(t: Tables) -> DataFrame:
    return splits.file_holdout(t.part.select("p_partkey", "p_type"), "p_type", "p_partkey")


@query(
    "u9_negative_count",
    """SELECT c_nationkey::BIGINT AS nation, count(*) * 3 AS positives, round_even(count(*) * 3 * 0.4::DOUBLE / 0.6::DOUBLE, 0)::BIGINT AS negatives FROM customer GROUP BY 1""",
)
def negative_count(t: Tables) -> DataFrame:
    """Negatives per group for a wanted share of positives (0.6)."""
    counts = t.customer.groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg((F.count(F.lit(1)) * 3).alias("positives"))
    return counts.withColumn("negatives", splits.negative_count(F.col("positives"), 0.6))


@query(
    "u9_negative_speakers",
    """WITH s AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation)
SELECT c_custkey AS job, n_nationkey::BIGINT AS speaker FROM customer JOIN s ON c_custkey % (SELECT count(*) FROM nation) = pos""",
)
def negative_speakers(t: Tables) -> DataFrame:
    """Speakers cycled in sorted order over the no-change jobs."""
    from segflow.operators.ordered import number, ordered

    speakers = ordered(t.nation.select("n_nationkey"), [], ["n_nationkey"]).scan(at=number()).rows()
    speakers = speakers.select((F.col("at") - 1).alias("at"), F.col("n_nationkey").cast("long").alias("speaker"))
    jobs = t.customer.select(F.col("c_custkey").alias("job"), (F.col("c_custkey") % t.nation.count()).alias("at"))
    return join_small(jobs, speakers, ["at"]).drop("at")


_CAPPED = f"""capped AS (SELECT clip_id, speaker_id, category, frames FROM clips WHERE frames >= {MIN_CLIP}
  QUALIFY row_number() OVER (PARTITION BY speaker_id ORDER BY {_bits(42, 'clip_id')}, clip_id) <= {PER_SPEAKER})"""


def capped(t: Tables) -> DataFrame:
    clips = I.clips(t).where(F.col("frames") >= MIN_CLIP)
    return splits.capped_clips(clips, "speaker_id", "clip_id", PER_SPEAKER)


@query("w2_capped_clips", f"WITH {I.CLIPS}, {_CAPPED} SELECT clip_id, speaker_id, frames FROM capped")
def capped_clips(t: Tables) -> DataFrame:
    """At most 20 clips per speaker in seeded order (the cap is the feature)."""
    return capped(t).select("clip_id", "speaker_id", "frames")


@query(
    "w2_first_speakers",
    f"""WITH {I.CLIPS}, s AS (SELECT DISTINCT speaker_id FROM clips ORDER BY 1 LIMIT 7)
SELECT clip_id, speaker_id FROM clips SEMI JOIN s USING (speaker_id) QUALIFY row_number() OVER (PARTITION BY speaker_id ORDER BY {_bits(42, 'clip_id')}, clip_id) <= 10""",
)
def first_speakers(t: Tables) -> DataFrame:
    return splits.capped_clips(I.clips(t), "speaker_id", "clip_id", 10, first_speakers=7).select("clip_id", "speaker_id")


_OFFSETS = f"""offsets AS (SELECT clip_id, speaker_id, crop_len, sum(crop_len) OVER (ORDER BY speaker_id, clip_id)::BIGINT - crop_len AS clip_start FROM crops)"""


def offsets(t: Tables) -> DataFrame:
    clips = splits.cropped(I.clips(t).where(F.col("frames") >= MIN_CLIP), "clip_id", "frames", MAX_CLIP)
    return splits.running_offsets(clips.select("clip_id", "speaker_id", "crop_len"), ["speaker_id", "clip_id"], "crop_len")


@query("w3_running_offsets", f"WITH {_CROP}, {_OFFSETS} SELECT clip_id, speaker_id, crop_len, clip_start FROM offsets")
def running_offsets(t: Tables) -> DataFrame:
    return offsets(t)


@query(
    "a21_pool_summary",
    f"""WITH {I.CLIPS} SELECT category, count(DISTINCT speaker_id) AS speakers, count(*) AS clips, sum(frames)::BIGINT AS samples, round(sum(frames) / ({RATE} * 3600.0::DOUBLE), 3) AS hours FROM clips GROUP BY 1""",
)
def pool_summary(t: Tables) -> DataFrame:
    return checks.pool_summary(I.clips(t), ["category"], "speaker_id", "frames")


@query(
    "a22_length_histogram",
    f"""WITH {I.CLIPS}, b(lo, hi) AS (VALUES (0.0, 2.0), (2.0, 3.0), (3.0, 3.5), (3.5, 5.0), (5.0, 10.0), (10.0, 15.0), (15.0, 30.0))
SELECT lo::DOUBLE AS lo, hi::DOUBLE AS hi, count(clip_id) AS clips FROM b LEFT JOIN clips ON frames / {RATE} >= lo AND (frames / {RATE} < hi OR (hi = 30 AND frames / {RATE} = 30)) GROUP BY ALL""",
)
def length_histogram(t: Tables) -> DataFrame:
    return checks.length_histogram(I.clips(t), F.col("frames") / RATE)


@query(
    "a22_short_share",
    f"WITH {I.CLIPS} SELECT count(*) AS clips, count(*) FILTER (frames / {RATE} < 3.0) AS short, round(avg((frames / {RATE} < 3.0)::INT), 6) AS share FROM clips",
)
def short_share(t: Tables) -> DataFrame:
    return checks.short_share(I.clips(t), F.col("frames") / RATE)


@query(
    "a23_speaker_coverage",
    f"""WITH {I.CLIPS} SELECT speaker_id || '-' || category AS speaker, max(frames) AS longest, count(*) AS clips, max(frames) < 3.0 * {RATE} AS no_window, max(frames) < 3.5 * {RATE} AS needs_stitching FROM clips GROUP BY 1""",
)
def speaker_coverage(t: Tables) -> DataFrame:
    clips = I.clips(t).select(F.concat_ws("-", "speaker_id", "category").alias("speaker"), "frames")
    return checks.speaker_coverage(clips, "speaker", "frames")


@query(
    "a24_bound_violations",
    f"""WITH {_CROP}, {_OFFSETS}, p AS (SELECT sum(crop_len)::BIGINT - 1 AS size FROM crops)
SELECT count(*) AS clips, count(*) FILTER (clip_start + crop_len > size) AS violations FROM offsets, p""",
)
def bound_violations(t: Tables) -> DataFrame:
    """Bounds check against a pool that is one sample short: exactly the last clip fails."""
    index = offsets(t)
    clips = I.clips(t).where(F.col("frames") >= MIN_CLIP)
    size = clips.agg((F.sum(F.least("frames", F.lit(MAX_CLIP))) - 1).alias("size"))
    return checks.bound_violations(index, "clip_start", "crop_len", size, "size")


@query(
    "a24_spot_check",
    f"""SELECT vec_id, len(embedding) = 64 AS length_ok, list_max(list_transform(embedding, lambda v: abs(v))) > 0 AS audible
FROM embeddings ORDER BY {_bits(42, 'vec_id')}, vec_id LIMIT 20""",
)
def spot_check(t: Tables) -> DataFrame:
    """Twenty seeded clips (the limit is the feature)."""
    return checks.spot_check(t.embeddings, "vec_id", "embedding", F.lit(64))


@query(
    "a25_class_weight",
    f"""WITH c AS (SELECT event_id, 0.5 + {u_sql('7-at', 'event_id')} * 2.0 AS tc FROM events), f AS (SELECT i * 0.01::DOUBLE AS t FROM range(0, 300) r(i)),
m AS (SELECT event_id, sum(CASE WHEN abs(t - tc) <= 0.15 THEN exp(-0.5 * pow((t - tc) / 0.075, 2)) ELSE 0 END) AS m FROM c, f GROUP BY 1),
r AS (SELECT avg(m) AS m, (300 - 0.4 * avg(m)) / (0.4 * avg(m)) AS ratio FROM m)
SELECT round(m, 6) AS soft_frames, 1.0::DOUBLE AS one, round(sqrt(ratio), 6) AS sqrt, round(ratio, 6) AS "full" FROM r""",
)
def class_weight(t: Tables) -> DataFrame:
    """Class weight over the change positions of the windows drawn for the events."""
    positions = t.events.select(draw.between(0.5, 2.5, "7-at", "event_id").alias("tc"))
    return checks.class_weight(positions, "tc")


# -- windows -------------------------------------------------------------------------

SPEAKERS, RESPONSES = 100, 40
_u = lambda name: u_sql(f"42-{name}", "event_id")

_SPECS = f"""draws AS (SELECT event_id AS spec_id, {_u('kind')} AS k, {_u('a')} AS a, {_u('at')} AS pos, {_u('gap')} AS g, {_u('p_speed')} AS ps, {_u('speed')} AS sp,
  {_u('p_reverb')} AS pr, {_u('p_noise')} AS pn, {_u('same_reverb')} AS sr, {_u('rir_a')} AS ra, {_u('rir_b')} AS rb, {_u('wet')} AS w, {_u('noise')} AS nk, {_u('snr')} AS snr,
  {_u('level_a')} AS la, {_u('level_b')} AS lb, {_u('fade_a')} AS fa, {_u('fade_b')} AS fb FROM events),
kinded AS (SELECT *, CASE WHEN k < 0.4 THEN 'change' WHEN k < 0.8 THEN 'fake' ELSE 'nochange' END AS kind, pr < 0.5 AS reverb FROM draws),
specs AS (SELECT spec_id, kind, floor(a * {SPEAKERS})::BIGINT AS spk_a, CASE WHEN kind <> 'nochange' THEN 0.5 + pos * 2.0 END AS at_s,
  CASE WHEN kind = 'nochange' THEN 0.0 ELSE {_GAP_LIST}[floor(g * 7)::INT + 1] END AS gap,
  CASE WHEN ps < 0.5 THEN [0.9::DOUBLE, 1.1::DOUBLE][floor(sp * 2)::INT + 1] ELSE 1.0 END AS speed, reverb,
  kind <> 'nochange' AND reverb AND sr < 0.5 AS rir_same, CASE WHEN reverb THEN floor(ra * {RESPONSES})::BIGINT ELSE -1 END AS rir_a,
  CASE WHEN kind = 'change' THEN 0.5 + pos * 2.0 END AS t_change,
  CASE WHEN kind = 'nochange' OR NOT reverb THEN -1 WHEN sr < 0.5 THEN floor(ra * {RESPONSES})::BIGINT ELSE floor(rb * {RESPONSES})::BIGINT END AS rir_b,
  CASE WHEN reverb THEN 0.2 + w * (0.6::DOUBLE - 0.2::DOUBLE) ELSE 0 END AS wet, CASE WHEN pn < 0.5 THEN ['music', 'noise'][floor(nk * 2)::INT + 1] ELSE 'none' END AS noise_kind,
  CASE WHEN pn < 0.5 THEN 10 + snr * 18 END AS snr_db, -23 + -4 + la * 8 AS level_a_db, -23 + -4 + lb * 8 AS level_b_db,
  CASE WHEN kind = 'nochange' THEN 0 ELSE floor((5 + fa * 20) * 16)::BIGINT END AS fade_a, CASE WHEN kind = 'nochange' THEN 0 ELSE floor((5 + fb * 20) * 16)::BIGINT END AS fade_b
  FROM kinded)"""


def specs(t: Tables, recipe: windows.Recipe = windows.Recipe(), responses: int = RESPONSES) -> DataFrame:
    """One window specification per event."""
    return windows.window_specs(t.events.select("event_id"), "event_id", SPEAKERS, responses, recipe)


@query(
    "u8_window_specs",
    f"""WITH {_SPECS} SELECT spec_id, kind, spk_a, round(at_s, 6)::DOUBLE AS at_s, gap, speed, reverb, rir_same, rir_a, round(t_change, 6)::DOUBLE AS t_change, rir_b, round(wet, 6) AS wet,
  noise_kind, round(snr_db, 6)::DOUBLE AS snr_db, round(level_a_db, 6)::DOUBLE AS level_a_db, round(level_b_db, 6)::DOUBLE AS level_b_db, fade_a, fade_b FROM specs""",
)
def window_specs(t: Tables) -> DataFrame:
    return specs(t)


@query("u8_kind_mix", f"WITH {_SPECS} SELECT kind, reverb, noise_kind, count(*) AS windows, round(avg(snr_db), 6)::DOUBLE AS mean_snr_db FROM specs GROUP BY ALL")
def kind_mix(t: Tables) -> DataFrame:
    return specs(t).groupBy("kind", "reverb", "noise_kind").agg(F.count(F.lit(1)).alias("windows"), F.avg("snr_db").alias("mean_snr_db"))


_GROUPED = f"""spk AS (SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS spk,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS in_group, count(*) OVER (PARTITION BY s_nationkey) AS group_size, count(*) OVER () AS n FROM supplier)"""


def speakers(t: Tables) -> DataFrame:
    return windows.indexed_speakers(t.supplier, "s_suppkey", "s_nationkey")


_PARTNER = f"""asked AS (SELECT event_id AS spec_id, floor({_u('a')} * (SELECT count(*) FROM supplier))::BIGINT AS spk_a, CASE WHEN {_u('kind')} < 0.4 THEN 'change' ELSE 'other' END AS kind,
  {_u('partner_in')} AS pi, {_u('partner_any')} AS pa, {_u('same_group')} AS sg FROM events),
own AS (SELECT asked.*, s_nationkey, in_group, group_size, n, group_size > 1 AND sg < 0.5 AS near,
  floor(pi * (group_size - 1))::BIGINT AS i0, floor(pa * (n - 1))::BIGINT AS a0 FROM asked JOIN spk ON spk.spk = spk_a),
partnered AS (SELECT spec_id, spk_a, kind, near, CASE WHEN kind <> 'change' THEN spk_a
  WHEN near THEN (SELECT x.spk FROM spk x WHERE x.s_nationkey = own.s_nationkey AND x.in_group = i0 + (i0 >= own.in_group)::INT) ELSE a0 + (a0 >= spk_a)::INT END AS spk_b FROM own)"""


@query("j7_partner_lookup", f"WITH {_GROUPED}, {_PARTNER} SELECT spec_id, spk_a, spk_b::BIGINT AS spk_b FROM partnered")
def partner_lookup(t: Tables) -> DataFrame:
    """Same-group partner with probability one half, else anyone else; fake and no-change keep their speaker."""
    n = t.supplier.count()
    asked = windows.window_specs(t.events.select("event_id"), "event_id", n, RESPONSES)
    return windows.with_partner(asked, speakers(t), "s_nationkey", n).select("spec_id", "spk_a", "spk_b")


# Embeddings as clips: 40 samples per second; every other clip is a vector twice, so sides of over 64 samples are stitched.
SMALL = windows.Recipe(rate=40, active_frame=8, fade_ms=(50.0, 250.0))


def small_clips(t: Tables) -> DataFrame:
    pcm = F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).otherwise(F.concat("embedding", "embedding"))
    rows = t.embeddings.select(F.col("vec_id").alias("clip"), (F.col("vec_id") % SPEAKERS).alias("spk"), pcm.alias("pcm"))
    return rows.select("clip", "spk", F.size("pcm").alias("len"), "pcm")


def small_sides(t: Tables, responses: int = RESPONSES):
    asked = specs(t, SMALL, responses).withColumn("spk_b", F.when(F.col("kind") == "change", (F.col("spk_a") + 1) % SPEAKERS).otherwise(F.col("spk_a")))
    clips = small_clips(t)
    entries = windows.catalogue(clips, "spk", "clip", "len")
    return asked, entries, clips


def _tries_sql(side: str, taken: str = "") -> str:
    """Every try of a side as clip pieces, and its samples; ``taken`` is a table of clips a fake change avoids."""
    u = lambda name, key="spec_id || ':' || t": u_sql(f"42-{name}_{side}", key)
    avoid = "CASE WHEN kind = 'fake' AND len(f) > 1 AND taken IS NOT NULL THEN list_filter(f, lambda i: cs[i] <> taken) ELSE f END" if taken else "f"
    return f"""{side}0 AS (SELECT sp.*, t, need_{side} AS need, cs, ls, list_filter(range(1, len(cs) + 1), lambda i: ls[i] >= need_{side}) AS f{', taken' if taken else ''} FROM sp JOIN ent ON ent.spk = sp.spk_{side}{f' LEFT JOIN {taken} USING (spec_id)' if taken else ''}, range(1, 7) r(t) WHERE need_{side} > 0),
{side}1 AS (SELECT *, {avoid} AS fit FROM {side}0),
{side}2 AS (SELECT *, CASE WHEN len(fit) > 0 THEN fit[floor({u('clip')} * len(fit))::INT + 1] END AS pick FROM {side}1),
{side}3 AS (SELECT spec_id, t, need, 1 AS piece, cs[pick] AS clip, floor({u('start')} * (ls[pick] - need + 1))::INT AS low, need AS n, 0 AS before FROM {side}2 WHERE pick IS NOT NULL
  UNION ALL SELECT spec_id, t, need, k, cs[j], 0, ls[j], sum(ls[j]) OVER (PARTITION BY spec_id, t ORDER BY k) - ls[j] FROM (SELECT *, floor({u('stitch', "spec_id || ':' || t || ':' || k")} * len(cs))::INT + 1 AS j FROM {side}2, unnest(range(1, ceil(need / list_min(ls))::INT + 1)) q(k) WHERE pick IS NULL)),
{side}4 AS (SELECT spec_id, '{side}' AS side, t, need, count(*) AS pieces, sum(n)::BIGINT AS available, min(clip) AS clip, flatten(list(pcm[low + 1:low + n] ORDER BY piece))[1:need] AS x FROM {side}3 JOIN emb USING (clip) WHERE before < need GROUP BY spec_id, t, need),
{side}5 AS (SELECT *, list_transform(range(0, len(x) // 8), lambda i: list_sum(list_transform(x[8 * i + 1:8 * i + 8], lambda v: v * v)) / 8) AS m FROM {side}4),
{side}6 AS (SELECT *, len(m) > 0 AND len(list_filter(m, lambda v: v > greatest(0.01 * list_sort(m)[least(len(m) - 1, floor(0.95 * len(m))::INT) + 1], 1e-10))) / len(m) >= (SELECT least_active FROM rule) AS ok FROM {side}5),
{side}7 AS (SELECT spec_id, coalesce(min(t) FILTER (ok), max(t)) AS t FROM {side}6 GROUP BY 1),
{side}8 AS (SELECT {side}6.* FROM {side}6 JOIN {side}7 USING (spec_id, t))"""


def _sides_sql(least_active: float) -> str:
    """Tables a6, b6 (all tries) and a8, b8 (the tries that are kept) of both sides; B avoids the clip that A took."""
    return f"""{_SPECS}, rule AS (SELECT {least_active}::DOUBLE AS least_active),
emb AS (SELECT vec_id AS clip, vec_id % {SPEAKERS} AS spk, (CASE WHEN vec_id % 2 = 0 THEN embedding ELSE list_concat(embedding, embedding) END)::DOUBLE[] AS pcm FROM embeddings),
ent AS (SELECT spk, list(clip ORDER BY len(pcm), clip) AS cs, list(len(pcm) ORDER BY len(pcm), clip) AS ls FROM emb GROUP BY 1),
sp AS (SELECT spec_id, kind, spk_a, CASE WHEN kind = 'change' THEN (spk_a + 1) % {SPEAKERS} ELSE spk_a END AS spk_b,
  round((CASE WHEN kind = 'nochange' THEN 3.0 ELSE at_s - gap END) * 40)::INT AS need_a, round((CASE WHEN kind = 'nochange' THEN 0.0 ELSE 3.0 - at_s END) * 40)::INT AS need_b FROM specs),
{_tries_sql('a')}, taken AS (SELECT spec_id, clip AS taken FROM a8 WHERE pieces = 1), {_tries_sql('b', 'taken')}"""


@query(
    "j8_gathered_sides",
    f"WITH {_sides_sql(0.6)}, s AS (SELECT * FROM a8 UNION ALL SELECT * FROM b8) SELECT spec_id, side, t AS try_no, len(x) AS samples, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 6) AS rms FROM s",
)
def gathered_sides(t: Tables) -> DataFrame:
    """Samples of both sides of each window: level and length of what was gathered."""
    from segflow.functions import signals

    asked, entries, clips = small_sides(t)
    sides = windows.window_sides(asked, entries, "spk", clips, "clip", "pcm", SMALL)[1]
    return sides.select("spec_id", "side", F.col("try").alias("try_no"), F.size("x").alias("samples"), signals.rms(signals.as_doubles("x")).alias("rms"))


@query(
    "g9_stitched_pieces",
    f"WITH {_sides_sql(0.6)}, s AS (SELECT * FROM a6 UNION ALL SELECT * FROM b6) SELECT spec_id, side, t AS try_no, need, pieces, available FROM s WHERE pieces > 1",
)
def stitched_pieces(t: Tables) -> DataFrame:
    """Pieces of the sides that no single clip covers, for every try."""
    asked, entries, clips = small_sides(t)
    pieces = windows.window_sides(asked, entries, "spk", clips, "clip", "pcm", SMALL)[0]
    many = pieces.groupBy("spec_id", "side", F.col("try").alias("try_no"), "need").agg(F.count(F.lit(1)).alias("pieces"), F.sum("len").alias("available"))
    return many.where("pieces > 1")


@query(
    "g5_active_redraw",
    f"WITH {_sides_sql(0.9)}, s AS (SELECT side, t FROM a8 UNION ALL SELECT side, t FROM b8) SELECT side, t AS try_no, count(*) AS windows FROM s GROUP BY ALL",
)
def active_redraw(t: Tables) -> DataFrame:
    """How many draws each side needed until it was active enough."""
    asked, entries, clips = small_sides(t)
    sides = windows.window_sides(asked, entries, "spk", clips, "clip", "pcm", windows.Recipe(rate=40, active_frame=8, min_active=0.9))[1]
    return sides.groupBy("side", F.col("try").alias("try_no")).agg(F.count(F.lit(1)).alias("windows"))


@query("g8_assembled_windows")
def assembled_windows(t: Tables) -> DataFrame:
    """Whole windows: gathered, levelled, faded, placed, reverberated, noised and guarded."""
    from segflow.functions import signals

    bank = stable(ordered(responses(t), [], ["rir_id"]).scan(__at=number()).rows())
    asked, entries, clips = small_sides(t, bank.count())
    sides = windows.window_sides(asked, entries, "spk", clips, "clip", "pcm", SMALL)[1]
    asked = asked.join(windows.with_noise(asked, noise_bank(t), SMALL).select("spec_id", "noise"), "spec_id")
    df = windows.channels(asked, sides, SMALL)
    bank = bank.select((F.col("__at") - 1).alias("rir_id"), "response")
    df = windows.reverberated(df, bank, "seg_a", "rir_a", span=("a_from", "a_to"))
    df = windows.reverberated(df, bank, "seg_b", "rir_b", span=("b_from", "b_to"))
    done = windows.finished_windows(df, SMALL, "noise")
    return done.select(
        "spec_id", "kind", "t_change", F.size("wave").alias("samples"), signals.peak("wave").alias("peak"), signals.rms("wave").alias("rms"),
        signals.total_of("labels").alias("label_mass"), signals.total_of("step").alias("step_mass"),
    )


def responses(t: Tables) -> DataFrame:
    """The embeddings as impulse responses: aligned, faded, unit energy."""
    return t.embeddings.select(F.col("vec_id").alias("rir_id"), windows.prepared_response(F.col("embedding").cast("array<double>"), 32, 8).alias("response"))


def noise_bank(t: Tables) -> DataFrame:
    """Embeddings as noise items, half per kind, numbered per kind."""
    kind = F.when(F.col("vec_id") % 2 == 0, "music").otherwise("noise")
    return t.embeddings.select(kind.alias("noise_kind"), F.floor(F.col("vec_id") / 2).alias("place"), F.col("embedding").alias("pcm"))


@query(
    "g8_window_turns",
    f"""WITH {_SPECS} SELECT spec_id AS file_id, 0.0::DOUBLE AS start_s, round(CASE WHEN kind = 'change' THEN at_s - gap ELSE 3.0 END, 3)::DOUBLE AS end_s, spk_a AS speaker_id, false AS has_overlap FROM specs
UNION ALL SELECT spec_id, round(at_s, 3)::DOUBLE, 3.0, (spk_a + 1) % {SPEAKERS}, gap < 0 FROM specs WHERE kind = 'change'""",
)
def window_turns(t: Tables) -> DataFrame:
    """Turn rows that describe each window; their boundaries are the window's change."""
    asked = specs(t).withColumn("spk_b", F.when(F.col("kind") == "change", (F.col("spk_a") + 1) % SPEAKERS).otherwise(F.col("spk_a")))
    return windows.turns_of(asked)


@query(
    "g10_reverb_mix",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), {_NEXT},
r0 AS (SELECT vec_id AS rir, x[list_position(list_transform(x, lambda v: abs(v)), list_max(list_transform(x, lambda v: abs(v)))):][:32] AS h FROM e),
r1 AS (SELECT rir, list_transform(range(0, len(h)), lambda i: h[i + 1] * CASE WHEN i >= len(h) - least(len(h), 8) THEN 0.5 * (1 + cos(pi() * (i - (len(h) - least(len(h), 8))) / greatest(least(len(h), 8) - 1, 1))) ELSE 1 END) AS h FROM r0),
r2 AS (SELECT rir, list_transform(range(0, 32), lambda i: coalesce(h[i + 1], 0) / sqrt(list_sum(list_transform(h, lambda v: v * v))) * (1 - i / 31)) AS h FROM r1),
j AS (SELECT vec_id, x, h, 0.2 + (0.6::DOUBLE - 0.2::DOUBLE) * {u_sql(5, 'vec_id')} AS wet FROM e JOIN nx USING (vec_id) JOIN r2 ON next_id = rir),
c AS (SELECT *, list_transform(range(0, len(x)), lambda i: list_sum(list_transform(range(0, least(i, 31) + 1), lambda k: x[i - k + 1] * h[k + 1]))) AS y FROM j),
m AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x) + 1e-9) / sqrt(list_sum(list_transform(y, lambda v: v * v)) / len(y) + 1e-9) AS g FROM c),
z AS (SELECT vec_id, list_transform(range(1, len(x) + 1), lambda i: (1 - wet) * x[i] + wet * y[i] * g) AS z FROM m)
SELECT vec_id, round(sqrt(list_sum(list_transform(z, lambda v: v * v)) / len(z)), 6) AS rms, round(z[1], 6) AS first, round(z[64], 6) AS last FROM z""",
)
def reverb_mix(t: Tables) -> DataFrame:
    """Every embedding convolved with the response made of the one after it, at a drawn wet share."""
    from segflow.functions import signals

    waves = t.embeddings.select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("wave"),
        draw.between(0.2, 0.6, 5, "vec_id").alias("wet"),
    ).join(followed(t).withColumnRenamed("next_id", "rir_a"), "vec_id")
    out = windows.reverberated(waves, responses(t), "wave", "rir_a")
    return out.select("vec_id", signals.rms("wave").alias("rms"), F.get("wave", F.lit(0)).alias("first"), F.get("wave", F.lit(63)).alias("last"))
