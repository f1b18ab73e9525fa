"""Leak-free splits, holdouts, caps and schedules from stateless seeded draws."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow.functions import draw
from segflow.operators.joins import join_small
from segflow.operators.ordered import head, number, ordered, total

# Split shares, gap choices (seconds), noise levels and their weights.
SHARES = (0.7, 0.15, 0.15)
GAPS = (-0.2, -0.1, 0.0, 0.0, 0.0, 0.1, 0.2)
NOISE_LEVELS, NOISE_WEIGHTS = ("zero", "mild", "moderate"), (0.5, 0.25, 0.25)


def entity_split(ids: DataFrame, id_column: str, seed: int = 42, shares: Sequence[float] = SHARES) -> DataFrame:
    """Distinct ids in seeded order, cut at int(n * share): train, val, rest test."""
    rows = ordered(ids.select(id_column).distinct().withColumn("__u", draw.bits(seed, id_column)), [], ["__u", id_column])
    ranked = rows.scan(__at=number()).rows()
    size = F.lit(ids.select(id_column).distinct().count())
    train = F.floor(size * F.lit(float(shares[0])))
    val = F.floor(size * F.lit(float(shares[1])))
    at = F.col("__at") - 1
    split = F.when(at < train, "train").when(at < train + val, "val").otherwise("test")
    return ranked.select(id_column, split.alias("split"))


def threshold_split(df: DataFrame, id_column: str, seed: int = 42, shares: Sequence[float] = SHARES) -> DataFrame:
    """Split by the draw alone: no shuffle and no ranking, sizes approximate."""
    u = draw.uniform(seed, id_column)
    split = F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "val").otherwise("test")
    return df.withColumn("split", split)


def group_holdout(
    items: DataFrame,
    category: str,
    group: str,
    item: str,
    seed: int = 42,
    share: float = 0.1,
    caps: dict[str, int] | None = None,
) -> DataFrame:
    """Hold out whole groups per category (at least one), then cap items per category.

    Groups are ranked as a dimension; the items join back on (category, group).
    """
    groups = items.select(category, group).distinct().withColumn("__u", draw.bits(seed, category, group))
    rows = ordered(groups, [category], ["__u", group]).scan(__at=number()).rows()
    sizes = rows.groupBy(category).agg(F.max("__at").alias("__n"))
    cut = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(share)))
    split = F.when(F.col("__at") <= cut, "val").otherwise("train")
    held = join_small(rows, sizes, [category]).select(category, group, split.alias("split"))
    out = join_small(items, held, [category, group])
    if caps is None:
        return out
    capped = None
    for name, limit in caps.items():
        part = head(out.where(F.col("split") == name), [category], [draw.bits(f"{seed}-{name}", item), item], limit)
        capped = part if capped is None else capped.unionByName(part)
    return capped


def file_holdout(files: DataFrame, category: str, file: str, seed: int = 42, share: float = 0.1) -> DataFrame:
    """Hold out single files per category (at least one)."""
    rows = ordered(files.withColumn("__u", draw.bits(seed, category, file)), [category], ["__u", file])
    ranked = rows.scan(__at=number()).rows()
    sizes = files.groupBy(category).agg(F.count(F.lit(1)).alias("__n"))
    cut = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(share)))
    split = F.when(F.col("__at") <= cut, "val").otherwise("train")
    return join_small(ranked, sizes, [category]).withColumn("split", split).drop("__u", "__at", "__n")


def capped_clips(
    clips: DataFrame, speaker: str, clip: str, per_speaker: int, seed: int = 42, first_speakers: int | None = None
) -> DataFrame:
    """At most ``per_speaker`` clips of each speaker in seeded order; optionally the first speakers only."""
    out = clips
    if first_speakers is not None:
        names = clips.select(speaker).distinct().orderBy(speaker).limit(first_speakers)
        out = join_small(clips, names, [speaker], "left_semi")
    return head(out, [speaker], [draw.bits(seed, clip), clip], per_speaker)


def running_offsets(clips: DataFrame, order: Sequence[str], length: str) -> DataFrame:
    """``clip_start``: samples of all clips before this one, over the whole pool."""
    rows = ordered(clips, [], order).scan(__upto=total(length)).rows()
    return rows.withColumn("clip_start", F.col("__upto") - F.col(length)).drop("__upto")


def cropped(clips: DataFrame, clip: str, length: str, limit: int, seed: int = 42) -> DataFrame:
    """Cut long clips to ``limit`` samples at a seeded start in [0, n - limit]."""
    spare = F.greatest(F.col(length) - limit, F.lit(0))
    start = draw.integer(spare + 1, seed, clip)
    return clips.withColumns({"crop_start": F.when(spare > 0, start).otherwise(F.lit(0)).cast("long"), "crop_len": F.least(F.col(length), F.lit(limit))})


def unordered_pairs(dimension: DataFrame, id_column: str) -> DataFrame:
    """All pairs (i < j) of distinct ids, made from their numbers: two joins on places, no pairing of rows."""
    n = dimension.count()
    size = n * (n - 1) // 2
    numbers = dimension.sparkSession.range(size).select(F.col("id").alias("__k"))
    return _speakers_of(dimension, id_column, numbers, n).select("speaker_a", "speaker_b")


def pair_schedule(dimension: DataFrame, id_column: str, jobs: DataFrame, job: str, seed: int = 42) -> DataFrame:
    """Shuffled pairs cycled over the jobs 0..n-1, each flipped with probability one half.

    No pair is ever listed: each job computes the number of its pair, spread by a fixed step over all pairs, for a
    dimension of any size.
    """
    n = dimension.count()
    if n < 2:
        raise ValueError("need at least 2 speakers")
    size = n * (n - 1) // 2
    placed = jobs.withColumn("pair_no", F.col(job) % size)
    joined = _numbered_pairs(dimension, id_column, placed, n, size, seed)
    flip = draw.chance(0.5, f"{seed}-flip", job)
    a, b = F.col("speaker_a"), F.col("speaker_b")
    return joined.withColumns({"speaker_a": F.when(flip, b).otherwise(a), "speaker_b": F.when(flip, a).otherwise(b)})


def _numbered_pairs(dimension: DataFrame, id_column: str, placed: DataFrame, n: int, size: int, seed: int) -> DataFrame:
    """Speakers of each job's pair: pair number -> (first, second) place -> ids."""
    step = (1 << 18) + 2 * seed + 1
    while math.gcd(step, size) != 1:
        step += 1
    if step * size >= 1 << 62:
        raise ValueError("too many pairs to number")
    return _speakers_of(dimension, id_column, placed.withColumn("__k", (F.col("pair_no") * step + seed) % size), n)


def _speakers_of(dimension: DataFrame, id_column: str, numbered: DataFrame, n: int) -> DataFrame:
    """The pair of each number ``__k``: pairs stand in order of their places (first, second)."""
    k = F.col("__k")
    # pairs before first place i: i * (2n - i - 1) / 2
    before = lambda i: F.shiftright(i * (2 * n - i - 1), 1)
    guess = F.floor((F.lit(2 * n - 1) - F.sqrt(F.pow(F.lit(2.0 * n - 1), F.lit(2.0)) - 8 * k)) / 2).cast("long")
    # the root is rounded, so the guess can be one off either way
    guess = F.greatest(F.least(guess, F.lit(n - 2)), F.lit(0))
    df = numbered.withColumn("__g", guess)
    g = F.col("__g")
    first = F.when(before(g) > F.col("__k"), g - 1).when(before(g + 1) <= F.col("__k"), g + 1).otherwise(g)
    df = df.withColumn("__a", first).withColumn("__b", F.col("__k") - before(F.col("__a")) + F.col("__a") + 1).drop("__k", "__g")
    places = ordered(dimension.select(id_column), [], [id_column]).scan(__at=number()).rows()
    side = lambda name, place: places.select(F.col(id_column).alias(name), (F.col("__at") - 1).alias(place))
    df = join_small(df, side("speaker_a", "__a"), ["__a"])
    return join_small(df, side("speaker_b", "__b"), ["__b"]).drop("__a", "__b")


def clip_cursors(jobs: DataFrame, job: str, sides: Sequence[str] = ("speaker_a", "speaker_b")) -> DataFrame:
    """Clip cursor of every use of a speaker: two more per earlier use."""
    uses = jobs.select(
        job, F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(s).alias("speaker")) for i, s in enumerate(sides)])).alias("u")
    ).select(job, "u.side", "u.speaker")
    rows = ordered(uses, ["speaker"], [job, "side"]).scan(__at=number()).rows()
    return rows.withColumn("cursor", (F.col("__at") - 1) * 2).drop("__at")


def position_grid(
    jobs: DataFrame,
    job: str,
    window_s: float = 3.0,
    min_segment_s: float = 1.0,
    step_s: float = 0.5,
    jitter_s: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Change times per job: a grid with seeded jitter, clamped; gap and noise level drawn too."""
    count = int((window_s - 2 * min_segment_s + 1e-9) / step_s) + 1
    rows = jobs.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    base = F.lit(min_segment_s) + F.col("position") * F.lit(step_s)
    time = base + draw.between(-jitter_s, jitter_s, seed, job, "position")
    clamped = F.least(F.greatest(time, F.lit(min_segment_s)), F.lit(window_s - min_segment_s))
    return rows.withColumns(
        {
            "change_time_s": clamped,
            "gap_s": draw.choice(GAPS, f"{seed}-gap", job, "position"),
            "noise_level": draw.weighted(NOISE_LEVELS, NOISE_WEIGHTS, f"{seed}-noise", job, "position"),
        }
    )


def negative_count(positives: Column, change_fraction: float) -> Column:
    """Negatives for the wanted share of positives, rounded half to even."""
    return F.bround(positives * F.lit(1 - change_fraction) / F.lit(max(change_fraction, 1e-9)), 0).cast("long")


def first_files(turns: DataFrame, order: str, limit: int) -> DataFrame:
    """Rows of the first ``limit`` files in manifest order."""
    first = turns.groupBy("file_id").agg(F.min(order).alias("__first")).orderBy("__first").limit(limit)
    return join_small(turns, first.select("file_id"), ["file_id"], "left_semi")
