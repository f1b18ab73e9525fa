"""Matching predictions to true boundaries inside a collar, and the threshold sweep.

Within a file both sides are walked in time order.  A boundary becomes available
one collar before its time and expires one collar after it; a prediction takes the
earliest available boundary, or counts as a false positive.  As boundaries are taken
in order, the only state is *how many* are available: +1 on arrival, -1 (not below
0) on a prediction, and a cap on expiry.  Such steps compose into one clamp
``min(max(x + a, lo), hi)``, which is what lets a hot file be matched in blocks.
Times are whole microseconds, so a distance equal to the collar is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow.operators.ordered import Kernel, ordered, total

ARRIVE, PREDICT, EXPIRE = 0, 1, 2
_FAR = 1 << 60
#: The clamp that leaves every state as it is, for any number of rows and thresholds.
_NONE = np.array([0, -_FAR, _FAR])[:, None, None]
#: Thresholds that one pass can hold, one bit each.
LEVELS = 62


def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Clamps (a, lo, hi on axis 0) that apply ``first`` and then ``second``."""
    out = first + second[0]
    np.maximum(out[1:], second[1], out=out[1:])
    np.minimum(out[1:], second[2], out=out[1:])
    return out


def _running(steps: np.ndarray) -> np.ndarray:
    """For each row (axis 1) the clamp of all rows up to it.

    Composition is associative, so the rows are laid out as a square: one step along it composes whole columns, then
    what came before each line of the square is composed into it.
    """
    n, levels = steps.shape[1:]
    wide = max(1, math.isqrt(n))
    lines = -(-n // wide)
    square = np.empty((3, lines * wide, levels), np.int64)
    square[:, :n] = steps
    square[:, n:] = _NONE
    square = np.ascontiguousarray(square.reshape(3, lines, wide, levels).swapaxes(1, 2))
    for j in range(1, wide):
        square[:, j] = _then(square[:, j - 1], square[:, j])
    before = np.empty((3, lines, levels), np.int64)
    before[:, 0] = _NONE[:, 0]
    for k in range(1, lines):
        before[:, k] = _then(before[:, k - 1], square[:, -1, k - 1])
    return _then(before[:, None], square).swapaxes(1, 2).reshape(3, lines * wide, levels)[:, :n]


def _clamped(state: np.ndarray, clamp: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(state + clamp[0], clamp[1]), clamp[2])


class _Collar(Kernel):
    """Counts of available boundaries, one column per threshold; a row is one clamp of them."""

    inputs = ("kind", "level", "open")
    #: Rows of a block that are composed at once.
    SLICE = 1 << 14

    def __init__(self, levels: int):
        self.levels = levels
        # bit k of ``hits``: the prediction is a match at threshold k
        self.outputs = {"hits": "bigint", "waiting": "bigint"}

    def start(self):
        return np.zeros(self.levels, np.int64)

    def values(self, column):
        return column.to_numpy(zero_copy_only=False)

    def _steps(self, columns) -> tuple[np.ndarray, np.ndarray]:
        kind, open_now = columns["kind"][:, None], columns["open"][:, None]
        tried = (kind == PREDICT) & (np.arange(self.levels) < columns["level"][:, None])
        a = (kind == ARRIVE).astype(np.int64) - tried
        low = np.where(tried, 0, -_FAR)
        high = np.where(kind == EXPIRE, open_now, _FAR) + np.zeros_like(a)
        return np.stack([a, low, high]), tried

    def run(self, columns, first, enter, state):
        steps, tried = self._steps(columns)
        begins = np.flatnonzero(first)
        entry = np.zeros((len(begins), self.levels), np.int64)
        for k in [k for k, i in enumerate(begins.tolist()) if i in enter] if enter else ():
            entry[k] = enter[int(begins[k])]
        # a key starts from its own state whatever came before: its first row is a constant
        steps[1:, begins] = _clamped(entry, steps[:, begins])
        steps[0, begins] = 0
        after = _clamped(state, _running(steps))
        before = np.concatenate([[state], after[:-1]])
        before[begins] = entry
        hits = (tried & (before > 0)) @ (np.int64(1) << np.arange(self.levels))
        return {"hits": hits, "waiting": before[:, 0]}, after[-1]

    def summary(self, columns):
        whole = np.broadcast_to(_NONE[:, 0], (3, self.levels))
        for low in range(0, len(columns["kind"]), self.SLICE):
            steps, _ = self._steps({c: v[low : low + self.SLICE] for c, v in columns.items()})
            whole = _then(whole, _running(steps)[:, -1])
        return whole

    def follow(self, state, summary):
        return _clamped(state, summary)


def collar_walk(
    truth: DataFrame,
    predictions: DataFrame,
    keys: Sequence[str],
    collar_us: int,
    thresholds: Sequence[float] = (0.0,),
) -> DataFrame:
    """One row per arrival, prediction and expiry, with ``hits`` set on predictions.

    ``truth`` has keys, ``id`` and ``at_us``; ``predictions`` also ``confidence``.
    ``arrived`` counts the boundaries seen so far, ``waiting`` those available
    (at the lowest threshold) before the row.
    """
    levels = len(thresholds)
    if not 0 < levels <= LEVELS:
        raise ValueError(f"between 1 and {LEVELS} thresholds fit one bit mask; collar_sweep takes any number")
    if list(thresholds) != sorted(thresholds):
        raise ValueError("thresholds must ascend")
    keys = list(keys)
    # a prediction without a confidence passes no threshold
    passed = sum(F.coalesce(F.col("confidence") >= F.lit(float(t)), F.lit(False)).cast("int") for t in thresholds)
    none = F.lit(None)
    marks = truth.select(
        *keys,
        "id",
        "at_us",
        F.explode(
            F.array(
                F.struct((F.col("at_us") - collar_us).alias("pos"), F.lit(ARRIVE).alias("kind")),
                F.struct((F.col("at_us") + collar_us).alias("pos"), F.lit(EXPIRE).alias("kind")),
            )
        ).alias("m"),
    ).select(
        *keys, "id", "at_us", "m.pos", "m.kind", F.lit(0).alias("level"), none.cast("double").alias("confidence")
    )
    points = predictions.select(
        *keys, "id", "at_us", F.col("at_us").alias("pos"), F.lit(PREDICT).alias("kind"), passed.alias("level"), "confidence"
    )
    step = F.when(F.col("kind") == ARRIVE, 1).when(F.col("kind") == EXPIRE, -1).otherwise(0)
    come = F.when(F.col("kind") == ARRIVE, 1).otherwise(0)
    rows = ordered(marks.unionByName(points), keys, ["pos", "kind", "at_us", "id"])
    return rows.scan(open=total(step), arrived=total(come)).fold(_Collar(levels)).rows()


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def precision_recall(df: DataFrame, accuracy: bool = True) -> DataFrame:
    """Add precision, recall, f1 (and accuracy) from ``tp``, ``fp``, ``fn``; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    df = df.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    df = df.withColumn("f1", _ratio(2 * p * r, p + r))
    return df.withColumn("accuracy", _ratio(tp, tp + fp + fn)) if accuracy else df


def sweep_counts(walk: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """TP, FP and FN per threshold (and per ``by``) from a collar walk."""
    aggregates = [F.sum(F.when(F.col("kind") == ARRIVE, 1).otherwise(0)).alias("truths")]
    for k in range(len(thresholds)):
        hit = F.col("hits").bitwiseAND(F.lit(1 << k)) != 0
        aggregates.append(F.sum(hit.cast("long")).alias(f"tp{k}"))
        aggregates.append(F.sum((F.col("level") > k).cast("long")).alias(f"made{k}"))
    wide = walk.groupBy(*by).agg(*aggregates)
    per = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(float(t)).alias("threshold"),
                    F.coalesce(F.col(f"tp{k}"), F.lit(0)).alias("tp"),
                    F.coalesce(F.col(f"made{k}") - F.col(f"tp{k}"), F.lit(0)).alias("fp"),
                    F.coalesce(F.col("truths") - F.col(f"tp{k}"), F.lit(0)).alias("fn"),
                )
                for k, t in enumerate(thresholds)
            ]
        )
    ).alias("s")
    return wide.select(*by, per).select(*by, "s.*")


def collar_sweep(
    truth: DataFrame,
    predictions: DataFrame,
    keys: Sequence[str],
    collar_us: int,
    thresholds: Sequence[float],
) -> DataFrame:
    """Micro metrics per threshold; LEVELS thresholds are matched in one pass over the data."""
    counts = None
    for low in range(0, len(thresholds), LEVELS):  # more thresholds than bits take another pass
        some = thresholds[low : low + LEVELS]
        part = sweep_counts(collar_walk(truth, predictions, keys, collar_us, some), some)
        counts = part if counts is None else counts.unionByName(part)
    return precision_recall(counts)


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row with the highest ``f1``; the lowest threshold wins a tie."""
    row = F.struct(*[c for c in sweep.columns if c not in by])
    best = F.max_by(row, F.struct(F.col("f1"), (-F.col("threshold")).alias("t")))
    return sweep.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def matched_pairs(
    truth: DataFrame, predictions: DataFrame, keys: Sequence[str], collar_us: int, threshold: float = 0.0
) -> DataFrame:
    """Which prediction took which boundary: boundaries are taken in time order."""
    keys = list(keys)
    walk = collar_walk(truth, predictions, keys, collar_us, [threshold])
    taken = walk.where(F.col("hits") == 1).select(
        *keys,
        F.col("id").alias("prediction_id"),
        F.col("at_us").alias("predicted_us"),
        (F.col("arrived") - F.col("waiting") + 1).alias("rank"),
    )
    ranked = walk.where(F.col("kind") == ARRIVE).select(
        *keys, F.col("arrived").alias("rank"), F.col("id").alias("truth_id"), F.col("at_us").alias("truth_us")
    )
    return taken.join(ranked, [*keys, "rank"]).drop("rank")


def file_scores(walk: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-file precision, recall and F1 with denominators floored (1, 1, 1e-9)."""
    counts = sweep_counts(walk, [0.0], keys).drop("threshold")
    tp = F.col("tp")
    made, true = F.greatest(tp + F.col("fp"), F.lit(1)), F.greatest(tp + F.col("fn"), F.lit(1))
    df = counts.withColumns({"precision": tp / made, "recall": tp / true})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", 2 * p * r / F.greatest(p + r, F.lit(1e-9)))
