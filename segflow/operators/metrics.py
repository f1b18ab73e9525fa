"""Window-level and ranking metrics.

A window is one row: ``has`` (contains a change), ``t_true``, ``t_pred`` and ``score``
(time and height of its peak inside the region of interest), and ``kind``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow.functions import signals
from segflow.operators.match import best_threshold
from segflow.session import stable
from segflow.operators.ordered import lag as previous
from segflow.operators.ordered import last, number, ordered, peak, percentiles, total

# Collars, threshold grids and evidence edges of the reports.
COLLARS_S = (0.1, 0.2, 0.5)
EVENT_GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))
BUDGET_GRID = tuple(round(0.01 * i, 2) for i in range(2, 99))
EVIDENCE_EDGES = (0.0, 0.75, 1.25, 1.75, 2.25, 3.0)
ROI_S = (0.5, 2.5)


def window_peaks(
    windows: DataFrame,
    scores: str = "p",
    labels: str = "labels",
    k: int = 5,
    roi_s: tuple[float, float] | None = ROI_S,
    hop_s: float = signals.FRAME_S,
) -> DataFrame:
    """Reduce frame arrays to one peak per window; every report starts from this."""
    p = windows.withColumn("__p", signals.prepared(signals.as_doubles(scores), k, roi_s, hop_s))
    t = signals.change_time(labels, hop_s)
    return p.withColumns(
        {
            "t_true": t,
            "has": F.coalesce(F.array_max(labels) > 0.5, F.lit(False)),
            "t_pred": signals.first_peak("__p") * F.lit(hop_s),
            "score": F.array_max("__p"),
        }
    ).drop("__p", scores, labels)


def within(collar: Column | float) -> Column:
    """Peak inside the collar.  Times are compared to a nanosecond."""
    collar = collar if isinstance(collar, Column) else F.lit(collar)
    return F.round(F.abs(F.col("t_pred") - F.coalesce(F.col("t_true"), F.lit(0.0))), 9) <= collar


def _passed(value: Column, limits: Sequence[float], above: bool) -> Column:
    """How many of the limits a value passes; limits are compared one by one, so ties are exact."""
    tests = [(value >= F.lit(float(v))) if above else (value <= F.lit(float(v))) for v in limits]
    return sum((t.cast("int") for t in tests[1:]), tests[0].cast("int"))


def event_counts(windows: DataFrame, collars: Sequence[float], thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN for every (collar, threshold).

    A window counts for the thresholds up to its score and the collars from its distance
    on, so it is reduced to two small integers and counted map-side; only those counts
    meet the grid.
    """
    collars, thresholds = sorted(collars), sorted(thresholds)
    apart = F.round(F.abs(F.col("t_pred") - F.coalesce(F.col("t_true"), F.lit(0.0))), 9)
    counted = windows.groupBy(
        *by, "has", _passed(F.col("score"), thresholds, True).alias("level"), _passed(apart, collars, False).alias("near")
    ).agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(
        *[
            F.struct(F.lit(float(c)).alias("collar"), F.lit(float(t)).alias("threshold"), F.lit(i).alias("ci"), F.lit(j).alias("ti"))
            for i, c in enumerate(collars)
            for j, t in enumerate(thresholds)
        ]
    )
    rows = counted.select("*", F.inline(cells))
    fired = F.col("level") > F.col("ti")
    hit = fired & F.col("has") & (F.col("near") >= len(collars) - F.col("ci"))
    n = lambda test: F.sum(F.when(test, F.col("n")).otherwise(F.lit(0)))
    return rows.groupBy(*by, "collar", "threshold").agg(
        n(hit).alias("tp"), n(fired & ~hit).alias("fp"), n(F.col("has") & ~hit).alias("fn")
    )


def floored_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 with denominators floored at 1, 1 and 1e-9."""
    tp = F.col("tp")
    df = counts.withColumns(
        {
            "precision": tp / F.greatest(tp + F.col("fp"), F.lit(1)),
            "recall": tp / F.greatest(tp + F.col("fn"), F.lit(1)),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", 2 * p * r / F.greatest(p + r, F.lit(1e-9)))


def event_sweep(
    windows: DataFrame, collars: Sequence[float] = COLLARS_S, thresholds: Sequence[float] = EVENT_GRID, by: Sequence[str] = ()
) -> DataFrame:
    return floored_scores(event_counts(windows, collars, thresholds, by))


def ranking_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision and AUROC, ties shared; NULL where undefined.

    Rows are counted per score before anything is ordered.
    """
    by = list(by)
    pos = F.sum(F.col(label).cast("long"))
    counted = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), pos.alias("p"))
    rows = ordered(counted.withColumn("__down", -F.col(score)), by, ["__down"])
    rows = rows.scan(cn=total("n"), cp=total("p")).rows()
    # of n_all rows, those below a score number n_all - cn; the mean rank of its ties follows
    aggregates = dict(
        n_all=F.sum("n"),
        p_all=F.sum("p"),
        ap=F.sum(F.col("p") * F.col("cp") / F.col("cn")),
        above=F.sum(F.col("p") * (F.col("cn") - (F.col("n") - 1) / 2.0 - 1.0)),
    )
    sums = rows.groupBy(*by).agg(*[c.alias(k) for k, c in aggregates.items()])
    n, p = F.col("n_all"), F.col("p_all")
    ranks = p * n - F.col("above")
    neg = n - p
    return sums.select(
        *by,
        n.alias("n"),
        p.alias("positives"),
        F.when(p > 0, F.col("ap") / p).alias("average_precision"),
        F.when((p > 0) & (neg > 0), (ranks - p * (p + 1) / 2.0) / (p * neg)).alias("auroc"),
    )


def lag_report(windows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Peak time minus true time in ms over windows with a change, fired or not."""
    lags = windows.where("has").withColumn("lag_ms", F.round((F.col("t_pred") - F.col("t_true")) * 1000.0, 6))
    tails = percentiles(lags, by, "lag_ms", {"p10_ms": 0.1, "median_ms": 0.5, "p90_ms": 0.9})
    size = F.abs(F.col("lag_ms"))
    means = lags.groupBy(*by).agg(
        F.avg(size).alias("mae_ms"),
        F.avg((size <= 100).cast("double")).alias("within_100ms"),
        F.avg((size <= 200).cast("double")).alias("within_200ms"),
    )
    return tails.join(means, list(by)) if by else tails.crossJoin(means)


def recall_by_evidence(
    windows: DataFrame, threshold: float | Column, collar: float, window_s: float = 3.0, edges: Sequence[float] = EVIDENCE_EDGES
) -> DataFrame:
    """Recall by seconds of audio after the change, buckets (lo, hi]; empty ones stay."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    seen = F.round(F.lit(window_s) - F.col("t_true"), 9)
    bucket = None
    for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        test = (seen > lo) & (seen <= hi)
        bucket = F.when(test, b) if bucket is None else bucket.when(test, b)
    hit = (F.col("score") >= threshold) & within(collar)
    found = (
        windows.where("has")
        .groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("recall"))
    )
    names = F.array(
        *[
            F.struct(F.lit(b).alias("bucket"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
            for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))
        ]
    )
    dimension = windows.sparkSession.range(1).select(F.inline(names))
    return dimension.join(found, "bucket", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "recall")


def rates_by_kind(windows: DataFrame, threshold: float | Column, by: Sequence[str] = ("kind",)) -> DataFrame:
    """Share of windows that fire, and mean score, per kind."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return windows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("score") >= threshold).cast("double")).alias("fire_rate"),
        F.avg("score").alias("mean_score"),
    )


def per_minute(rate: Column, window_s: float = 3.0, roi_s: tuple[float, float] | None = ROI_S) -> Column:
    """False alarms per minute of audio when the decided spans tile it."""
    span = roi_s[1] - roi_s[0] if roi_s is not None else window_s
    return rate * 60.0 / F.lit(span)


def budget_threshold(
    windows: DataFrame,
    max_per_minute: float = 1.0,
    collar: float = 0.2,
    thresholds: Sequence[float] = BUDGET_GRID,
    roi_s: tuple[float, float] | None = ROI_S,
) -> DataFrame:
    """Lowest threshold whose no-change alarms fit the budget, with its event scores."""
    thresholds = sorted(thresholds)
    apart = F.round(F.abs(F.col("t_pred") - F.coalesce(F.col("t_true"), F.lit(0.0))), 9)
    level = _passed(F.col("score"), thresholds, True).alias("level")
    still = (F.col("kind") == "nochange").alias("still")
    counted = windows.groupBy(still, "has", (apart <= collar).alias("near"), level).agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(j).alias("ti")) for j, t in enumerate(thresholds)])
    fired = F.col("level") > F.col("ti")
    hit = fired & F.col("has") & F.col("near")
    n = lambda test: F.sum(F.when(test, F.col("n")).otherwise(F.lit(0)))
    points = (
        counted.select("*", F.inline(cells))
        .groupBy("threshold")
        .agg(
            n(hit).alias("tp"),
            n(fired & ~hit).alias("fp"),
            n(F.col("has") & ~hit).alias("fn"),
            n(F.col("still") & fired).alias("alarms"),
            n(F.col("still")).alias("quiet"),
        )
    )
    rate = F.when(F.col("quiet") > 0, F.col("alarms") / F.col("quiet")).otherwise(F.lit(0.0))
    points = points.withColumn("fa_per_min_nochange", per_minute(rate, roi_s=roi_s))
    fits = floored_scores(points.where(F.col("fa_per_min_nochange") <= max_per_minute)).drop("alarms", "quiet")
    row = F.struct(*fits.columns)
    best = fits.agg(F.min_by(row, "threshold").alias("b")).where("b is not null")
    return best.select("b.*")


def full_report(windows: DataFrame, window_s: float = 3.0, roi_s: tuple[float, float] | None = ROI_S) -> DataFrame:
    """Every metric as (metric, key, value) rows, from one pass to window peaks.

    The peaks are written once for the passes that follow.
    """
    peaks = stable(windows.select("has", "t_true", "t_pred", "score", "kind"))
    def long(df: DataFrame, key: Column, **values: Column) -> DataFrame:
        cells = [
            F.struct(F.lit(m).alias("metric"), key.cast("string").alias("key"), v.cast("double").alias("value"))
            for m, v in values.items()
        ]
        return df.select(F.inline(F.array(*cells)))

    none = F.lit("")
    size = peaks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("has").cast("double")).alias("frac"))
    parts = [long(size, none, windows=F.col("n"), frac_change=F.col("frac"))]
    ranks = ranking_metrics(peaks, "score", "has")
    parts.append(long(ranks, none, average_precision=F.col("average_precision"), auroc=F.col("auroc")))
    best = stable(best_threshold(event_sweep(peaks), ["collar"]))
    name = F.concat((F.col("collar") * 1000).cast("int").cast("string"), F.lit("ms"))
    event = ("threshold", "precision", "recall", "f1", "tp", "fp", "fn")
    parts.append(long(best, name, **{f"event_{c}": F.col(c) for c in event}))
    lag = ("median_ms", "mae_ms", "p10_ms", "p90_ms", "within_100ms", "within_200ms")
    parts.append(long(lag_report(peaks), none, **{f"lag_{c}": F.col(c) for c in lag}))
    # the threshold of the 200 ms collar drives what follows: one row, so the join is a scalar
    chosen = best.where(F.col("collar") == 0.2).select(F.col("threshold").alias("__thr"))
    judged = peaks.crossJoin(F.broadcast(chosen))
    span = F.concat(F.format_string("%.2f", "lo"), F.lit("-"), F.format_string("%.2f", "hi"), F.lit("s"))
    evidence = recall_by_evidence(judged, F.col("__thr"), 0.2, window_s)
    parts.append(long(evidence, span, evidence_n=F.col("n"), evidence_recall=F.col("recall")))
    kinds = rates_by_kind(judged, F.col("__thr"))
    parts.append(long(kinds, F.col("kind"), fire_rate=F.col("fire_rate"), mean_score=F.col("mean_score")))
    quiet = kinds.where(F.col("kind").isin("nochange", "fake"))
    parts.append(long(quiet, F.col("kind"), fa_per_min=per_minute(F.col("fire_rate"), window_s, roi_s)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sliced_report(windows: DataFrame, slices: Sequence[str], collar: float, threshold: float) -> DataFrame:
    """Event scores and fire rate for every slice, all slices in one pass (grouping sets).

    Row per value of each slice column and one for the whole; others are NULL.
    """
    apart = F.round(F.abs(F.col("t_pred") - F.coalesce(F.col("t_true"), F.lit(0.0))), 9)
    fired = F.col("score") >= threshold
    hit = fired & F.col("has") & (apart <= collar)
    marked = windows.select(*slices, fired.cast("int").alias("f"), hit.cast("int").alias("h"), F.col("has").cast("int").alias("c"))
    sets = [[F.col(s)] for s in slices] + [[]]
    counts = marked.groupingSets(sets, *slices).agg(
        F.grouping_id().alias("slice"),
        F.count(F.lit(1)).alias("n"),
        F.sum("h").alias("tp"),
        F.sum(F.col("f") - F.col("h")).alias("fp"),
        F.sum(F.col("c") - F.col("h")).alias("fn"),
        F.avg(F.col("f").cast("double")).alias("fire_rate"),
    )
    return floored_scores(counts)


def runtime_stats(calls: DataFrame, by: Sequence[str], ms: str, duration_s: Column) -> DataFrame:
    """Compute-time statistics per file; ``duration_s`` is an aggregate expression."""
    sums = calls.groupBy(*by).agg(
        duration_s.alias("audio_duration_s"),
        F.count(F.lit(1)).alias("num_chunks"),
        (F.sum(ms) / 1000.0).alias("total_compute_s"),
        F.avg(ms).alias("mean_chunk_ms"),
        F.max(ms).alias("max_chunk_ms"),
    )
    tails = percentiles(calls, by, ms, {"p95_chunk_ms": 0.95})
    rtf = F.when(F.col("audio_duration_s") > 0, F.col("total_compute_s") / F.col("audio_duration_s"))
    return sums.join(tails, list(by)).withColumn("rtf", rtf)


def frame_prf(frames: DataFrame, predicted: Column, actual: Column, by: Sequence[str] = ()) -> DataFrame:
    """Frame-level precision, recall and F1."""
    n = lambda test: F.sum(test.cast("long"))
    counts = frames.groupBy(*by).agg(
        n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"), n(~predicted & actual).alias("fn")
    )
    return floored_scores(counts)


def cross_entropy(logit: Column, target: Column, positive_weight: float = 1.0) -> Column:
    """Binary cross-entropy from a logit, in the overflow-free form."""
    soft = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return (1.0 - target) * logit + (1.0 + (F.lit(positive_weight) - 1.0) * target) * soft


def utterance_confidence(logps: Column | str) -> Column:
    """exp(mean log-probability); NULL for none."""
    logps = F.col(logps) if isinstance(logps, str) else logps
    return F.when(F.size(logps) > 0, F.exp(signals.total_of(logps) / F.size(logps)))


def best_and_stop(history: DataFrame, metric: str, step: str, patience: int, total_steps: Column | int, by: Sequence[str] = ()) -> DataFrame:
    """Best checkpoint (strict improvements only) and the early-stop step, if reached.

    The steps after the stop are not considered for the best one.
    """
    rows = ordered(history, by, [step]).scan(__top=peak(metric), __at=number())
    rows = rows.scan(__best=previous("__top"))
    better = F.col("__best").isNull() | (F.col(metric) > F.col("__best"))
    rows = rows.columns(__won=F.when(better, F.col("__at"))).scan(__last=last("__won"))
    rows = rows.columns(bad_evals=F.col("__at") - F.col("__last"))
    limit = (total_steps if isinstance(total_steps, Column) else F.lit(total_steps)) * F.lit(0.4)
    stop = (F.col(step) >= limit) & (F.col("bad_evals") >= patience)
    rows = rows.columns(__stop=stop.cast("long"))
    rows = rows.scan(__stops=total("__stop"))
    seen = rows.where((F.col("__stops") == 0) | ((F.col("__stops") == 1) & stop)).rows()
    return seen.groupBy(*by).agg(
        F.max_by(step, F.when(F.col("bad_evals") == 0, F.col(step))).alias("best_step"),
        F.max(metric).alias("best_value"),
        F.max(F.when(stop, F.col(step))).alias("stop_step"),
        F.count(F.lit(1)).alias("evals"),
    )
