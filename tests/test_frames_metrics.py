import numpy as np
import pytest
from pyspark.sql import functions as F

from segflow.functions import signals
from segflow.operators import checks, frames, metrics
from segflow.operators.ordered import ordered


def smooth(p, k=5):
    return np.convolve(np.pad(p, k // 2, mode="edge"), np.ones(k) / k, mode="valid")


@pytest.mark.parametrize("n", [1, 2, 5, 37])
def test_smoothing_rows_and_arrays(spark, n):
    p = np.random.default_rng(n).random(n)
    df = spark.createDataFrame([(1, [float(v) for v in p])], "s int, p array<double>")
    assert df.select(signals.smoothed("p")).first()[0] == pytest.approx(smooth(p))
    rows = df.select("s", F.posexplode("p").alias("i", "p"))
    got = [r.smooth for r in frames.smooth_rows(rows, ["s"], "i", "p", cell=8).orderBy("i").collect()]
    assert got == pytest.approx(smooth(p))


def test_peaks_across_cells(spark):
    p = np.round(np.random.default_rng(1).random(400), 1)  # many plateaus
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(p)], "s int, i int, p double")
    got = sorted(r.i for r in frames.local_peaks(rows, ["s"], "i", "p", 0.6, 7, cell=32).collect())
    want = [i for i in range(400) if p[i] >= 0.6 and p[i] >= p[max(i - 7, 0) : i + 8].max()]
    assert got == want
    arr = spark.createDataFrame([([float(v) for v in p],)], "p array<double>")
    assert arr.select(signals.edge_peaks("p", 0.6, 7)).first()[0] == want
    trusted = arr.select(signals.trusted_peaks("p", 0.6, 7, 50, 100)).first()[0]
    assert trusted == [i for i in want if 50 <= i < 300]


def literal_events(times, probs, threshold, merge):
    events, i = [], 0
    while i < len(probs):
        j = i
        while j < len(probs) and probs[j] > threshold:
            j += 1
        if j > i:
            events.append(times[i + int(np.argmax(probs[i:j]))])
        i = max(j, i + 1)
    kept = []
    for t in events:
        if not kept or t - kept[-1] >= merge:
            kept.append(t)
    return kept


def test_runs_are_strict_and_merge(form, spark):
    p = np.round(np.random.default_rng(2).random(300), 1)
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(p)], "s int, i int, p double")
    got = sorted(r.peak_at for r in frames.frame_events(ordered(rows, ["s"], ["i"]), "p", 0.5, 6).collect())
    assert got == literal_events(range(300), p, 0.5, 6)


def test_region_and_change_time(spark):
    p = [0.1] * 301
    df = spark.createDataFrame([(p, [0.0] * 120 + [0.8, 1.0, 1.0] + [0.0] * 177, [0.1] * 300)], "p array<double>, y array<double>, z array<double>")
    row = df.select(signals.in_region("p", (0.5, 2.5)).alias("r"), signals.change_time("y").alias("t"), signals.change_time("z").alias("none")).first()
    assert [i for i, v in enumerate(row.r) if v] == list(range(50, 251))
    assert row.t == pytest.approx(1.21) and row.none is None
    assert df.select(signals.in_region("p", None)).first()[0] == p


def test_sliding_windows_are_full(spark):
    df = spark.createDataFrame([("a", 11), ("b", 12), ("c", 21)], "s string, n long")
    got = {(r.s, r.start, r.end) for r in frames.sliding_windows(df, ["s"], "n", 12, 4).collect()}
    assert got == {("b", 0, 12), ("c", 0, 12), ("c", 4, 16), ("c", 8, 20)}


def test_scorer_registry(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, wave array<double>")
    frames.register_scorer("double", lambda: (lambda batch: batch * 2))
    assert frames.score_windows(df, "wave", "double", 2).first().p == [2.0, 4.0]
    assert frames.score_windows(df, "wave", "noop", 2).count() == 0
    with pytest.raises(ValueError):
        frames.score_windows(df, "wave", "missing", 2)
    with pytest.raises(Exception, match="scorer output"):
        frames.score_windows(df, "wave", "double", 3).collect()


def replay(windows, threshold, merge, window_s, hop_s):
    """Literal detector loop over (window_no, p)."""
    out, latest = [], None
    for no, p in windows:
        step = window_s / len(p)
        radius = int(round(merge / step))
        for i, v in enumerate(p):
            if v >= threshold and v == max(p[max(0, i - radius) : i + radius + 1]):
                t = no * hop_s + i * step
                if latest is None or t - latest > merge:
                    out.append((round(t, 6), v))
                    latest = t
    return out


def test_replay_equals_literal_detector(form, spark):
    rng = np.random.default_rng(5)
    windows = [(i, [float(v) for v in rng.random(30)]) for i in range(60)]
    df = spark.createDataFrame([("s", i, p, 62.0) for i, p in windows], "s string, window_no int, p array<double>, duration_s double")
    got = frames.replay_predictions(df, ["s"], 3.0, 1.0, 0.6, 0.3).collect()
    assert sorted((round(r.boundary_time_s, 6), r.confidence) for r in got) == sorted(replay(windows, 0.6, 0.3, 3.0, 1.0))
    for r in got:
        assert r.emitted_at_s >= r.boundary_time_s and r.emitted_at_s <= 62.0


def test_ranking_with_ties(form, spark):
    rng = np.random.default_rng(7)
    score, y = np.round(rng.random(300), 2), rng.random(300) < 0.3
    df = spark.createDataFrame([(float(s), bool(v)) for s, v in zip(score, y)], "score double, y boolean")
    row = metrics.ranking_metrics(df, "score", "y").first()
    pairs = [(a > b) + 0.5 * (a == b) for a in score[y] for b in score[~y]]
    assert row.auroc == pytest.approx(np.mean(pairs))
    ap, before = 0.0, 0
    for s in sorted(set(score), reverse=True):
        tp, n = y[score >= s].sum(), (score >= s).sum()
        ap += (tp - before) * tp / n
        before = tp
    assert row.average_precision == pytest.approx(ap / y.sum())


def test_ranking_degenerate(spark):
    same = spark.createDataFrame([(0.5, True), (0.5, False), (0.5, False), (0.5, False)], "score double, y boolean")
    row = metrics.ranking_metrics(same, "score", "y").first()
    assert (row.average_precision, row.auroc) == (0.25, 0.5)
    one = metrics.ranking_metrics(same.where("not y"), "score", "y").first()
    assert one.average_precision is None and one.auroc is None


def windows(spark, rows):
    return spark.createDataFrame(rows, "has boolean, t_true double, t_pred double, score double, kind string")


def test_misplaced_fire_counts_twice(spark):
    df = windows(spark, [(True, 1.0, 2.0, 0.9, "change"), (True, 1.0, 1.1, 0.9, "change"), (False, None, 1.0, 0.9, "fake"), (True, 1.0, 1.0, 0.1, "change")])
    row = metrics.event_sweep(df, [0.2], [0.5]).first()
    assert (row.tp, row.fp, row.fn) == (1, 2, 2)


def test_empty_evidence_bucket_and_budget(spark):
    df = windows(spark, [(True, 1.0, 1.0, 0.9, "change"), (False, None, 1.0, 0.3, "nochange"), (False, None, 1.0, 0.5, "nochange")])
    rows = {(r.lo, r.hi): (r.n, r.recall) for r in metrics.recall_by_evidence(df, 0.5, 0.2).collect()}
    assert rows[(1.75, 2.25)] == (1, 1.0) and rows[(0.0, 0.75)] == (0, None)
    assert metrics.budget_threshold(df).first().threshold == 0.51
    assert metrics.budget_threshold(df.where("kind = 'change'")).first().threshold == 0.02
    assert metrics.budget_threshold(df, thresholds=[0.1]).count() == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(3.0,), (30.0,), (31.0,), (1.9,)], "s double")
    rows = {r.lo: r.clips for r in checks.length_histogram(df, F.col("s")).collect()}
    assert rows == {0.0: 1, 2.0: 0, 3.0: 1, 3.5: 0, 5.0: 0, 10.0: 0, 15.0: 1}


def test_best_and_stop_loop(form, spark):
    rng = np.random.default_rng(11)
    ap = [float(v) for v in np.round(rng.random(120), 3)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ap)], "step int, ap double")
    best, at, bad, stop = -1.0, None, 0, None
    for i, v in enumerate(ap):
        if v > best:
            best, at, bad = v, i, 0
        else:
            bad += 1
            if i >= 0.4 * 120 and bad >= 6:
                stop = i
                break
    row = metrics.best_and_stop(df, "ap", "step", 6, 120).first()
    assert (row.best_step, row.best_value, row.stop_step) == (at, best, stop)


def test_class_weight_equals_integral(spark):
    grid = spark.range(2001).select((0.5 + F.col("id") * 2.0 / 2000).alias("tc"))
    t = np.arange(300) * 0.01
    mass = np.mean([np.exp(-0.5 * ((t - c) / 0.075) ** 2)[np.abs(t - c) <= 0.15].sum() for c in np.linspace(0.5, 2.5, 2001)])
    row = checks.class_weight(grid, "tc").first()
    assert row.soft_frames == pytest.approx(mass, rel=1e-4)
    assert row.full == pytest.approx((300 - 0.4 * mass) / (0.4 * mass), rel=1e-4)


def test_range_energy_over_blocks(form, spark):
    rng = np.random.default_rng(21)
    chunks = [(k, i, [float(v) for v in rng.normal(size=int(rng.integers(0, 9)))]) for k in ("a", "b", None) for i in range(40)]
    streams = {k: np.concatenate([np.array(c[2]) for c in chunks if c[0] == k]) for k in ("a", "b", None)}
    asked = [(k, n, low, low + int(rng.integers(-2, 60))) for k in ("a", "b", None, "none") for n, low in enumerate([-5, 0, 3, 17, 60, 150, 160, 400])]
    df = spark.createDataFrame(chunks, "k string, i int, x array<double>")
    ranges = spark.createDataFrame(asked, "k string, n int, low int, high int")
    table = frames.energy_table(df, ["k"], ["i"], "x")
    got = {(r.k, r.n): (r.energy, r.rms) for r in frames.range_energy(table, ranges, ["k"], "low", "high").collect()}
    assert len(got) == len(asked)
    for k, n, low, high in asked:
        x = streams.get(k, np.zeros(0))[max(low, 0) : max(high, 0)]
        assert got[k, n] == (pytest.approx(np.sum(x**2), abs=1e-9), pytest.approx(np.sqrt(np.mean(x**2)), abs=1e-9) if len(x) else None)


def test_batch_inference_lengths_and_nulls(spark):
    frames.register_scorer("halves", lambda: lambda batch: batch.reshape(len(batch), 2, -1).mean(axis=2))
    rows = [(i, [float(i + j) for j in range(6)]) for i in range(10)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, x array<double>").repartition(3)
    got = {r.id: r.p for r in frames.predicted_windows(df, "x", "halves", 6, 2, batch=4).collect()}
    assert got == {i: [i + 1.0, i + 4.0] for i in range(10)} | {99: None}
    with pytest.raises(Exception, match="scorer output"):
        frames.predicted_windows(df, "x", "halves", 6, 3).collect()
    with pytest.raises(Exception, match="a window has 6 samples, not 5"):
        frames.predicted_windows(spark.createDataFrame([(1, [0.0] * 5)], "id int, x array<double>"), "x", "halves", 6, 2).collect()
    assert frames.predicted_windows(df, "x", "noop", 6, 2).count() == 0
    with pytest.raises(ValueError, match="no scorer"):
        frames.predicted_windows(df, "x", "unknown", 6, 2)
