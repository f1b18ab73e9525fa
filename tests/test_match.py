import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from segflow.operators.match import _Collar, best_threshold, collar_sweep, collar_walk, file_scores, matched_pairs, sweep_counts


def frames(spark, truth, predictions):
    a = spark.createDataFrame(truth, "f string, id int, at_us long")
    b = spark.createDataFrame(predictions, "f string, id int, at_us long, confidence double")
    return a, b


def greedy(truth, predictions, collar, threshold):
    """Pairs by the literal rule: each prediction takes the first free boundary in reach."""
    taken, pairs = set(), []
    for p in sorted((p for p in predictions if p[3] >= threshold), key=lambda p: (p[2], p[1])):
        for g in sorted(truth, key=lambda g: (g[2], g[1])):
            if g[0] == p[0] and abs(g[2] - p[2]) <= collar and g[1] not in taken:
                taken.add(g[1])
                pairs.append((p[1], g[1]))
                break
    return pairs


@pytest.mark.parametrize("density", [200, 20000])
def test_sweep_equals_literal_rule(form, spark, density):
    rng = random.Random(density)
    truth = [(rng.choice("aaab"), i, rng.randint(0, density)) for i in range(120)]
    predictions = [(rng.choice("aaabc"), i, rng.randint(0, density), rng.randint(0, 20) / 20) for i in range(150)]
    a, b = frames(spark, truth, predictions)
    thresholds = [0.0, 0.35, 0.6, 0.95]
    for row in collar_sweep(a, b, ["f"], 60, thresholds).collect():
        pairs = greedy(truth, predictions, 60, row.threshold)
        made = sum(p[3] >= row.threshold for p in predictions)
        assert (row.tp, row.fp, row.fn) == (len(pairs), made - len(pairs), len(truth) - len(pairs))
        # every boundary and every prediction is counted once
        assert row.tp + row.fn == len(truth) and row.tp + row.fp == made
    got = {(r.prediction_id, r.truth_id) for r in matched_pairs(a, b, ["f"], 60).collect()}
    assert got == set(greedy(truth, predictions, 60, 0.0))


def test_first_free_boundary_and_exact_collar(spark):
    a, b = frames(spark, [("x", 0, 1000), ("x", 1, 1200)], [("x", 0, 1100, 1.0), ("x", 1, 1200, 1.0), ("x", 2, 1451, 1.0)])
    row = collar_sweep(a, b, ["f"], 250, [0.5]).first()
    assert (row.tp, row.fp, row.fn) == (2, 1, 0)
    row = collar_sweep(*frames(spark, [("x", 0, 1000)], [("x", 0, 1250, 1.0)]), ["f"], 250, [0.5]).first()
    assert (row.tp, row.fp, row.fn) == (1, 0, 0)


def test_files_on_one_side_only(spark):
    a, b = frames(spark, [("t", 0, 5), ("t", 1, 9000)], [("p", 0, 5, 0.9), ("q", 1, 5, 0.1)])
    counts = {r.f: (r.tp, r.fp, r.fn) for r in sweep_counts(collar_walk(a, b, ["f"], 10, [0.5]), [0.5], ["f"]).collect()}
    assert counts == {"t": (0, 0, 2), "p": (0, 1, 0), "q": (0, 0, 0)}
    row = collar_sweep(a, b, ["f"], 10, [0.95]).first()
    assert (row.precision, row.recall, row.f1, row.accuracy) == (0.0, 0.0, 0.0, 0.0)


def test_file_scores_floor_denominators(spark):
    a, b = frames(spark, [("t", 0, 5)], [("p", 0, 5, 0.9)])
    rows = {r.f: (r.precision, r.recall, r.f1) for r in file_scores(collar_walk(a, b, ["f"], 10), ["f"]).collect()}
    assert rows == {"t": (0.0, 0.0, 0.0), "p": (0.0, 0.0, 0.0)}


def test_lowest_threshold_wins_ties(spark):
    rows = spark.createDataFrame([(0.1, 0.5), (0.2, 0.7), (0.3, 0.7)], "threshold double, f1 double")
    assert best_threshold(rows).first().threshold == 0.2


def walked(kind, level, open_now, first, enter, state):
    """Row by row: an arrival adds one, a prediction takes one where it can, an expiry leaves at most ``open_now``."""
    hits, waiting, queue = [], [], list(state)
    for i, new in enumerate(first):
        if new:
            queue = list(enter.get(i, [0] * len(queue)))
        mask = 0
        waiting.append(queue[0])
        for k in range(len(queue)):
            if kind[i] == 0:
                queue[k] += 1
            elif kind[i] == 2:
                queue[k] = min(queue[k], open_now[i])
            elif k < level[i] and queue[k] > 0:
                queue[k] -= 1
                mask |= 1 << k
        hits.append(mask)
    return hits, waiting, queue


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 70), st.integers(1, 62))
def test_composed_clamps_equal_the_walk(seed, n, levels):
    draw = np.random.default_rng(seed)
    columns = {"kind": draw.integers(0, 3, n).astype(np.int32), "level": draw.integers(0, levels + 1, n).astype(np.int32), "open": draw.integers(0, 4, n)}
    first, state = draw.random(n) < 0.1, draw.integers(0, 5, levels)
    enter = {int(i): draw.integers(0, 5, levels) for i in np.flatnonzero(first) if draw.random() < 0.5}
    kernel = _Collar(levels)
    kernel.SLICE = 13
    out, after = kernel.run(columns, first, enter, state)
    assert (out["hits"].tolist(), out["waiting"].tolist(), after.tolist()) == walked(*columns.values(), first, enter, state)
    whole = walked(*columns.values(), np.zeros(n, bool), {}, state)[2]
    assert kernel.follow(state, kernel.summary(columns)).tolist() == whole
