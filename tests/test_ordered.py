import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from segflow.operators.joins import asof, with_default
from segflow.operators.lines import endpointed
from segflow.operators.ordered import lag, last, lead, number, ordered, peak, percentiles, total
from segflow.operators.spacing import RULES, Spaced, spaced, throttle


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    # key 1 holds most of the rows
    return [(rng.choice([1, 1, 1, 1, 2, 3]), i, rng.randint(0, 8000) / 1000, rng.choice("abc")) for i in range(500)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k int, id int, t double, s string").cache()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0], r[2], r[1]))


def test_running_values(form, df, rows):
    mark = F.when(F.col("s") == "a", F.col("id"))
    got = ordered(df, ["k"], ["t", "id"])
    assert got.split == (form == "blocks")
    got = got.scan(a=lag("id"), b=lead("id"), c=total("id"), d=peak("id"), e=last(mark), f=number())
    table = {r.id: r for r in got.rows().collect()}
    seen: dict = {}
    ordered_rows = in_order(rows)
    for i, (k, id_, _, s) in enumerate(ordered_rows):
        state = seen.setdefault(k, {"prev": None, "sum": 0, "max": -1, "last": None, "n": 0})
        state["sum"] += id_
        state["max"] = max(state["max"], id_)
        state["n"] += 1
        if s == "a":
            state["last"] = id_
        after = ordered_rows[i + 1] if i + 1 < len(ordered_rows) else None
        nxt = after[1] if after and after[0] == k else None
        r = table[id_]
        assert (r.a, r.b, r.c, r.d, r.e, r.f) == (state["prev"], nxt, state["sum"], state["max"], state["last"], state["n"])
        state["prev"] = id_


def test_a_null_key_is_a_key(form, spark):
    data = [(None if i % 5 else "k", i) for i in range(120)]
    rows = ordered(spark.createDataFrame(data, "k string, id long"), ["k"], ["id"]).scan(a=lag("id"), c=total("id"), n=number()).rows().collect()
    for key in (None, "k"):
        run, before = 0, None
        for at, r in enumerate(sorted((r for r in rows if r.k == key), key=lambda r: r.id), 1):
            run += r.id
            assert (r.a, r.c, r.n) == (before, run, at)
            before = r.id
    kept = spaced(spark.createDataFrame(data, "k string, id long"), ["k"], ["id"], "id", 7, "offline")
    for key in (None, "k"):
        own, last_id = [i for k, i in data if k == key], None
        want = []
        for i in own:
            if last_id is None or i - last_id >= 7:
                want.append(i)
                last_id = i
        assert sorted(r.id for r in kept.where("k is null" if key is None else "k = 'k'").collect()) == want


def test_running_values_without_keys(form, df, rows):
    got = ordered(df, [], ["t", "id"]).scan(c=total("id"), n=number()).rows().collect()
    at = {r.id: (r.c, r.n) for r in got}
    run = 0
    for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1])), 1):
        run += r[1]
        assert at[r[1]] == (run, n)


@pytest.mark.parametrize("rule,gap", [("offline", 0.5), ("harness", 0.3), ("live", 1.0)])
@pytest.mark.parametrize("shuffled", [False, True])
def test_spacing_equals_loop(form, df, rows, rule, gap, shuffled):
    place = (lambda r: int(r[2] + r[1] % 4)) if shuffled else (lambda r: 0)
    frame = df.withColumn("w", F.floor(F.col("t") + F.col("id") % 4)) if shuffled else df
    order = ["w", "t", "id"] if shuffled else ["t", "id"]
    got = sorted(r.id for r in spaced(frame, ["k"], order, "t", gap, rule).collect())
    kept, want = {}, []
    for r in sorted(rows, key=lambda r: (r[0], place(r), r[2], r[1])):
        if r[0] not in kept or RULES[rule](r[2], kept[r[0]], gap):
            kept[r[0]] = r[2]
            want.append(r[1])
    assert got == sorted(want)


def test_spacing_at_the_limit(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.5), (1, 1.0), (1, 2.5)], "k int, t double")
    times = lambda rule, gap: sorted(r.t for r in spaced(df, ["k"], ["t"], "t", gap, rule).collect())
    assert times("offline", 0.5) == [0.0, 0.5, 1.0, 2.5]
    assert times("harness", 0.5) == [0.0, 1.0, 2.5]
    assert times("live", 1.0) == [0.0, 1.0, 2.5]


def test_throttle_equals_loop(form, df, rows):
    got = sorted(r.id for r in throttle(ordered(df, ["k"], ["t", "id"]), "t", "s", 0.25).where(F.col("kept")).rows().collect())
    shown, want = {}, []
    for r in in_order(rows):
        at, text = shown.get(r[0], (None, ""))
        if r[3] != text and (at is None or r[2] - at >= 0.25):
            shown[r[0]] = (r[2], r[3])
            want.append(r[1])
    assert got == sorted(want)


def test_endpoints_equal_loop(form, df, rows):
    frame = df.withColumn("spoken", F.col("s") == "a")
    got = endpointed(ordered(frame, ["k"], ["t", "id"]), "t", "spoken", 0.12, 0.05, 1.0).rows().collect()
    lines = {r.id: r.line for r in got}
    state, n = {}, {}
    for k, id_, t, s in in_order(rows):
        cur = state.get(k)
        if cur is None or t - cur[1] >= 0.12 or (cur[2] and t - cur[1] >= 0.05) or t - cur[0] >= 1.0:
            cur = (t, t, False)
            n[k] = n.get(k, 0) + 1
        state[k] = (cur[0], t, cur[2] or s == "a")
        assert lines[id_] == n[k]


def test_percentiles_are_exact(form, df, rows):
    got = {r.k: (r.p10, r.p95) for r in percentiles(df, ["k"], "t", {"p10": 0.1, "p95": 0.95}).collect()}
    for k in {r[0] for r in rows}:
        want = np.percentile([r[2] for r in rows if r[0] == k], [10, 95])
        assert got[k] == pytest.approx(tuple(want))
    whole = percentiles(df, [], "t", {"p50": 0.5}).first().p50
    assert whole == pytest.approx(np.percentile([r[2] for r in rows], 50))


def test_asof_is_inclusive(form, spark, df, rows):
    stamps = df.where("s = 'a'").select("k", "t", F.col("id").alias("word"))
    stamps = stamps.groupBy("k", "t").agg(F.max("word").alias("word"))
    asked = df.where("s = 'b'").select("k", "t", "id")
    got = {r.id: r.word for r in asof(asked, stamps, ["k"], "t", "word", F.lit(-1), "id").collect()}
    for k, id_, t, s in rows:
        if s == "b":
            before = [(r[2], r[1]) for r in rows if r[0] == k and r[3] == "a" and r[2] <= t]
            latest = max((x[0] for x in before), default=None)
            assert got[id_] == (max(x[1] for x in before if x[0] == latest) if before else -1)


def test_default_of_missing_dimension_rows(spark):
    clips = spark.createDataFrame([("a",), ("b",)], "spk string")
    genders = spark.createDataFrame([("a", "F")], "spk string, gender string")
    assert {tuple(r) for r in with_default(clips, genders, "spk", "gender", "U").collect()} == {("a", "F"), ("b", "U")}


def test_joins_do_not_broadcast_beyond_the_limits(spark):
    from segflow.operators.joins import join_small
    from segflow.session import BROADCAST_BYTES, BROADCAST_ROWS, small_enough

    small = spark.range(100).select("id", F.array_repeat(F.lit(1.0), 50).alias("x"), F.struct(F.lit("a").alias("s")).alias("t"))
    big = spark.range(1000).select((F.col("id") % 100).alias("id"))
    assert small_enough(small)
    for conf, value in ((BROADCAST_ROWS, "99"), (BROADCAST_BYTES, "20000")):
        spark.conf.set(conf, value)
        try:
            assert not small_enough(small)
            assert join_small(big, small, ["id"]).count() == 1000
        finally:
            spark.conf.unset(conf)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 80), st.sampled_from(sorted(RULES)), st.booleans(), st.sampled_from([1, 10]))
def test_pointer_doubling_equals_the_loop(seed, n, rule, ascending, parts):
    draw = np.random.default_rng(seed)
    xs = draw.integers(0, 40, n) / parts
    xs, gap, far = np.sort(xs) if ascending else xs, float(draw.integers(1, 15)) / parts, RULES[rule]
    first = draw.random(n) < 0.15
    enter = {int(i): float(draw.integers(0, 40)) for i in np.flatnonzero(first) if draw.random() < 0.5}
    begun = state = None if draw.random() < 0.4 else float(draw.integers(0, 40))
    kept = []
    for i, x in enumerate(xs.tolist()):
        state = enter.get(i) if first[i] else state
        kept.append(state is None or bool(far(x, state, gap)))
        state = x if kept[-1] else state
    out, after = Spaced("x", gap, rule).run({"x": xs}, first, enter, begun)
    assert out["kept"].tolist() == kept and after == state
