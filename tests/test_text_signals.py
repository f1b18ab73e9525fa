import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from segflow.functions import draw, signals, text
from segflow.operators.lines import display_intervals
from segflow.operators.ordered import ordered


def test_format_compat(spark):
    cases = {
        "": "", "i think i": "I think I", "3 point 1 4 hello": "3.14hello", "12 34 56": "12 3456", "1234567": "1,234,567",
        "3 point 14159": "3.14,159", "in 19 84": "In 1984", "a  3 point 1": "A  3.1", "été i": "Été I", "99. 5": "99. 5",
        "x7 12 34": "X7 1234", "1999 and 5": "1,999 and 5",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "s string, want string")
    for r in df.select("s", "want", text.formatted("s", compat=True).alias("f")).collect():
        assert r.f == r.want, r.s


def test_format_default(spark):
    cases = {
        "": "",
        "i think i": "I think I",
        "3 point 1 4 hello": "3.14 hello",
        "0." + "1" * 70: "0." + "1" * 70, "3" + " " * 40 + "point" + " " * 40 + "1 point 4": "3.1 point 4", "1234567.1234567": "1,234,567.1234567",
        "3 point 14159": "3.14159",
        "12 34 56": "12 3456",
        "1234567": "1,234,567",
        "in 19 84": "In 1984",
        "in 19 84 5": "In 19 84 5",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "s string, want string")
    for r in df.select("s", "want", text.formatted("s").alias("f")).collect():
        assert r.f == r.want
    assert spark.createDataFrame([("in 19 84 5",)], "s string").select(text.formatted("s", years=True)).first()[0] == "In 1,984 5"  # commas follow the years


@pytest.mark.parametrize("width,lines", [(1, 2), (7, 1), (20, 2)])
def test_wrapping_keeps_words_and_widths(spark, width, lines):
    rng = random.Random(width)
    texts = ["", "   ", "a", "abcdefgh" * 9] + [
        " ".join("é" * rng.randint(1, 30) for _ in range(rng.randint(0, 12))) + "\n tail" for _ in range(80)
    ]
    df = spark.createDataFrame([(s,) for s in texts], "s string")
    for r in df.select("s", text.caption_chunks("s", width, lines).alias("c")).collect():
        rows = [line for chunk in r.c for line in chunk.split("\n")]
        assert all(0 < len(line) <= width and line == line.strip() for line in rows)
        assert all(chunk.count("\n") == lines - 1 for chunk in r.c[:-1])
        assert "".join("".join(rows).split()) == "".join(r.s.split())
        for one, two in zip(rows, rows[1:]):  # greedy: the next whole word did not fit
            assert len(one) == width or len(one) + 1 + len(two.split()[0]) > width
    with pytest.raises(ValueError):
        text.caption_chunks("s", 0)
    with pytest.raises(ValueError):
        text.caption_chunks("s", 5, 0)


@pytest.mark.parametrize("raw,width,want", [
    ("one two three", 7, ["one two\nthree"]), ("abcdefghij k", 4, ["abcd\nefgh", "ij k"]), ("a bb ccc dddd", 3, ["a\nbb", "ccc\nddd", "d"]),
])
def test_wrap_cases(spark, raw, width, want):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(text.caption_chunks("s", width, 2)).first()[0] == want


def test_overlap(spark):
    rows = [(["a", "b", "C"], ["c", "d"], 1), (["a"], ["b"], 0), (["x", "y"], ["X", "Y"], 2), (None, ["q"], 0), (["q"], [], 0), (["a", "a"], ["a", "a", "a"], 2)]
    df = spark.createDataFrame(rows, "p array<string>, n array<string>, k int")
    for r in df.select("n", "k", text.overlap("p", "n").alias("o"), text.without_overlap("p", "n").alias("w")).collect():
        assert r.o == r.k and r.w == r.n[r.k :]


def test_token_words(spark):
    rows = [
        (["▁he", "llo", "▁wor", "ld"], [0.1, 0.2, 0.5, 0.9], [-0.1, -0.3, -0.3, -0.5], "hello world"),
        (["he", "▁x"], [0.1, 0.4], None, "he x"),
        (["a"], [1.0, 2.0], None, "a"),
        (["▁a"], [1.0], [-0.1, -0.2], "a"),
        (["▁a"] * 9, [float(i) for i in range(9)], None, "one"),
    ]
    df = spark.createDataFrame(rows, "k array<string>, t array<double>, l array<double>, x string")
    got = [r[0] for r in df.select(text.token_words("k", "t", "l", "x")).collect()]
    assert [(w.text, w.start, w.end) for w in got[0]] == [("hello", 0.1, 0.5), ("world", 0.5, 0.9)]
    assert got[0][0].confidence == pytest.approx(np.exp(-0.2))
    assert [(w.text, w.start, w.end, w.confidence) for w in got[1]] == [("he", 0.1, 0.4, None), ("x", 0.4, 0.4, None)]
    assert got[2] is None and got[3][0].confidence is None and got[4] is None


def test_display_rules(form, spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (1, 1.0, "a " * 40), (1, 1.5, "b"), (2, 0.0, "x")], "k int, t double, s string")
    rows = display_intervals(ordered(df, ["k"], ["t"]), F.col("t"), text.display_seconds("s")).rows().collect()
    assert {(r.k, r.t): round(r.hidden_at, 3) for r in rows} == {(1, 0.0): 1.5, (1, 1.0): 3.7, (1, 1.5): 3.7, (2, 0.0): 2.2}


def test_unseen_text(spark):
    df = spark.createDataFrame([("ab cd", "ab"), ("ab cd", "xx"), ("ab", None)], "t string, p string")
    assert [r[0] for r in df.select(text.unseen_text("t", "p")).collect()] == ["cd", "ab cd", "ab"]


def one(spark, x, *columns):
    return spark.createDataFrame([([float(v) for v in x],)], "x array<double>").select(*columns).first()


def test_levels_and_guards(spark):
    zero = one(spark, [0, 0, 0, 0], signals.normalised("x"), signals.peak_limited("x"), signals.active_ratio("x", 2))
    assert zero[0] == [0.0] * 4 and zero[1] == [0.0] * 4 and zero[2] == 0.0
    x = np.random.default_rng(0).normal(size=64)
    loud, limited = one(spark, x, signals.normalised("x"), signals.peak_limited("x"))
    assert 20 * np.log10(np.sqrt(np.mean(np.square(loud))) + 1e-9) == pytest.approx(-23, abs=1e-4)
    assert limited == pytest.approx(list(x / np.abs(x).max() * 0.99))
    assert one(spark, [0.99, -0.5], signals.peak_limited("x"))[0] == [0.99, -0.5]


def test_active_ratio(spark):
    x = np.random.default_rng(1).normal(size=85) * np.repeat([1, 0.001, 0.5, 0.0, 2], 17)
    m = np.mean(x[:80].reshape(10, 8) ** 2, axis=1)
    floor = max(0.01 * np.sort(m)[min(9, int(0.95 * 10))], 1e-10)
    assert one(spark, x, signals.active_ratio("x", 8))[0] == pytest.approx(np.mean(m > floor))
    assert one(spark, [1.0], signals.active_ratio("x", 8))[0] == 0.0


def test_fades(spark):
    x = np.ones(10)
    fin, fout, none, one_sample = one(
        spark, x, signals.faded("x", 4, False), signals.faded("x", 4, True), signals.faded("x", 0, True), signals.faded("x", 1, False)
    )
    assert fin == pytest.approx([0, 1 / 3, 2 / 3, 1] + [1] * 6) and fout == pytest.approx([1] * 6 + [1, 2 / 3, 1 / 3, 0])
    assert none == [1.0] * 10 and one_sample == [0.0] + [1.0] * 9


def test_noise_mix(spark):
    x = np.random.default_rng(2).normal(size=50)
    mixed, skipped = one(spark, x, signals.mixed("x", signals.tiled(F.slice("x", 3, 20), 50), 12.0), signals.mixed("x", F.transform("x", lambda v: v * 0), 12.0))
    noise = np.resize(x[2:22], 50)
    scale = np.sqrt(np.mean(x**2) / 10**1.2 / np.mean(noise**2))
    assert mixed == pytest.approx(list(x + noise * scale)) and skipped == pytest.approx(list(x))


def test_assembly_overlaps_and_cuts(spark):
    row = one(spark, [0.1, 0.2, 0.3], signals.assembled("x", "x", 2, 4))
    assert row[0] == pytest.approx([0.1, 0.2, 0.4, 0.2])


def test_labels(spark):
    t = np.arange(300) * 0.01
    d = t - 1.234
    bump = np.exp(-0.5 * (d / 0.075) ** 2)
    df = spark.createDataFrame([([1.234], 1.234, [])], "c array<double>, t double, n array<double>")
    row = df.select(
        signals.label_frames("c", 3.0, shape="both").alias("both"),
        signals.label_frames("c", 3.0).alias("after"),
        signals.label_frames("c", 3.0, shape="hard").alias("hard"),
        signals.step_frames("t", 3.0).alias("step"),
        signals.label_frames("n", 3.0).alias("none"),
    ).first()
    assert row.both == pytest.approx(list(np.where(np.abs(d) <= 0.15, bump, 0)))
    assert row.after == pytest.approx(list(np.where((d >= 0) & (d <= 0.15), bump, 0)))
    assert row.hard == list(np.where(np.abs(d) <= 0.15, 1.0, 0.0))
    assert row.step == list(np.where(t >= 1.234, 1.0, 0.0)) and row.none == [0.0] * 300


def test_draws(spark):
    import hashlib

    df = spark.range(4000).select("id", draw.uniform(42, "id").alias("u"), draw.weighted("abc", [2, 1, 1], 1, "id").alias("w"))
    rows = df.collect()
    for r in rows[:50]:
        assert r.u == int(hashlib.md5(f"42:{r.id}".encode()).hexdigest()[:8], 16) / 2**32
    shares = [sum(r.w == c for r in rows) / 4000 for c in "abc"]
    assert shares == pytest.approx([0.5, 0.25, 0.25], abs=0.03)
