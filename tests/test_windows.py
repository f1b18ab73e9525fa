import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from segflow.operators import checks, splits, turns, windows

RECIPE = windows.Recipe(rate=20, active_frame=8, fade_ms=(50.0, 250.0))


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(4)
    rows = []
    for clip in range(60):
        n = int(rng.integers(8, 70))
        # clip 0..59 of speakers 0..5; speaker 5 has short clips only
        n = min(n, 20) if clip % 6 == 5 else n
        rows.append((clip, clip % 6, n, [float(v) for v in rng.normal(size=n)]))
    return spark.createDataFrame(rows, "clip long, spk long, len int, pcm array<double>").cache()


@pytest.fixture(scope="module")
def made(spark, pool):
    specs = windows.window_specs(spark.range(200), "id", 6, 5, RECIPE)
    genders = spark.createDataFrame([(i, "MF"[i % 2]) for i in range(6)], "name long, gender string")
    dimension = windows.indexed_speakers(genders, "name", "gender")
    specs = windows.with_partner(specs, dimension, "gender", 6, RECIPE).cache()
    pieces, sides = windows.window_sides(specs, windows.catalogue(pool, "spk", "clip", "len"), "spk", pool, "clip", "pcm", RECIPE)
    return specs, pieces.cache(), sides.cache()


def test_specs_keep_their_rules(made):
    specs = [r.asDict() for r in made[0].collect()]
    assert {s["kind"] for s in specs} == {"change", "fake", "nochange"}
    for s in specs:
        assert (s["t_change"] is not None) == (s["kind"] == "change")
        assert (s["snr_db"] is not None) == (s["noise_kind"] != "none")
        assert (s["spk_a"] != s["spk_b"]) == (s["kind"] == "change")
        if not s["reverb"]:
            assert s["rir_a"] == s["rir_b"] == -1 and s["wet"] == 0
        if s["rir_same"]:
            assert s["rir_a"] == s["rir_b"]
    same = np.mean([(s["spk_a"] - s["spk_b"]) % 2 == 0 for s in specs if s["kind"] == "change"])
    assert 0.4 < same < 0.95  # half by choice, others by chance


def test_sides_come_from_their_speaker(pool, made):
    clips = {r.clip: r for r in pool.collect()}
    specs = {r.spec_id: r for r in made[0].collect()}
    sides = {(r.spec_id, r.side): r for r in made[2].collect()}
    used: dict = {}
    stitched = 0
    for p in made[1].collect():
        if sides[(p.spec_id, p.side)]["try"] == p["try"]:
            used.setdefault((p.spec_id, p.side), []).append(p)
    for key, side in sides.items():
        spec, pieces = specs[key[0]], sorted(used[key], key=lambda p: p.piece)
        speaker = spec.spk_a if key[1] == "a" else spec.spk_b
        samples = []
        for p in pieces:
            assert clips[p.clip].spk == speaker and 0 <= p.start and p.start + p.len <= clips[p.clip].len
            samples += clips[p.clip].pcm[p.start : p.start + p.len]
        assert side.x == pytest.approx(samples[: pieces[0].need]) and len(side.x) == pieces[0].need
        stitched += len(pieces) > 1
        fits = [c for c in clips.values() if c.spk == speaker and c.len >= pieces[0].need]
        assert (len(pieces) == 1) == bool(fits) or pieces[0].len >= pieces[0].need
    assert stitched > 0
    for spec in specs.values():
        a, b = used[(spec.spec_id, "a")], used.get((spec.spec_id, "b"))
        if spec.kind == "nochange":
            assert b is None
        elif spec.kind == "fake" and len(a) == len(b) == 1:
            fits = [c for c in clips.values() if c.spk == spec.spk_b and c.len >= b[0].need]
            assert len(fits) == 1 or a[0].clip != b[0].clip


def ratio(x, frame=8):
    n = len(x) // frame
    if n == 0:
        return 0.0
    m = np.mean(np.reshape(x[: n * frame], (n, frame)) ** 2, axis=1)
    return np.mean(m > max(0.01 * np.sort(m)[min(n - 1, int(0.95 * n))], 1e-10))


def test_first_active_try_is_taken(spark, made):
    # clips that are silent for half of them, so that tries differ
    rng = np.random.default_rng(6)
    _, pieces, _ = made
    loud = {c: [float(v) for v in rng.normal(size=70) * (np.arange(70) % 24 < (24 if c % 3 else 6))] for c in range(60)}
    pool = spark.createDataFrame(list(loud.items()), "clip long, pcm array<double>")
    recipe = windows.Recipe(rate=20, active_frame=8, min_active=0.75)
    got = {(r.spec_id, r.side): r["try"] for r in windows.gathered(pieces, pool, "clip", "pcm", recipe).collect()}
    tries: dict = {}
    for p in pieces.orderBy("piece").collect():
        x, _ = tries.setdefault((p.spec_id, p.side), {}).setdefault(p["try"], ([], p.need))
        x += loud[p.clip][p.start : p.start + p.len]
    for key, options in tries.items():
        good = [k for k, (x, need) in sorted(options.items()) if ratio(np.array(x[:need])) >= 0.75]
        assert got[key] == (good[0] if good else 6)
    assert len(set(got.values())) > 2


def test_finished_windows(spark, made):
    specs, _, sides = made
    noise = spark.createDataFrame([("music", 0, [0.1, -0.2] * 10), ("noise", 0, [0.0] * 80), ("noise", 1, [0.3, -0.1] * 60)], "noise_kind string, place long, pcm array<double>")
    df = windows.channels(specs, sides, RECIPE).join(windows.with_noise(specs, noise, RECIPE).select("spec_id", "noise"), "spec_id")
    for r in windows.finished_windows(df, RECIPE, "noise").collect():
        assert len(r.wave) == 60 and len(r.labels) == 300 and len(r.step) == 300
        assert max(abs(v) for v in r.wave) <= 0.99 + 1e-12
        assert (max(r.labels) > 0.9) == (r.kind == "change") and (sum(r.step) > 0) == (r.kind == "change")


def test_turns_agree_with_labels(made):
    specs = {r.spec_id: r for r in made[0].collect()}
    found = {r.file_id: r.boundary_time_s for r in turns.boundaries(windows.turns_of(made[0])).collect()}
    assert found == {s.spec_id: pytest.approx(s.t_change, abs=6e-4) for s in specs.values() if s.kind == "change"}


def test_reverb_equals_convolution(spark):
    rng = np.random.default_rng(8)
    x, h = rng.normal(size=50), rng.normal(size=12)
    df = spark.createDataFrame([(1, [float(v) for v in x], 0, 0.3, 5, 40), (2, [float(v) for v in x], -1, 0.3, 5, 40)], "id int, wave array<double>, rir long, wet double, lo int, hi int")
    bank = spark.createDataFrame([(0, [float(v) for v in h])], "rir_id long, response array<double>")
    got = {r.id: r.wave for r in windows.reverberated(df, bank, "wave", "rir", span=("lo", "hi"), fade=4).collect()}
    h = h.copy()
    h[-4:] *= np.linspace(1, 0, 4)
    wet = np.convolve(x, h)[:50]
    wet *= np.sqrt(np.mean(x[5:40] ** 2) + 1e-9) / np.sqrt(np.mean(wet[5:40] ** 2) + 1e-9)
    assert got[1] == pytest.approx(list(0.7 * x + 0.3 * wet)) and got[2] == pytest.approx(list(x))


def test_reverb_of_rows_of_several_lengths(spark, monkeypatch):
    import pyarrow as pa

    rng, calls, plain = np.random.default_rng(8), [], np.fft.rfft
    waves = [rng.normal(size=n).tolist() for n in (0, 12, 12, 7, 12, 12, 7)]
    responses = [rng.normal(size=n).tolist() if n else None for n in (5, 5, 0, 5, 9, 5, 5)]
    wet, low, high = rng.uniform(size=7), [0, 2, 0, 3, 5, 0, 1], [0, 9, 4, 3, 12, None, 7]
    monkeypatch.setattr(np.fft, "rfft", lambda *a: calls.append(1) or plain(*a))
    got = windows._heard(pa.array(waves, pa.list_(pa.float64())), pa.array(responses), wet, pa.array(low), pa.array(high), 4).to_pylist()
    assert len(calls) == 6  # two for each of three pairs of lengths, not two for each row
    for i, (x, h) in enumerate(zip(waves, responses)):
        if h is not None and x:
            x, h = np.array(x), np.array(h)
            h[-4:] *= np.linspace(1.0, 0.0, 4)
            y = np.convolve(x, h)[: len(x)]
            part = slice(low[i], high[i] if high[i] is None or high[i] > low[i] else low[i] + 1)
            x = (1 - wet[i]) * x + wet[i] * y * np.sqrt((np.mean(x[part] ** 2) + 1e-9) / (np.mean(y[part] ** 2) + 1e-9))
        assert np.allclose(got[i], x)


def test_sides_draw_specifications_once(spark, pool):
    specs = windows.window_specs(spark.range(20), "id", 6, 5, RECIPE).withColumn("spk_b", F.col("spk_a"))
    pieces = windows.window_sides(specs, windows.catalogue(pool, "spk", "clip", "len"), "spk", pool, "clip", "pcm", RECIPE)[0]
    assert "42-kind" in specs._jdf.queryExecution().toString() and "42-kind" not in pieces._jdf.queryExecution().toString()


def test_prepared_response(spark):
    x = [0.0, 0.1, -2.0, 1.0, 0.5, 0.25, 0.1]
    row = spark.createDataFrame([(x,), ([0.0, 0.0],)], "x array<double>").select(windows.prepared_response("x", 8, 3).alias("r")).collect()
    y = np.array(x[2:])
    y[-3:] *= 0.5 * (1 + np.cos(np.linspace(0, np.pi, 3)))
    y = y / np.sqrt(np.sum(y**2))
    assert row[0].r == pytest.approx(list(y) + [0.0] * 3) and row[1].r is None


def test_recipe_refuses_wide_gaps():
    with pytest.raises(ValueError):
        windows.Recipe(gaps=(-0.3, 0.0))


def test_split_sizes_and_holdout(form, spark):
    ids = spark.range(101)
    sizes = {r.split: r["count"] for r in splits.entity_split(ids, "id").groupBy("split").count().collect()}
    assert sizes == {"train": 70, "val": 15, "test": 16}
    assert checks.straddling(splits.entity_split(ids, "id"), "id").count() == 0
    items = spark.range(600).select("id", (F.col("id") % 2).alias("cat"), (F.col("id") % 38).alias("grp"))
    held = splits.group_holdout(items, "cat", "grp", "id")
    assert held.count() == 600
    assert checks.straddling(held, "grp").count() == 0
    groups = {(r.cat, r.split): r.n for r in held.groupBy("cat", "split").agg(F.countDistinct("grp").alias("n")).collect()}
    assert groups == {(0, "val"): 1, (0, "train"): 18, (1, "val"): 1, (1, "train"): 18}


def test_running_offsets(form, spark):
    rows = [(i, (i * 7919) % 50 + 1) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, len long")
    got = {r.id: r.clip_start for r in splits.running_offsets(df, ["id"], "len").collect()}
    upto = 0
    for i, n in rows:
        assert got[i] == upto
        upto += n


def test_all_pairs_come_from_their_numbers(spark):
    for n in (1, 2, 5, 50):
        rows = [tuple(r) for r in splits.unordered_pairs(spark.range(n), "id").collect()]
        assert sorted(rows) == [(a, b) for a in range(n) for b in range(a + 1, n)]


@pytest.mark.parametrize("n", [2, 3, 71, 400])
def test_numbered_pairs_visit_every_pair_once(spark, n):
    size = n * (n - 1) // 2
    jobs = spark.range(size + 5).withColumnRenamed("id", "job")
    rows = splits.pair_schedule(spark.range(n), "id", jobs, "job").orderBy("job").collect()
    pairs = [tuple(sorted((r.speaker_a, r.speaker_b))) for r in rows]
    assert len(set(pairs[:size])) == size and pairs[size:] == pairs[:5]
    assert all(0 <= a < b < n for a, b in pairs)


def test_clips_are_numbered_by_length_in_both_forms(form, spark):
    rng = np.random.default_rng(31)
    clips = [(c, 0 if rng.random() < 0.6 else int(rng.integers(1, 4)), int(rng.integers(1, 12))) for c in range(300)]
    index = windows.catalogue(spark.createDataFrame(clips, "clip long, spk int, len int"), "spk", "clip", "len")
    own = {s: sorted((n, c) for c, k, n in clips if k == s) for s in range(4)}
    got = {(r.spk, r.place): (r.len, r.clip) for r in index.collect()}
    assert got == {(s, i): e for s, rows in own.items() for i, e in enumerate(rows)}
    asked = spark.createDataFrame([(s, need) for s in range(5) for need in range(1, 14)], "spk int, need int")
    for r in windows.fitting_from(asked, index, "spk").collect():
        longer = [i for i, (n, _) in enumerate(own.get(r.spk, [])) if n >= r.need]
        assert r["from"] == (longer[0] if longer else None)


def test_only_tries_that_are_needed_are_judged(spark, monkeypatch):
    seen, judged = [], windows._judged
    monkeypatch.setattr(windows, "_judged", lambda pieces, *more: seen.append({(r.spec_id, r["try"]) for r in pieces.collect()}) or judged(pieces, *more))
    clips = spark.createDataFrame([(0, [1.0] * 16), (1, [0.0] * 16)], "clip long, pcm array<double>")
    # side 0 is loud at once, side 1 in its second try, side 2 never; side 3 is stitched; side 1 comes twice
    order = {0: (0, 1, 1), 1: (1, 0, 1), 2: (1, 1, 1)}
    rows = [(k, t, "a", 16, 1, 0, c, 0, 0, 16) for k, own in [*order.items(), (1, order[1])] for t, c in enumerate(own, 1)]
    rows += [(3, t, "a", 32, 2, p, 0, 0, 0, 16) for t in (1, 2, 3) for p in (0, 1)]
    pieces = spark.createDataFrame(rows, "spec_id long, try int, side string, need int, pieces int, piece int, clip long, place long, start int, len int")
    sides = windows.gathered(pieces, clips, "clip", "pcm", windows.Recipe(rate=20, active_frame=8, tries=3))
    assert sorted((r.spec_id, r["try"], len(r.x)) for r in sides.collect()) == [(0, 1, 16), (1, 2, 16), (2, 3, 16), (3, 1, 32)]
    assert seen == [{(0, 1), (1, 1), (2, 1), (3, 1)}, {(1, 2), (2, 2)}, {(2, 3)}]


@pytest.mark.parametrize("shape", ["after", "hard"])
def test_labels_meet_by_blocks_of_frames(spark, shape):
    draw = np.random.default_rng(17)
    at = {f: sorted({round(float(v), 2) for v in draw.uniform(0, 4, 9)}) for f in range(4)} | {9: [0.0, 0.05, 0.63, 0.64]}
    rows = [(f, s, s + 0.3, f"{k % 2}") for f, times in at.items() for k, s in enumerate(times)]
    made = turns.frame_labels(spark.createDataFrame(rows, "file_id long, start_s double, end_s double, speaker_id string"), shape=shape)
    want = {}
    for f, times in at.items():
        for frame in range(round((times[-1] + 0.3) / 0.01)):
            d = frame * 0.01 - np.array(times[1:])
            inside = np.abs(d) <= 0.15 if shape == "hard" else (d >= 0) & (frame * 0.01 <= np.array(times[1:]) + 0.15)
            value = np.where(inside, 1.0 if shape == "hard" else np.exp(-0.5 * (d / 0.075) ** 2), 0.0).max()
            if value > 0:
                want[f, frame] = value
    assert {(r.file_id, r.frame): r.label for r in made.collect()} == pytest.approx(want)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        made.explain()
    assert not [line for line in plan.getvalue().splitlines() if "Aggregate" in line and "frame" in line]
