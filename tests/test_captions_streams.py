import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from segflow.operators import captions, lines
from segflow.operators.ordered import ordered
from segflow.session import scratch_path
from segflow.streaming import processors
from segflow.streaming.runs import drained, in_triggers, parts_to_stream


def make_rows(seed: int, streams: int = 3):
    """Random recogniser updates per 0.1 s chunk and change events, with replayed words."""
    rng = random.Random(seed)
    updates, changes = [], []
    for s in range(streams):
        clock, seq, tail = 0.0, 0, []
        for _ in range(4 if s else 12):
            words = [w.upper() if rng.random() < 0.3 else w for w in tail[-rng.randint(0, 3) :]] if tail else []
            for _ in range(rng.randint(3, 30)):
                clock, seq = round(clock + 0.1, 3), seq + 1
                if rng.random() < 0.5:
                    words = words + [rng.choice("abcdefg") * rng.randint(1, 4)]
                updates.append((s, seq, clock, " ".join(words), None, 0.5))
                if rng.random() < 0.12:
                    changes.append((s, round(clock - rng.random() * 3 - 0.001 * seq, 4), clock))
            clock, seq = round(clock + 0.1, 3), seq + 1
            if words:
                updates.append((s, seq, clock, "", " ".join(words), 0.9))
                tail = words
    return updates, changes


def literal(updates, changes, lag=0.8, settle=0.1):
    """One stream at a time, written from the rule's description."""
    out = []
    for s in sorted({u[0] for u in updates}):
        memory, shown, known, stamps, waiting, start, late = [], 0, [], [], [], 0.0, 0
        mine = [(u[2], 1, u[1], 0.0, u) for u in updates if u[0] == s] + [(c[2], 0, 0, c[1], c) for c in changes if c[0] == s]
        for clock, kind, _, _, row in sorted(mine, key=lambda m: m[:4]):

            def resolve(final, confidence):
                nonlocal shown, start, late, waiting
                due = sorted(t for t in waiting if final or clock >= t + lag + settle)
                waiting = [t for t in waiting if t not in due]
                for t in due:
                    if t <= start:
                        late += 1
                        continue
                    count = shown
                    for at, n in stamps:
                        if at <= t + lag:
                            count = n
                    cut = max(shown, min(count, len(known)))
                    if known[shown:cut]:
                        out.append((s, round(clock, 3), " ".join(known[shown:cut]), round(t - start, 6), confidence, "change"))
                        shown, start = cut, t

            if kind == 0:
                waiting.append(row[1])
                continue
            words = (row[4] if row[4] is not None else row[3]).split()
            again = 0
            for k in range(1, min(len(memory), len(words)) + 1):
                if [w.lower() for w in memory[-k:]] == [w.lower() for w in words[:k]]:
                    again = k
            fresh = words[again:]
            if row[4] is not None:
                known = fresh
                resolve(True, row[5])
                if known[shown:]:
                    out.append((s, round(clock, 3), " ".join(known[shown:]), round(clock - start, 6), row[5], "final"))
                memory, shown, known, stamps, waiting, start = words[-5:], 0, [], [], [], clock
            else:
                if len(fresh) != len(known):
                    stamps.append((clock, len(fresh)))
                known = fresh
                resolve(False, row[5])
    return sorted(out)


def frames(spark, updates, changes):
    a = spark.createDataFrame(updates, "stream_id long, seq long, clock_s double, partial string, final string, confidence double")
    b = spark.createDataFrame(changes, "stream_id long, time_s double, detected_at_s double")
    return a, b


def plain(rows):
    return sorted((r.stream_id, round(r.emitted_s, 3), r.text, round(r.duration_s, 6), r.confidence, r.cause) for r in rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_equals_literal_rule(form, spark, seed):
    updates, changes = make_rows(seed)
    a, b = frames(spark, updates, changes)
    rows = captions.utterances(a, b, flush=False).cache()
    want = literal(updates, changes)
    assert plain(captions.caption_lines(rows, a, display=False).collect()) == want
    counts = captions.session_counts(rows).agg(F.sum("splits"), F.sum("lines")).first()
    assert tuple(counts) == (sum(w[5] == "change" for w in want), len(want))


def test_stream_equals_batch_over_several_triggers(spark):
    updates, changes = make_rows(4)
    a, b = frames(spark, updates, changes)
    top = max(u[2] for u in updates) + 1
    edges = [0, top * 0.3, top * 0.6, top + 1]
    cut = lambda df, c: [df.where((F.col(c) >= lo) & (F.col(c) < hi)).coalesce(1) for lo, hi in zip(edges, edges[1:])]
    ups = parts_to_stream(spark, cut(a, "clock_s"), "u", 1)
    chs = parts_to_stream(spark, cut(b, "detected_at_s"), "c", 1)
    got = drained(spark, processors.stream_captions(ups, chs), "cap").collect()
    # emission can move to the timer, the lines are the same
    strip = lambda rows: sorted((r[0], r[2], r[3], r[5]) for r in rows)
    assert strip(plain(got)) == strip(literal(updates, changes))


def test_late_change_and_silence(spark):
    updates = [(1, 1, 1.0, "a b", None, 0.5), (1, 2, 2.0, "a b", None, 0.5), (1, 3, 3.0, "", "a b c", 0.9), (1, 4, 6.0, "d", None, 0.5), (1, 5, 7.0, "", "d", 0.9)]
    changes = [(1, 0.9, 1.5), (1, 2.5, 4.0), (1, 0.95, 1.6)]
    a, b = frames(spark, updates, changes)
    rows = captions.utterances(a, b).cache()
    assert [r.text for r in captions.caption_lines(rows, a, display=False).orderBy("emitted_s").collect()] == ["a b", "c", "d"]
    assert rows.agg(F.sum("late")).first()[0] == 1  # 2.5 lies before the line that starts at 3.0


def literal_gate(chunks, pre_roll, gap):
    out, held, quiet, clock, session, was = [], [], 0, 0, 0, False
    for frame, ms, active in chunks:
        if active:
            if not was:
                if quiet - sum(m for _, m in held) >= gap:
                    session += 1
                quiet = 0
                for f, m in held:
                    clock += m
                    out.append((f, clock, session))
                held = []
            clock += ms
            out.append((frame, clock, session))
        else:
            held = (held + [(frame, ms)])[-pre_roll:]
            quiet += ms
        was = active
    return out


def test_gate_batch_and_stream(form, spark):
    rng = random.Random(5)
    active, chunks = False, []
    for i in range(400):
        active = active if rng.random() < 0.85 else not active
        chunks.append((1, i, i * 100_000, 100, active))
    df = spark.createDataFrame(chunks, "stream_id long, frame long, at_us long, ms long, active boolean")
    want = literal_gate([(c[1], c[3], c[4]) for c in chunks], 4, 500)
    gated = lines.admitted(df, ["stream_id"], "frame", "active", cell=16)
    rows = lines.audio_clock(ordered(gated, ["stream_id"], ["frame"]), "ms", 500).rows()
    assert sorted((r.frame, r.audio_clock, r.session) for r in rows.collect()) == want
    if form == "plain":
        parts = [df.where(F.col("frame").between(lo, lo + 99)).coalesce(1) for lo in range(0, 400, 100)]
        got = drained(spark, processors.stream_gate(parts_to_stream(spark, parts, "g", 1), 4, 500), "gate").collect()
        assert sorted((r.frame, r.audio_clock, r.session) for r in got) == want


def test_line_stream_over_several_triggers(spark):
    rng, t, rows = random.Random(6), 0, []
    for i in range(300):
        t += int(rng.expovariate(1 / 700_000)) + 1
        rows.append((1, i, t, rng.random() < 0.3, "update"))
    df = spark.createDataFrame(rows + [(1, 999, t, False, "flush")], "stream_id long, event_id long, at_us long, spoken boolean, kind string")
    parts = [df.where(F.col("event_id").between(lo, hi)).coalesce(1) for lo, hi in ((0, 99), (100, 199), (200, 999))]
    got = drained(spark, processors.stream_lines(parts_to_stream(spark, parts, "l", 1), lateness="0 seconds"), "lines")
    batch = lines.endpointed(ordered(df.where("kind = 'update'"), ["stream_id"], ["at_us", "event_id"]), "at_us", "spoken", 2_400_000, 1_200_000, 20_000_000)
    as_rows = lambda d: sorted((r.line, r.start, r.end, r.updates) for r in d.collect())
    assert as_rows(got) == as_rows(lines.line_spans(batch, "at_us"))


def test_live_detection_stream(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    audio = rng.random(400)
    chunks = [(1, i, i * 100_000, 0, [float(v) for v in audio[i * 5 : i * 5 + 5]]) for i in range(80)]
    df = spark.createDataFrame(chunks, "stream_id long, seq long, at_us long, session int, samples array<double>")
    parts = [df.where(F.col("seq").between(lo, lo + 39)).coalesce(1) for lo in (0, 40)]

    def scorer():
        return lambda batch: batch

    found = processors.stream_changes(
        parts_to_stream(spark, parts, "d", 1), scorer, rate=10, window_s=3.0, hop_s=0.5, threshold=0.55, k=5, left_s=0.5, right_s=1.0, radius_s=0.31, gap_s=1.0, frame_s=0.1
    )
    got = sorted((round(r.time_s, 6), round(r.detected_at_s, 6)) for r in drained(spark, found, "live").collect())
    want, latest = [], None
    for end in range(30, 401, 5):
        p = np.convolve(np.pad(audio[end - 30 : end], 2, mode="edge"), np.ones(5) / 5, mode="valid")
        for i in range(5, 20):
            if p[i] >= 0.55 and p[i] >= p[i - 3 : i + 4].max():
                t = (end - 30) / 10 + i * 0.1
                if latest is None or abs(t - latest) >= 1.0:
                    want.append((round(t, 6), round(end / 10, 6)))
                    latest = t
    assert got == sorted(want)
    with pytest.raises(ValueError):
        processors.stream_changes(df, scorer, left_s=2.0, right_s=1.5)


def test_backlog_and_segments(spark):
    df = spark.createDataFrame([(1, 0, 70), (1, 0, 50), (1, 1, 10)], "k int, tick int, n long")
    assert {tuple(r) for r in lines.backlog(df, ["k"], F.col("tick"), "n", 100).collect()} == {(1, 0, 120, 2, 20), (1, 1, 10, 1, 0)}
    on = [(1, t, 0.9) for t in (0, 1, 2, 5, 6, 20, 40, 41, 42, 43, 44, 45, 46)]
    rows = ordered(spark.createDataFrame(on, "k int, t int, p double"), ["k"], ["t"])
    got = sorted((r.start, r.end) for r in lines.speech_segments(rows, "t", "p", 0.5, 1, 3, 2, 5).collect())
    assert got == [(0, 5), (5, 7), (40, 45), (45, 47)]


def test_chunk_windows(spark):
    df = spark.createDataFrame([(1, 0, 300), (1, 1, 300), (1, 2, 0), (1, 3, 1000)], "k int, i int, n long")
    rows = lines.chunk_windows(df, ["k"], ["i"], "n", 512).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r.window_no] = sizes.get(r.window_no, 0) + r.to_sample - r.from_sample
    assert sizes == {0: 512, 1: 512, 2: 512}


def test_an_open_line_is_flushed(spark):
    updates = [(1, 1, 1.0, "a b", None, 0.5), (1, 2, 2.0, "", "a b", 0.9), (1, 3, 3.0, "b c", None, 0.4), (1, 4, 3.5, "b c d", None, 0.4)]
    a, b = frames(spark, updates, [(1, 2.6, 3.6)])
    text = lambda flush: [(r.text, r.cause) for r in captions.caption_lines(captions.utterances(a, b, flush=flush), a, display=False).orderBy("emitted_s", "part").collect()]
    assert text(False) == [("a b", "final")]
    assert text(True) == [("a b", "final"), ("c", "change"), ("d", "flush")]


def test_a_commit_clears_the_screen(spark):
    rows = [(1, 1, 0, "a", None), (1, 2, 1_000_000, "a", "a"), (1, 3, 2_000_000, "b", None), (1, 4, 3_000_000, "b", None), (1, 5, 4_000_000, "b", "b"), (1, 6, 5_000_000, "b", None)]
    frame = spark.createDataFrame(rows, "stream_id long, event_id long, at_us long, text string, promote string")
    got = drained(spark, processors.stream_partials(parts_to_stream(spark, [frame.coalesce(1)], "p")), "parts").collect()
    assert [(r.at_us, r.text) for r in sorted(got, key=lambda r: r.at_us)] == [(0, "a"), (2_000_000, "b")]
    assert processors.unseen("a b", "a") == "b" and processors.unseen("c", "a") is None


def test_gate_and_detector_go_on_after_a_restart(spark, tmp_path):
    rng, active, chunks = random.Random(12), False, []
    for i in range(240):
        active = active if rng.random() < 0.8 else not active
        chunks.append((1, i, i * 100_000, 100, active, [rng.random() for _ in range(5)]))
    df = spark.createDataFrame(chunks, "stream_id long, frame long, at_us long, ms long, active boolean, samples array<double>")
    (tmp_path / "in").mkdir()
    settings = dict(rate=10, window_s=3.0, hop_s=0.5, threshold=0.55, k=5, left_s=0.5, right_s=1.0, radius_s=0.31, gap_s=1.0, frame_s=0.1)
    read = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = processors.stream_live_changes(read, lambda: lambda batch: batch, pre_roll=4, reset_gap_ms=500, **settings)
    plain = lambda rows: sorted((round(r.time_s, 6), round(r.prob, 6), round(r.detected_at_s, 6)) for r in rows)
    for low, high in ((0, 79), (80, 130), (131, 239)):  # a run of its own each, from the checkpoint of the one before
        df.where(F.col("frame").between(low, high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = drained(spark, found, "live", str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    gated = literal_gate([(c[1], c[3], c[4]) for c in chunks], 4, 500)
    rows = [(1, seq, clock * 1000, session, chunks[frame][5]) for seq, (frame, clock, session) in enumerate(gated)]
    once = spark.createDataFrame(rows, "stream_id long, seq long, at_us long, session int, samples array<double>").coalesce(1)
    want = drained(spark, processors.stream_changes(parts_to_stream(spark, [once], "once"), lambda: lambda batch: batch, **settings), "once")
    assert plain(got.collect()) == plain(want.collect()) and got.count() > 3


def test_state_of_an_endless_utterance_stays_small(spark, tmp_path):
    rng, updates, changes, words = random.Random(14), [], [], []
    for i in range(1, 601):
        clock = round(i / 10, 3)
        words = [*words, rng.choice("abcdefg")] if rng.random() < 0.7 else words
        updates.append((1, i, clock, " ".join(words), None, 0.5))
        if i % 20 == 0:
            changes.append((1, round(clock - 1.003, 4), clock))
    a, b = frames(spark, updates, changes)
    merged = processors.caption_input(a, b)
    parts = [merged.where((F.col("clock_s") > lo) & (F.col("clock_s") <= lo + 20)).coalesce(1) for lo in (0, 20, 40)]
    stream = processors.stream_caption_rows(parts_to_stream(spark, parts, "endless", 1))
    got = drained(spark, stream, "endless", str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    strip = lambda rows: sorted((r[0], r[2], r[3], r[5]) for r in rows)
    assert strip(plain(got.collect())) == strip(literal(updates, changes)) and got.count() > 20
    entries = lambda name: spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "checkpoint"))
    assert 0 < entries("stamps").count() <= 41  # of 3.9 seconds, and one older
    assert entries("waiting").count() <= 1


def test_triggers_follow_the_largest_key_and_not_the_table(spark):
    def triggers(df, key):
        stream = in_triggers(spark, df, "at", "few", key, rows=10)
        query = stream.writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "few")).trigger(availableNow=True).start()
        query.awaitTermination()
        taken = [p.numInputRows for p in query.recentProgress if p.numInputRows]
        assert sum(taken) == df.count()
        return len(taken)

    many = spark.range(600).select((F.col("id") % 100).alias("stream_id"), F.col("id").alias("at"))
    assert triggers(many, "stream_id") == 2
    assert triggers(many.where("at < 45"), None) == 5
    assert triggers(many.where("at < 45").withColumn("stream_id", F.lit(1)), "stream_id") == 5


def test_caption_texts_are_never_broadcast(spark):
    updates = spark.sql(
        "SELECT * FROM VALUES (1L, 1, 1.0D, 'a b', NULL, 0.5D), (1L, 2, 2.0D, NULL, 'a b c', 0.9D) AS t(stream_id, seq, clock_s, partial, final, confidence)"
    )
    changes = spark.createDataFrame([(1, 0.5, 0.6)], "stream_id long, time_s double, detected_at_s double")
    lines = captions.caption_lines(captions.utterances(updates, changes), updates, display=False)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        lines.explain()
    assert "SortMergeJoin" in plan.getvalue() and "Broadcast" not in plan.getvalue()
