"""Collocations, spelling variants and vector search against brute force, with every odd case."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import odd_rows, prose, table
from hypothesis import given, settings
from hypothesis import strategies as st

from segflow.llm import bounded_search, collocations, spellings

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases_brute(rows, least, top):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(own)
            for m in range(1, 6):
                counts[lang].update(tuple(own[i : i + m]) for i in range(len(own) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        gone = set()
        for p, n in found.items():
            for m in range(2, len(p)):
                gone |= {p[i : i + m] for i in range(len(p) - m + 1) if 100 * n >= 100 * f[p[i : i + m]]}
        kept = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, words[lang], -score))
    return sorted(out)


def langs(spark, rows):
    full = [(k, t, lang, "s", None, None, None) for k, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, chunk string, freq long, phrase string").repartition(5)


def phrase_rows():
    base, draw = prose(50, 400, 30), np.random.default_rng(5)
    rows = [("en", base), ("en", base), (None, base), ("und", base + "! x"), ("de", None), ("de", ""), ("de", " \t. ,"), ("de", "A b\tA  b. a b\r\na B" * 40)]
    rows += [("en", "the cat sat, on the MAT; the cat sat. " * 30), ("fr", "é É ü x é É " * 60), ("en", "go " * 3000), ("xx", "\x0b".join(["a b c d e f"] * 20))]
    rows += [("en", " ".join(f"{w}{'.' if draw.random() < 0.1 else ''}" for w in prose(s, 800, 12).split())) for s in range(60, 70)]
    return rows


@pytest.mark.parametrize("least,top,spacing", [(5, 50, 64), (20, 2000, 3)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, top, spacing):
    monkeypatch.setattr(collocations, "SPACING", spacing)
    rows = phrase_rows()
    found = collocations.collocations(langs(spark, rows), least, top)
    assert sorted(map(tuple, found.collect())) == phrases_brute(rows, least, top)


def test_packed_counts_are_whole_and_small():
    draw, expected, packed, plain = np.random.default_rng(4), Counter(), defaultdict(list), 0
    for _ in range(4):
        key = np.unique(draw.integers(0, 1 << collocations.KEY_BITS, 200_000).astype(np.uint64))
        key[:3], key[-1] = (0, 1, 2), (1 << collocations.KEY_BITS) - 1
        n = np.minimum(draw.geometric(0.7, len(key)), 9).astype(np.int64)
        n[5] = 1 << 40
        expected.update(dict(zip(key.tolist(), n.tolist())))
        plain += len(key)
        rows = collocations._squeezed(key, n)
        for part, data in zip(rows.column("part").to_pylist(), rows.column("packed").to_pylist()):
            packed[part].append(data)
    assert sum(len(d) for own in packed.values() for d in own) < 5 * plain  # rows of two longs took 11 bytes
    found = [collocations._summed(p, collocations.unpacked(pa.array(own)), 3).column("key").to_numpy() for p, own in packed.items()]
    assert sorted(np.concatenate(found).tolist()) == sorted(k for k, n in expected.items() if n >= 3)
    assert len(collocations._squeezed(np.zeros(0, np.uint64), np.zeros(0, np.int64))) == 0


def test_collocations_of_nothing(spark):
    assert collocations.collocations(langs(spark, [("a", None)]), 1).count() == 0
    assert collocations.collocations(langs(spark, [("a", "x y")]).where("false"), 1).count() == 0


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    a, n = 10**15 + 7, 3 * 10**17 + 11
    rows = [("en", None, 0, n), ("en", "x", 1, a + 1), ("en", "y", 1, a), ("en", "x y", 2, a)]
    monkeypatch.setattr(collocations, "phrase_counts", lambda docs, least: spark.createDataFrame(rows, "lang string, phrase string, size int, n long"))
    found = collocations.collocations(langs(spark, [("en", "x y")]), 1).first()
    assert (found["a"], found["score"]) == (a, 1000 * a * n // ((a + 1) * a))


def spellings_brute(rows, shortest=6, least=5, times=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    form, count = {}, {}
    for w in n:
        others = [o for o in n if near(w, o)]
        count[w] = len(others)
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n.get(form[w])))
    return sorted(out, key=repr)


def spelling_rows():
    draw, rows = np.random.default_rng(9), odd_rows()
    names = ["garden", "gardens", "gärten", "colour", "color", "colourful", "straße", "strasse", "abcdef", "fedcba", "z" * 500, "z" * 501, "É" * 7, "a×b÷cdef", "listen", "silent", "enlist", "tinsel", "kitten", "sitten"]
    for k in range(400):
        own = []
        for w in draw.choice(names, 30, p=(p := 1 / np.arange(1, len(names) + 1) ** 1.2) / p.sum()).tolist():
            if draw.random() < 0.15:
                at = int(draw.integers(len(w)))
                w = w[:at] + "aeQ"[int(draw.integers(3))] * int(draw.integers(3)) + w[at + 1 :]
            own.append(w.upper() if draw.random() < 0.05 else w)
        rows.append((1000 + k, ", ".join(own)))
    return rows


@pytest.mark.parametrize("leaf,wide", [(1 << 12, 64), (3, 1)])
def test_spellings_equal_brute_force(spark, monkeypatch, leaf, wide):
    monkeypatch.setattr(spellings, "LEAF", leaf)
    monkeypatch.setattr(spellings, "SMALL", min(16, leaf))
    monkeypatch.setattr(spellings, "WIDE", wide)
    rows = spelling_rows()
    found = spellings.variants(table(spark, rows))
    assert sorted(map(tuple, found.collect()), key=repr) == spellings_brute(rows)


def test_spellings_of_nothing_and_long_paths(spark):
    assert spellings.variants(table(spark, [(1, None), (2, "")])).count() == 0
    words = ["abcdefg" + "h" * k for k in range(6)]  # each is near the next, whose count is five times its own
    rows = [(10 * k, " ".join([w] * 5**k)) for k, w in enumerate(words, 1)]
    found = {r["word"]: r["root"] for r in spellings.variants(table(spark, rows)).collect()}
    assert found == {r[0]: r[2] for r in spellings_brute(rows)} and len(found) >= 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcdé", min_size=3, max_size=6), min_size=1, max_size=60, unique=True))
def test_boxes_that_an_edit_reaches(words):
    same = [w for w in words if len(w) == len(words[0])]
    counts = spellings.vectors(same)
    nodes, leaves = spellings.split(counts, 2)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(len(same)))
    home = {int(r): int(a) for a, rows in enumerate(leaves) for r in rows}
    for shift, more, fewer in ((0, 1, 1), (1, 1, 0), (-1, 0, 1)):
        seek = [w for w in words if len(w) + shift == len(same[0])]
        row, leaf = spellings.reached(nodes, spellings.vectors(seek), more, fewer) if seek else ([], [])
        got = set(zip(map(int, row), map(int, leaf)))
        for i, w in enumerate(seek):
            for j, other in enumerate(same):
                if w != other and spellings.one_edit(*((other, w) if shift < 0 else (w, other))):
                    assert (i, home[j]) in got


def nearest_brute(rows, every, top):
    own = [(k, v, [int(np.floor(256 * float(x))) for x in e]) for k, (v, e) in enumerate(rows) if v is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for k, q, x in own:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), v) for j, v, y in own if j != k)
            out += [(q, r, v, max(-(2**63) + 1, min(2**63 - 1, -s))) for r, (s, v) in enumerate(scores[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("block,step,sparse", [(4096, 8, 0.1), (7, 3, 1.1)])
def test_search_equals_brute_force(spark, monkeypatch, block, step, sparse):
    for name, value in (("BLOCK", block), ("QUERIES", block), ("STEP", step), ("SPARSE", sparse), ("MOST_BLOCKS", 3), ("MOST_QUERIES", 2)):
        monkeypatch.setattr(bounded_search, name, value)
    draw = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in draw.normal(0, 0.1, 16).astype(np.float32)]) for k in range(-20, 300)]
    rows += [(40, rows[3][1]), (40, None), (None, rows[0][1]), (41, [None] * 16), (42, [float("nan")] * 16), (43, [float("inf")] * 16), (45, []), (46, [0.5] * 5), (50, rows[9][1])]
    rows += [(47, [2.0**20] * 16), (60, rows[5][1]), (61, rows[5][1]), (62, rows[5][1])]
    docs = spark.createDataFrame([(v, e, 0, "x", "y") for v, e in rows], "vec_id long, embedding array<float>, label int, ids string, block string").repartition(4)
    found = bounded_search.top_scores(docs, 10, 5)
    assert sorted(map(tuple, found.collect())) == nearest_brute(rows, 10, 5)
    assert bounded_search.top_scores(docs.where("false")).count() == 0


def test_huge_components_are_exact_or_held(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**10, 3.0]), (2, [3.0e38, 0.0]), (3, [-(2.0**30), 1.0])]
    found = bounded_search.top_scores(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 50, 5)
    assert [(r["vec_id"], r["score"]) for r in found.orderBy("rank").collect()] == [(1, 2**63 - 1), (2, 2**63 - 1), (3, -(2**63) + 1)]
