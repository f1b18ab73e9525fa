"""Near-duplicate classes, benchmark windows and nearest examples."""

import numpy as np
import pyarrow as pa
import pytest
from helpers import odd_rows, plain_words, prose, table

from segflow.llm import icws, neighbours, shingles, simhash
from segflow.llm.common import text_buffers


def variants():
    """Groups of near copies with more and more changed words."""
    rows, draw = [], np.random.default_rng(7)
    for group in range(12):
        words = prose(100 + group, 200).split()
        for copy in range(8):
            own = list(words)
            for k in draw.choice(200, copy, replace=False):
                own[k] = f"changed{group}x{copy}x{k}"
            rows.append((1000 * group + copy, " ".join(own)))
    return rows


def brute_links(rows, rare):
    made = []
    for _, text in rows:
        data, at = text_buffers(shingles.lowered(pa.array([text or ""], pa.large_string())))
        made.append(shingles.weighted(data, at, rare))
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if len(made[i][0]) and len(made[j][0]):
                near = float(shingles.similarity(1, made[i], made[j])[0])
                if near >= 0.8:
                    links.append((rows[i][0], rows[j][0]))
    return links


def closed(links, ids):
    own = {i: i for i in ids}
    def root(i):
        while own[i] != i:
            i = own[i]
        return i
    for a, b in links:
        a, b = root(a), root(b)
        own[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_classes_equal_brute_force(spark):
    rows = [r for r in odd_rows() if r[0] is not None] + variants()
    docs = table(spark, rows)
    rare = shingles.rarity(docs)
    found = icws.near_classes(docs).collect()
    assert len(found) == len(rows)
    classes = {r["doc_id"]: r["class_id"] for r in found}
    assert classes == closed(brute_links(rows, rare), set(dict(rows)))


def chain(count=200, size=200, step=16):
    """Texts of which only neighbours are alike (0.85, the next but one 0.72), in the order of shuffled ids."""
    words, ids = prose(31, count * step + size, 1 << 40).split(), np.random.default_rng(3).permutation(count).tolist()
    return [(k, " ".join(words[i * step : i * step + size])) for i, k in enumerate(ids)]


def family(count=100):
    """Copies of one text with so many edits that two of them are about 0.8 alike."""
    words, draw, rows = prose(33, 200).split(), np.random.default_rng(11), []
    for copy in range(count):
        own = list(words)
        for k in draw.choice(200, int(draw.integers(1, 9)), replace=False):
            own[k] = f"changed{copy}x{k}"
        rows.append((1000 + copy, " ".join(own)))
    return rows


def test_classes_of_chains_and_large_families(spark):
    rows = chain() + family()
    docs = table(spark, rows)
    expected = closed(brute_links(rows, shingles.rarity(docs)), set(dict(rows)))
    assert set(expected[k] for k in range(200)) == {0}
    assert {r["doc_id"]: r["class_id"] for r in icws.near_classes(docs).collect()} == expected


def pairs_of_a_form(count=900, shared=100, own=120):
    """Pairs of texts, 0.8 alike or a little less or more, that share a form with all the others, which are unlike them."""
    form, draw, rows = prose(35, shared), np.random.default_rng(23), []
    for k in range(count):
        one = prose(10_000 + k, own, 1 << 40).split()
        edited = [f"changed{k}x{i}" for i in range(int(draw.integers(13, 22)))]
        rows += [(2 * k, " ".join([form, *one])), (2 * k + 1, " ".join([form, *one[: own - len(edited)], *edited]))]
    return rows


@pytest.mark.parametrize("full,tile", [(64, 16), (64, 1000)])
def test_no_link_of_a_large_bucket_is_lost(spark, monkeypatch, full, tile):
    monkeypatch.setattr(icws, "FULL", full)
    monkeypatch.setattr(icws, "TILE", tile)
    rows = pairs_of_a_form()
    docs = table(spark, rows)
    rare = shingles.rarity(docs)
    bucket = {r["doc_id"]: r["bands"][0] for r in icws.signatures(docs, rare, 1, 1).collect()}
    assert max(list(bucket.values()).count(b) for b in set(bucket.values())) > 300
    links = {b for k in range(0, len(rows), 2) for b, _ in brute_links(rows[k : k + 2], rare) if bucket[b] == bucket[b - 1]}
    out = {r["doc_id"]: r for r in icws.near_classes(docs, bands=1, rows=1).collect()}
    assert len(out) == len(rows) and len(links) > 100
    assert {k for k, r in out.items() if r["class_id"] != k} >= links and all(r["class_id"] == k - k % 2 for k, r in out.items() if r["class_id"] != k)


def test_texts_of_a_similarity_share_a_rarest_shingle(spark):
    rows = family(60) + chain(30)
    docs = table(spark, rows)
    rare = shingles.rarity(docs)
    ids = docs.select("doc_id")
    held = icws._texts(docs, ids)
    under = {k: set() for k, _ in rows}
    for r in icws._rarest(ids, held, rare, 0.8).collect():
        under[r["doc_id"]].add(r["key"])
    links = brute_links(rows, rare)
    assert len(links) > 200 and all(under[a] & under[b] for a, b in links)
    assert sum(map(len, under.values())) < 0.35 * 196 * len(rows)


def test_buckets_of_the_same_members_go_on_once(spark):
    rows = [(k, d) for k in (1, 2, 3) for d in range(6)] + [(4, d) for d in range(5)] + [(5, 9), (6, 7), (6, 8)]
    keyed = spark.createDataFrame(rows, "key long, doc_id long")
    buckets = icws._buckets(keyed)
    out = [(r["key"], r["doc_id"], r["leader"], r["n"]) for r in buckets.collect()]
    assert sorted(out) == [(1, d, 0, 6) for d in range(6)] + [(4, d, 0, 5) for d in range(5)] + [(6, 7, 7, 2), (6, 8, 7, 2)]
    links = spark.createDataFrame([(1, 0), (2, 0), (8, 7)], "doc_id long, leader long")
    out = [(r["key"], r["doc_id"], r["class_id"], r["n"], r["most"], r["main"]) for r in icws._mixed(buckets, links).collect()]
    assert sorted(out) == [(k, d, 0 if d < 3 else d, n, 3, 0) for k, n in ((1, 6), (4, 5)) for d in range(n)]


def test_rarity_counts_all_documents(spark):
    rare = shingles.rarity(table(spark, [(1, "a b"), (2, "a"), (3, None), (4, "A a")]))
    data, at = text_buffers(pa.array(["a b"], pa.large_string()))
    from segflow.llm.common import PLAIN, words

    slots = shingles.word_slots(words(data, at, PLAIN)[3])
    assert np.allclose(rare[slots], 1 + np.log1p([4 / 3, 4]) / np.log1p(4), atol=1e-6)


def test_one_of_each(spark):
    rows = odd_rows()
    docs = table(spark, rows)
    out = icws.one_of_each(docs)
    ids = sorted(str(r["doc_id"]) for r in out.collect())
    assert out.columns == docs.columns
    assert "5" not in ids and ids.count("3") == 1 and ids.count("None") == 2 and {"9", "10", "11", "12"} <= set(ids)
    assert icws.near_classes(table(spark, [])).collect() == []


def test_samples_agree_as_often_as_texts_are_similar():
    a, b = prose(1, 300).split(), None
    b = a[:250] + prose(2, 50).split()
    data, at = text_buffers(pa.array([" ".join(a), " ".join(b)], pa.large_string()))
    rare = np.ones(shingles.SLOTS, np.float32)
    doc, shingle, weight = shingles.weighted(data, at, rare)
    drawn = icws.samples(doc, shingle, weight, 2, 2000)
    one, two = ((np.zeros((doc == d).sum(), np.int64), shingle[doc == d], weight[doc == d]) for d in (0, 1))
    assert abs((drawn[0] == drawn[1]).mean() - shingles.similarity(1, one, two)[0]) < 0.04


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (300, 200)]
    edges = spark.createDataFrame(chain, "one long, two long")
    out = {r["doc_id"]: r["class_id"] for r in icws.components(edges).collect()}
    assert out == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, 300: 200}


def test_what_hangs_on_stars_goes_through_no_round(spark, monkeypatch):
    made, keep = [], icws.stored
    monkeypatch.setattr(icws, "stored", lambda df, label, *more: made.append(label) or keep(df, label, *more))
    edges = [(n, n % 3) for n in range(3, 60)] + [(61, 60), (70, 61), (71, 61), (71, 61)]
    out = {r["doc_id"]: r["class_id"] for r in icws.components(spark.createDataFrame(edges, "one long, two long")).collect()}
    assert out == {**{n: n % 3 for n in range(3, 60)}, 61: 60, 70: 60, 71: 60}
    assert len(made) == 1
    assert icws.components(spark.createDataFrame([], "one long, two long")).collect() == []


def test_classes_that_are_carried_on_join_what_the_links_join(spark, monkeypatch):
    monkeypatch.setattr(icws, "FULL", 32)
    monkeypatch.setattr(icws, "TILE", 8)
    calls, keep = [], icws.components
    monkeypatch.setattr(icws, "components", lambda edges, *more: calls.append(edges.count()) or keep(edges, *more))
    rows = pairs_of_a_form(150) + [(k + 10_000, t) for k, t in family(40)]
    docs = table(spark, rows)
    rare = shingles.rarity(docs)
    keyed = icws.signatures(docs, rare, 1, 1).selectExpr("doc_id", "bands[0] as key")
    links, joined = ([(r["doc_id"], r["leader"]) for r in found.collect()] for found in icws._links(docs, keyed, rare, 0.8))
    assert closed(joined, set(dict(rows))) == closed(links, set(dict(rows)))
    assert len(links) > 30 and 1 <= len(calls) <= 3
    assert len(set(calls)) == len(calls)  # only joined anew where links were found


def leak_rows():
    items = [(k, prose(500 + k, 14 + k)) for k in range(30)] + [(90, None), (91, ""), (92, "two words"), (93, prose(500, 14))]
    docs, draw = [], np.random.default_rng(5)
    for k in range(30):
        words, own = prose(900 + k, 150).split(), items[k][1].split()
        if k % 3 == 1:
            own[int(draw.integers(len(own)))] = "edited"
        if k % 3 < 2:
            words[60:60] = own
        docs.append((k, " ".join(words)))
    return items, docs + [(50, items[3][1]), (51, None), (52, ""), (53, items[29][1] + " " + items[5][1].upper()), (54, "has two words in it")]


def test_leaks_equal_brute_force(spark):
    items, docs = leak_rows()
    frame = table(spark, docs)
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    rare = shingles.rarity(frame)
    expected = set()
    for doc, text in docs:
        words = plain_words(text)
        for item, source in items:
            own = plain_words(source)
            if own and any(similar(words[a : a + len(own)], own, rare) >= 0.8 for a in range(len(words) - len(own) + 1)):
                expected.add((doc, item))
    for limit in (4096, 7):
        found = simhash.leaks(frame, bench, limit=limit).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == expected and len(found) == len(expected)
    kept = simhash.decontaminated(frame, bench)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in expected}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert simhash.leaks(frame, empty).collect() == [] and simhash.decontaminated(frame, empty).count() == len(docs)
    assert simhash.leaks(table(spark, []), bench).collect() == []


def test_documents_shorter_than_an_item(spark):
    items = [(k, prose(700 + k, 38 + 3 * k)) for k in range(6)] + [(6, prose(700, 60))]
    docs = [(10 * k + cut, " ".join(t.split()[cut % 2 : len(t.split()) - cut])) for k, t in items for cut in range(10)]
    docs += [(900, prose(701, 3)), (901, prose(1, 30))]
    frame = table(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rare = shingles.rarity(frame)
    expected = set()
    for doc, text in docs:
        words = plain_words(text)
        for item, source in items:
            own = plain_words(source)
            size = min(len(words), len(own))
            if any(similar(words[a : a + size], own, rare) >= 0.8 for a in range(len(words) - size + 1)):
                expected.add((doc, item))
    assert (2, 0) in expected and (9, 0) not in expected
    found = simhash.leaks(frame, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected and len(found) == len(expected)
    assert {r["n_words"] for r in found if (r["doc_id"], r["item_id"]) == (2, 0)} == {36}
    assert {r["doc_id"] for r in simhash.decontaminated(frame, bench).collect()} == {d for d, _ in docs} - {d for d, _ in expected}


def similar(a, b, rare):
    """Weighted Jaccard of two word lists as multisets of shingles."""
    if len(b) < 5:
        return float(a == b)
    sums = []
    for words in (a, b):
        data, at = text_buffers(pa.array([" ".join(words)], pa.large_string()))
        from segflow.llm.common import PLAIN, rolling, words as split

        hashes = split(data, at, PLAIN)[3]
        own = {}
        for g, w in zip(rolling(hashes, 5).tolist(), simhash._weights(hashes, rare).tolist()):
            own[g] = own.get(g, 0) + w
        sums.append(own)
    keys = set(sums[0]) | set(sums[1])
    return sum(min(s.get(k, 0) for s in sums) for k in keys) / sum(max(s.get(k, 0) for s in sums) for k in keys)


def toxic_rows():
    draw, bad = np.random.default_rng(9), [f"bad{k}" for k in range(8)]
    rows, labels = [], []
    for i in range(900):
        words, toxic = prose(2000 + i, 60).split(), int(i % 6 == 0)
        if toxic:
            for w in draw.choice(bad, 3, replace=False):
                words[int(draw.integers(60))] = w
        rows.append((i, " ".join(words)))
        if i % 3 < 2:
            labels.append((i, 1, toxic))
    return rows, labels + [(5000, 1, 1), (None, 1, 1), (1, None, None)]


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = table(spark, rows + [(2000, None), (2001, ""), (None, "bad1 bad2 bad3"), (7, rows[7][1])])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = neighbours.toxicity(docs, marks).collect()
    assert len(out) == 904
    import zlib

    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    fresh = [(r["predicted"], int(r["doc_id"] % 6 == 0)) for r in out if r["held_out"] and r["doc_id"] < 900]
    assert len(fresh) > 100 and np.mean([a == b for a, b in fresh]) > 0.97
    clean = neighbours.without_toxic(docs, neighbours.fit(docs, marks))
    assert clean.columns == docs.columns and {2000, 2001} <= {r["doc_id"] for r in clean.collect()}


def test_toxicity_without_labels(spark):
    docs = table(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = neighbours.toxicity(docs, none).collect()
    assert len(out) == len(odd_rows()) and len({r["score"] for r in out}) == 1
    assert neighbours.toxicity(table(spark, []), none).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_nearest_is_exact(seed):
    draw = np.random.default_rng(seed)
    examples = []
    for k in range(700):
        terms = draw.choice(40, int(draw.integers(1, 6)), replace=False).tolist()
        weight = draw.random(len(terms))
        weight /= np.sqrt((weight**2).sum())
        examples.append((k, int(draw.integers(2)), dict(zip(terms, weight.tolist()))))
    index = neighbours.Index(examples)
    query = examples[int(draw.integers(700))][2]
    place, near = index.nearest(query, 15)
    every = sorted(((-sum(query[t] * e[2].get(t, 0) for t in query), k) for k, e in enumerate(examples)))[:15]
    assert np.allclose(near, [-s for s, _ in every]) and set(place[near > near[-1] + 1e-9]) <= {k for _, k in every}


def test_only_nodes_that_others_hang_on_go_through_the_rounds(spark, monkeypatch):
    seen, stars = [], icws._stars
    monkeypatch.setattr(icws, "_stars", lambda edges, label: seen.append(edges.count()) or stars(edges, label))
    draw = np.random.default_rng(11)
    group = [(n, leader) for n in range(10, 400) for leader in range(5)] + [(n, 5) for n in range(400, 700)] + [(3, 5)]
    loose = [(1000 + int(a), 1000 + int(b)) for a, b in draw.integers(0, 300, (260, 2))]
    into = {}

    def root(k):
        while into.get(k, k) != k:
            k = into[k]
        return k

    for a, b in group + loose:
        low, high = sorted((root(a), root(b)))
        into[high] = low
    nodes = {k for e in group + loose if e[0] != e[1] for k in e}
    for edges, want in ((group, {k: 0 for k in nodes if 0 < k < 1000}), (group + loose, {k: root(k) for k in nodes if root(k) != k})):
        out = icws.components(spark.createDataFrame(edges, "one long, two long")).collect()
        assert len(out) == len({r["doc_id"] for r in out}) and {r["doc_id"]: r["class_id"] for r in out} == want
    assert seen[0] <= 6
