"""Slots and shards; closed syncmers."""

import hashlib
import re
import zlib

import xxhash
from helpers import odd_rows, prose, table

from segflow.llm import sharding, syncmers


def test_shards(spark):
    rows = odd_rows() + [(100 + i, prose(i, 60)) for i in range(600)] + [(1000 + i, "") for i in range(400)]
    out = sharding.shard(table(spark, rows), 4).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    load = [sum(r["size"] for r in out if r["shard"] == s) for s in range(4)]
    assert max(load) - min(load) < 0.02 * sum(load) or max(load) <= max(len((t or "").encode()) + 1 for _, t in rows)
    for s in range(4):
        places = sorted(r["slot"] for r in out if r["shard"] == s)
        assert places == list(range(len(places)))
    assert sharding.shard(table(spark, []), 4).collect() == []


def test_a_text_of_a_third_of_all_rows_is_split(spark):
    rows = [(i, "same text") for i in range(500)] + [(1000 + i, prose(i, 30)) for i in range(1000)]
    out = sharding.shard(table(spark, rows), 16).collect()
    assert len({r["shard"] for r in out if r["size"] == 10}) > 1


def test_only_the_hot_text_of_a_slot_is_split(spark):
    rows = [(i, "same text") for i in range(500)] + [(1000 + 2 * i + k, prose(i, 30)) for i in range(400) for k in range(2)]
    shards = {}
    for r in sharding.shard(table(spark, rows), 16, slots=4).collect():
        shards.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert len(shards.pop(zlib.crc32(b"same text"))) > 1
    assert all(len(s) == 1 for s in shards.values())


def test_a_stored_map_is_edited_to_the_next_version(spark):
    rows = [(i, prose(i, 30)) for i in range(600)]
    first = sharding.shard(table(spark, rows), 4).cache()
    more = rows + [(1000 + i, prose(1000 + i, 30)) for i in range(60)]
    second = sharding.shard(table(spark, more), 4, before=sharding.map_of(first)).collect()
    assert {r["map_version"] for r in second} == {2}
    before = {r["doc_id"]: r["shard"] for r in first.collect()}
    moved = [r for r in second if r["doc_id"] in before and before[r["doc_id"]] != r["shard"]]
    load = [sum(r["size"] for r in second if r["shard"] == s) for s in range(4)]
    assert len(moved) < 60 and max(load) - min(load) < 0.05 * sum(load)
    assert {r["map_version"] for r in sharding.shard(table(spark, rows), 4).collect()} == {1}


def test_edited_map_moves_only_what_it_must():
    sizes = [(h, -1, 100 + h % 7) for h in range(512)]
    old = sharding.balanced(sizes, 16)
    new = sharding.rebalanced(old, sizes, 17)
    moved = {s for s in old if old[s] != new[s]}
    assert {new[s] for s in moved} == {16} and len(moved) < 512 / 16
    assert sharding.rebalanced(new, sizes, 17) == new


def anchors(text):
    units = [xxhash.xxh64_intdigest(u.encode(), 42) for u in re.findall(syncmers.UNIT, text)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    def joint(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
        return seed
    if len(units) < syncmers.GRAM:
        return {joint(units) >> 32} if units else set()
    out = set()
    for i in range(len(units) - syncmers.GRAM + 1):
        own = [signed(u) for u in units[i : i + syncmers.GRAM]]
        if min(own) in (own[0], own[-1]):
            out.add(joint(units[i : i + syncmers.GRAM]) >> 32)
    return out


def test_fingerprints(spark):
    rows = [(d, t) for d, t in odd_rows() if d is not None and d != 3] + [(3, "one two three four five six seven")]
    out = {r["doc_id"]: r for r in syncmers.fingerprints(table(spark, rows)).collect()}
    order = sorted(rows)
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = out[doc]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, source in (("fingerprint", text), ("edited_fingerprint", edited)):
            assert row[name] == "".join(f"{v:08x}" for v in sorted(anchors(source))[: syncmers.SKETCH])
        both = anchors(text), anchors(edited)
        if 0 < len(both[0] | both[1]) <= syncmers.SKETCH:
            assert abs(row["near_edited"] - 2 * len(both[0] & both[1]) / (len(both[0]) + len(both[1]))) < 1e-9
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1


def test_fingerprints_of_odd_tables(spark):
    assert syncmers.fingerprints(table(spark, [])).collect() == []
    row, = syncmers.fingerprints(table(spark, [(7, "a b c d")])).collect()
    assert row["near_next"] == 1.0
    rows = odd_rows()
    out = syncmers.fingerprints(table(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(d) for d, _ in rows)


def test_next_over_many_ranges(spark):
    ids = [0, 1, 9, 10, 11, 40, 41, 99]
    out = syncmers.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string"), ["text"], cell=10).collect()
    assert {r["text"]: r["next_text"] for r in out} == {f"t{a}": f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}
