"""Token ids, range coder files and best-fit packing."""

import zlib

import numpy as np
import pytest
from helpers import odd_rows, table
from tokenizers import Tokenizer

from segflow.llm import packing, rans, tokens
from segflow.llm.queries import tokenizer_path


def encoded(name, rows):
    made = Tokenizer.from_file(tokenizer_path(name))
    return [e.ids + [2] for e in made.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_those_of_whole_texts(name):
    import pyarrow as pa

    rows = odd_rows() + [(0, t) for t in ("", "  a  b ", "\n\n x\t y", "it's don't I'LL", "a.b,c  ", "x \x01 y", " \x01", "Σας ΣΑΣ. x", "1 23 a1,b2 ...!!! x", "a  b 　c", "x<|endoftext|>y <|ENDOFTEXT|>", "[UNK]<unk></s> a", "plain again")]
    found = []
    for _, _, flat, at in tokens.batches(tokenizer_path(name), pa.array([t or "" for _, t in rows]), 2):
        found += [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert found == encoded(name, rows)


def test_packing(spark):
    rows = odd_rows()
    out = packing.pack(table(spark, rows), tokenizer_path("byte_bpe_50k.json"), 1024, 2).collect()
    expected, pieces = sorted(map(crc, [ids[a:b] for ids in encoded("byte_bpe_50k.json", rows) for a, b in cuts(len(ids))])), []
    for r in out:
        assert 0 <= r["offset"] and r["offset"] + r["length"] <= 1024
        pieces.append(r["ids_crc32"])
    assert sorted(pieces) == expected
    filled = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert packing.pack(table(spark, []), tokenizer_path("byte_bpe_50k.json")).collect() == []


def cuts(n, capacity=1024):
    head = n if n <= capacity else n % capacity or capacity
    edges = [0, head, *range(head + capacity, n + 1, capacity)]
    return list(zip(edges[:-1], edges[1:]))


def one_by_one(lengths, capacity):
    """Best-fit decreasing, piece by piece over all open bins."""
    left = []
    for n in sorted(lengths, reverse=True):
        fit = [(c, i) for i, c in enumerate(left) if c >= n]
        if fit:
            left[min(fit)[1]] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_runs_equal_piece_by_piece(seed):
    draw = np.random.default_rng(seed)
    lengths = draw.integers(1, 33, 400).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    used = {}
    for length, rank, pieces, first, each, offset in packing.best_fit(counts, 32):
        for k in range(pieces):
            used.setdefault(first + k // each, []).append((offset + k % each * length, length))
    left = []
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        left.append(32 - at)
    assert sorted(left) == one_by_one(lengths, 32)


def test_salted_ranks_are_gapless(spark):
    pieces = spark.range(1000).selectExpr("id as doc_id", "0 as piece", "cast(id % 3 as long) as length", "id as ids_crc32")
    out = packing.ranked(pieces, rank_rows=50).collect()
    for length in range(3):
        own = sorted(r["rank"] for r in out if r["length"] == length)
        assert own == list(range(len(own)))


def test_round_trip(spark):
    rows = odd_rows()
    out = rans.round_trip(table(spark, rows), tokenizer_path("word_bpe_49k.json"), 2).collect()
    ids = encoded("word_bpe_49k.json", rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in out) == sorted((str(d), len(i), crc(i)) for (d, _), i in zip(rows, ids))
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert known == sorted(known)
    assert rans.round_trip(table(spark, []), tokenizer_path("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 30000])
def test_segments(n):
    draw = np.random.default_rng(n)
    ids = np.minimum(draw.geometric(0.01, n), 999).astype(np.uint32)
    model = rans.Model(np.bincount(ids, minlength=1000))
    assert int(model.freq.sum()) == 1 << rans.SCALE and model.freq.min() >= 1
    data = rans.write_segment(model, np.arange(2), np.array([n, 0]), ids, block=4096)
    docs, sizes, back = rans.read_segment(model, data)
    assert docs.tolist() == [0, 1] and sizes.tolist() == [n, 0] and (back == ids).all()
    if n > 9000:  # any block alone, from its checkpoint
        assert (rans.read_segment(model, data, [2])[2] == ids[8192:12288]).all()
        broken = bytearray(data)
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            rans.read_segment(model, bytes(broken))
