"""Weighted five-word shingles: words, their document frequencies in fixed slots, and exact weighted similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.common import CHUNK_BYTES, PLAIN, doc_ends, mixed, rolling, text_buffers, texts, words

SHINGLE = 5
#: Document frequencies are counted by hashed word slots, so their table has this size for any corpus. A slot counts
#: all words in it, so a frequency can only be too high, and only for rare words.
SLOTS = 1 << 17
_BITS = 50
CHUNK_DOCS = 1 << 13


def lowered(column):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(column)


def word_slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of documents, bounded in bytes and in number."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, first + CHUNK_DOCS)
        yield first, last
        first = last


def rarity(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency by word slot, over all documents; SLOTS numbers on the driver.

    1 + ln(1 + documents / documents with the word) / ln(1 + documents): from about 1 to 2, so that a few rare words
    that a copy has of its own do not outweigh what it shares.
    """

    def count(stream):
        total, rows = np.zeros(SLOTS, np.int64), 0
        for batch in stream:
            data, offsets = text_buffers(lowered(batch.column("text")))
            rows += batch.num_rows
            for low, high in pieces(offsets):
                _, _, first, hashes = words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], PLAIN)
                doc = np.repeat(np.arange(high - low), np.diff(first))
                total += np.bincount(np.unique(doc * SLOTS + word_slots(hashes)) & (SLOTS - 1), minlength=SLOTS)
        some = np.flatnonzero(total)
        slot = np.append(some, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.append(total[some], rows))], names=["slot", "n"])

    counted = texts(docs).select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = (counted.column(c).to_numpy() for c in ("slot", "n"))
    seen, total = np.zeros(SLOTS), int(n[slot == -1].sum())
    seen[slot[slot >= 0]] = n[slot >= 0]
    return (1 + np.log1p(total / np.maximum(seen, 1)) / np.log1p(max(total, 1))).astype(np.float32)


def weighted(data: np.ndarray, at: np.ndarray, rare: np.ndarray):
    """(document, shingle, weight) of the distinct shingles of lower-case texts, in order of document.

    The weight is the count in the text times the mean rarity of the words. A text of one to four words is one
    shingle; a text without words has none.
    """
    _, _, first, hashes = words(data, at, PLAIN)
    n = len(hashes)
    ends, size = doc_ends(first), np.diff(first)
    sums = np.concatenate([[0.0], np.cumsum(rare[word_slots(hashes)], dtype=np.float64)])
    doc = np.repeat(np.arange(len(size)), size)
    whole = np.arange(n) + SHINGLE <= ends
    place = np.flatnonzero(whole)
    gram = rolling(hashes, SHINGLE)[place] if n >= SHINGLE else np.zeros(0, np.uint64)
    mean = (sums[place + SHINGLE] - sums[place]) / SHINGLE
    small = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(small):
        begin, count = first[:-1][small], size[small]
        own = np.array([int(mixed(np.array([h], np.uint64))[0]) for h in (_joined(hashes[a : a + c]) for a, c in zip(begin.tolist(), count.tolist()))], np.uint64)
        gram, mean = np.concatenate([gram, own]), np.concatenate([mean, (sums[begin + count] - sums[begin]) / count])
        place_doc = np.concatenate([doc[place], small])
    else:
        place_doc = doc[place]
    key = (place_doc.astype(np.uint64) << np.uint64(_BITS)) | (gram >> np.uint64(64 - _BITS))
    turn = np.argsort(key)
    key = key[turn]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(_BITS)).astype(np.int64), key & np.uint64((1 << _BITS) - 1), count * mean[turn[new]]


def _joined(values: np.ndarray) -> int:
    out = len(values)
    for v in values.tolist():
        out = (out * 0x9E3779B97F4A7C15 + v) & 0xFFFFFFFFFFFFFFFF
    return out


def similarity(pairs: int, one, two) -> np.ndarray:
    """Weighted Jaccard similarity of each pair: the sum of lesser weights by the sum of greater ones."""
    pair = np.concatenate([one[0], two[0]])
    key = (pair.astype(np.uint64) << np.uint64(_BITS)) | np.concatenate([one[1], two[1]])
    weight = np.concatenate([one[2], two[2]])
    turn = np.argsort(key, kind="stable")
    key, weight, pair = key[turn], weight[turn], pair[turn]
    same = np.flatnonzero(key[1:] == key[:-1])
    common = np.bincount(pair[same], np.minimum(weight[same], weight[same + 1]), minlength=pairs)
    total = np.bincount(pair, weight, minlength=pairs)
    return common / np.maximum(total - common, 1e-300)
