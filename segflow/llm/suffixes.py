"""Suffix-array dedup of bytes: suffixes at anchors, range-partitioned by sampled splitters, sorted in buckets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from segflow.llm.common import runs_of
from segflow.llm.repeats import Rule, repeat_spans, with_spans

GRAM, WINDOW = 32, 200


def multikey_sort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``keys`` (big-endian 8-byte tokens) and, per place, the bytes shared with the row before.

    Multikey quicksort level by level: rows that are still tied are partitioned by their next token, and groups of one
    row are finished.
    """
    n, depth = keys.shape
    order, group = np.arange(n), np.zeros(n, np.int64)
    shared = np.full(n, depth * 8)
    shared[:1] = 0
    live = np.arange(n)
    for level in range(depth):
        if len(live) < 2:
            break
        token = keys[order[live], level]
        turn = np.lexsort((token, group[live]))
        order[live], token, own = order[live][turn], token[turn], group[live]
        apart = np.concatenate([[True], (own[1:] != own[:-1]) | (token[1:] != token[:-1])])
        cut = np.flatnonzero(apart[1:] & (own[1:] == own[:-1])) + 1
        differ = (token[cut] ^ token[cut - 1]).astype(np.uint64)
        high = np.zeros(len(cut), np.int64)
        for shift in (32, 16, 8):  # leading zero bytes of the difference
            empty = (differ >> np.uint64(64 - shift)) == 0
            high += np.where(empty, shift // 8, 0)
            differ = np.where(empty, differ << np.uint64(shift), differ)
        shared[live[cut]] = level * 8 + high
        heads = live[apart]
        number = np.cumsum(apart) - 1
        group[live] = heads[number]
        live = live[np.bincount(number)[number] > 1]
    return order, shared


def _tokens(block: np.ndarray) -> np.ndarray:
    pad = -block.shape[1] % 8
    if pad:
        block = np.concatenate([block, np.zeros((len(block), pad), np.uint8)], axis=1)
    return np.ascontiguousarray(block).view(">u8").astype(np.uint64)


def _units(data, at):
    return data.astype(np.uint64) + np.uint64(1), at


def _context(gram: int, window: int):
    left = window - gram

    def surroundings(data, at, hashes, first, doc, place):
        padded = np.concatenate([np.zeros(left, np.uint8), data, np.zeros(window, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, left + window)
        block = view[first[doc] + place]
        room = np.minimum(np.diff(first)[doc] - place, window)
        rows = np.arange(len(doc) + 1, dtype=np.int64) * (left + window)
        own = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(rows), pa.py_buffer(np.ascontiguousarray(block))])
        return [own.cast(pa.binary()), pa.array(np.minimum(place, left).astype(np.int16)), pa.array(room.astype(np.int16))]

    return surroundings


def _suffixes(gram: int, window: int):
    """Compare the suffixes of a bucket, and the bytes before them read backwards.

    In suffix order, places that share ``d`` bytes are runs of neighbours with at least ``d`` shared bytes. A window
    with ``b`` bytes before the anchor repeats when another row is in the same run of depth ``window - b`` to the
    right and of depth ``b`` to the left.
    """
    left = window - gram

    def compare(table: pa.Table):
        raw = np.frombuffer(b"".join(table.column("context").to_pylist()), np.uint8).reshape(-1, left + window)
        ahead, room = (table.column(c).to_numpy().astype(np.int64) for c in ("before", "room"))
        n = len(raw)
        right, right_shared = multikey_sort(_tokens(raw[:, left:]))
        back, back_shared = multikey_sort(_tokens(raw[:, :left][:, ::-1]))
        least, most = np.full(n, left + 1), np.full(n, -1)
        one, two = np.empty(n, np.int64), np.empty(n, np.int64)
        for before in range(left + 1):
            rows = np.flatnonzero((ahead >= before) & (room >= window - before))
            if len(rows) < 2:
                continue
            one[right] = np.cumsum(right_shared < window - before)
            two[back] = np.cumsum(back_shared < before) if before else 0
            key = one[rows] * (n + 1) + two[rows]
            turn = np.argsort(key)
            key = key[turn]
            same = key[1:] == key[:-1]
            hit = rows[turn[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
            most[hit] = before
            least[hit] = np.minimum(least[hit], before)
        return least, most

    return compare


def byte_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **limits) -> DataFrame:
    """(doc_id, key, start, end): bytes covered by a string of ``window`` bytes that also starts anywhere else."""
    rule = Rule(_units, gram, window, False)
    return repeat_spans(docs, rule, _context(gram, window), "context binary, before short, room short", _suffixes(gram, window), **limits)


def suffix_digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **limits) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs and the hash of the kept bytes.

    A null text has no bytes; a text shorter than the window keeps all; equal rows are separate documents, so both
    lose what they share; repeats within a document count. An empty table gives no rows.
    """

    def finish(raw, starts, ends):
        if not len(starts):
            return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
        starts, ends = runs_of(np.asarray(starts), np.asarray(ends))
        keep = np.ones(len(raw), bool)
        for a, b in zip(starts.tolist(), ends.tolist()):
            keep[a:b] = False
        data = np.frombuffer(raw, np.uint8)[keep].tobytes()
        return len(raw), len(raw) - len(data), len(starts), hashlib.sha256(data).hexdigest()

    return with_spans(docs, byte_spans(docs, window, gram, **limits), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
