"""Token ids of whole texts by a public tokenizer; distinct words of a batch are encoded once."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from segflow.llm.common import SPACE, chunks, text_buffers

#: Bytes of text whose distinct words are encoded together.
BATCH_BYTES = 10 << 20
#: Bytes of an Arrow batch for it.
ARROW_BYTES = 12 << 20
#: Words that a worker remembers with their ids (about 100 MB); words met once in a batch are not kept.
CACHE_WORDS = 400_000
_MARK = "\x01"
#: Parts of one call; few enough for the library's own cache.
_CALL = 1024
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".,;:!?|"]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer and the words that this worker remembers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # for parts of texts without such strings; the others are encoded whole
    return made, {}


@lru_cache(maxsize=4)
def _untouched(path: str):
    """The tokenizer as it is, and the strings that it takes as one token each."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    return made, sorted({t.content for t in made.get_added_tokens_decoder().values() if t.content})


@lru_cache(maxsize=4)
def _folds_case(path: str) -> bool:
    """Whether the tokenizer itself takes capital letters for small ones; then words are told apart after that."""
    normalizer = tokenizer(path)[0].normalizer
    return normalizer is not None and normalizer.normalize_str("AZ") == "az"


@lru_cache(maxsize=4)
def _edges(path: str) -> tuple[bool, np.ndarray]:
    """Whether the ids that are marked end a word (else they begin one with its space), and which ids are."""
    words = tokenizer(path)[0].get_vocab()
    ends = any(t.endswith("</w>") for t in words)
    marked = np.zeros(max(words.values()) + 1, bool)
    marked[[i for t, i in words.items() if (t.endswith("</w>") if ends else t.startswith("\u0120"))]] = True
    return ends, marked


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where no token of either tokenizer can reach across: document edges, before a single space between two
    words, and between a letter and a stop."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        blank = SPACE[data]
        cut[1:-2] = (data[1:-1] == 32) & ~blank[:-2] & ~blank[2:]
        cut[1:-1] |= _LETTERS[data[:-1]] & _STOPS[data[1:]]
    cut[offsets] = True
    return np.flatnonzero(cut)


def _encoded(path: str, parts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(order, ids, lengths): ids of the parts, one after the other in ``order``.

    Many parts are encoded in one call: a space and letters are one word, whose first or last id shows it; other parts
    that begin with a space get a mark after them that no token crosses. What does not come out part by part, and
    parts at the beginning of a text, are encoded each by itself.
    """
    made, _ = tokenizer(path)
    ends, marked = _edges(path)
    mark = made.encode_batch_fast([" " + _MARK], add_special_tokens=False)[0].ids
    plain = [i for i, p in enumerate(parts) if p[:1] == " " and p[1:].isalpha()]
    known = set(plain)
    joint = [i for i, p in enumerate(parts) if i not in known and p[:1] == " " and _MARK not in p]
    known.update(joint)
    alone = [i for i in range(len(parts)) if i not in known]
    order, flats, lengths = [], [], []
    for group, sign in ((plain, ""), (joint, " " + _MARK)):
        for low in range(0, len(group), _CALL):
            some = group[low : low + _CALL]
            flat = np.array(made.encode_batch_fast(["".join([parts[i] + sign for i in some])], add_special_tokens=False)[0].ids, np.uint32)
            if sign:
                stops = np.flatnonzero(flat == mark[-1])
                size = np.diff(stops, prepend=-1) - len(mark)
            else:
                edge = np.flatnonzero(marked[flat])
                size = np.diff(edge, prepend=-1) if ends else np.diff(edge, append=len(flat))
            if len(size) != len(some):
                alone += some
                continue
            if sign:
                keep = np.ones(len(flat), bool)
                for back in range(len(mark)):
                    keep[stops - back] = False
                flat = flat[keep]
            order += some
            flats.append(flat)
            lengths.append(size)
    for low in range(0, len(alone), _CALL):
        some = alone[low : low + _CALL]
        ids = [e.ids for e in made.encode_batch_fast([parts[i] for i in some], add_special_tokens=False)]
        order += some
        flats.append(np.fromiter((v for own in ids for v in own), np.uint32))
        lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
    join = lambda arrays, kind: np.concatenate(arrays) if arrays else np.zeros(0, kind)
    return order, join(flats, np.uint32), join(lengths, np.int64)


def _table(path: str, cache: dict, parts: list[str], counts: np.ndarray, remember: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, start, length) of every part; remembered words first, the rest encoded now."""
    known = [cache.get(p) for p in parts]
    old = [i for i, v in enumerate(known) if v is not None]
    new = [i for i, v in enumerate(known) if v is None]
    order, flat, lengths = _encoded(path, [parts[i] for i in new])
    ends = np.cumsum(lengths)
    if len(cache) < remember:
        for k in np.flatnonzero(counts[np.array(new, np.int64)[order]] > 1).tolist() if order else ():
            cache[parts[new[order[k]]]] = flat[ends[k] - lengths[k] : ends[k]].tobytes()
    seen = [known[i] for i in old]
    ids = np.concatenate([np.frombuffer(b"".join(seen), np.uint32), flat])
    length = np.empty(len(parts), np.int32)
    start = np.empty(len(parts), np.int32)
    place = np.array(old + [new[k] for k in order], np.int64)
    size = np.concatenate([np.fromiter((len(v) // 4 for v in seen), np.int64, len(seen)), lengths])
    length[place] = size
    start[place] = np.cumsum(size) - size
    return ids, start, length


def _ranges(path: str, column, offsets: np.ndarray):
    """(first, last, whole): ranges of documents; one that holds a token's own string is a range of its own."""
    special = np.zeros(len(column), bool)
    for text in _untouched(path)[1]:
        special |= pc.match_substring(column, text, ignore_case=True).to_numpy(zero_copy_only=False)
    for first, last in chunks(offsets, BATCH_BYTES):
        edges = sorted({first, last, *(k + d for k in (first + np.flatnonzero(special[first:last])).tolist() for d in (0, 1))})
        for low, high in zip(edges, edges[1:]):
            yield low, high, bool(special[low])


def batches(path: str, column, end_id: int, remember: int = CACHE_WORDS):
    """For ranges of documents: (first, last, ids of all of them, offsets by document); ``end_id`` closes each.

    The ids are those of the library's call for the whole text. A text with a string that the tokenizer takes as one
    token is given to the library as it is; others are cut where no token can reach across.
    """
    cache = tokenizer(path)[1]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data, offsets = text_buffers(column)
    for first, last, whole in _ranges(path, column, offsets):
        if whole:
            ids = _untouched(path)[0].encode(column[first].as_py(), add_special_tokens=False).ids
            yield first, last, np.array([*ids, end_id], np.uint32), np.array([0, len(ids) + 1])
            continue
        own = np.ascontiguousarray(data[offsets[first] : offsets[last]])
        at = offsets[first : last + 1] - offsets[first]
        if _folds_case(path):
            own = _SMALL[own]
        cut = _cuts(own, at)
        parts = pa.Array.from_buffers(pa.large_string(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(own)])
        coded = parts.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        ids, start, length = _table(path, cache, coded.dictionary.to_pylist(), np.bincount(index, minlength=len(coded.dictionary)), remember)
        del parts, coded
        ids, start, length = np.append(ids, np.uint32(end_id)), np.append(start, np.int32(len(ids))), np.append(length, np.int32(1))
        closes = np.searchsorted(cut, at[1:])
        index = np.insert(index, closes, len(start) - 1)
        size = length[index]
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(start[index] - (ends - size).astype(np.int32), size)
        take += np.arange(total, dtype=np.int32)
        yield first, last, ids[take], np.concatenate([[0], ends[closes + np.arange(len(closes))]])
        pa.default_memory_pool().release_unused()
