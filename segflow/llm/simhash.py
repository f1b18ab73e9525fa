"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.common import doc_ends, PLAIN, prepare, rolling, runs_of, text_buffers, words
from segflow.llm.shingles import SHINGLE, lowered, pieces, rarity, similarity, word_slots

SIMILAR = 0.8
#: Eight blocks of eight bits. Two fingerprints within RADIUS bits differ by at most NEAR bits in some block.
BLOCKS, NEAR = 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Benchmark items that are looked up in one pass over the documents; more items take more passes.
ITEMS = 4096
_GROUP = 1 << 14
_BYTE = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _fold(grams: np.ndarray) -> np.ndarray:
    return grams >> np.uint64(14)


def _weights(hashes: np.ndarray, rare: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Whole-number weight of the shingle at each word: sixteen times the mean rarity of its words."""
    sums = np.concatenate([[0.0], np.cumsum(rare[word_slots(hashes)], dtype=np.float64)])
    return np.rint((sums[width:] - sums[:-width]) * (16 / width)).astype(np.int64)


def _signs(grams: np.ndarray) -> np.ndarray:
    """64 signs of each shingle."""
    return np.unpackbits(grams.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1


def _sums(grams: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = np.zeros((len(grams) + 1, 64), np.int64)
    np.cumsum(_signs(grams) * weight[:, None], axis=0, out=out[1:])
    return out


def _bytes(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


class Items:
    """Benchmark items by their number of words, with fingerprints in a multi-index of blocks."""

    def __init__(self, ids: list, texts: list[str], rare: np.ndarray):
        data, at = text_buffers(lowered(pa.array(texts, pa.large_string())))
        _, _, first, hashes = words(data, at, PLAIN)
        self.ids, self.rare = ids, rare
        self.by_length: dict[int, list[int]] = {}
        self.grams, self.weights, self.prints = [], [], np.zeros((len(ids), BLOCKS), np.uint8)
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            own = hashes[a:b]
            if len(own) < SHINGLE:
                self.grams.append(np.zeros(0, np.uint64))
                self.weights.append(np.zeros(0, np.int64))
                if len(own):
                    self.short.setdefault(len(own), {}).setdefault(int(rolling(own, len(own))[0]), []).append(k)
                continue
            gram, weight = rolling(own, SHINGLE), _weights(own, rare)
            self.grams.append(gram)
            self.weights.append(weight)
            self.prints[k] = _bytes(_sums(gram, weight)[-1:])[0]
            self.by_length.setdefault(b - a, []).append(k)
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.grams]))
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.known >> np.uint64(48)).astype(np.int64)] = True
        self.longest = max(self.by_length, default=0)
        near = _BYTE[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= NEAR
        # per length and 64 items: for each block a table from its value to the items within NEAR bits there
        self.index = []
        for length, members in sorted(self.by_length.items()):
            for low in range(0, len(members), 64):
                some = np.array(members[low : low + 64])
                bits = np.uint64(1) << np.arange(len(some), dtype=np.uint64)
                tables = [np.bitwise_or.reduce(np.where(near[:, self.prints[some, b]], bits, np.uint64(0)), axis=1) for b in range(BLOCKS)]
                self.index.append((length, some, tables))

    def candidates(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(start, item) of windows whose fingerprint is within RADIUS of an item of their size.

        ``starts`` index the summed shingles; ``ends`` is for each the end of its run.
        """
        begin, item, last = [], [], None
        for length, some, tables in self.index:
            if last != length:
                last, place = length, starts[starts + (length - SHINGLE + 1) <= ends]
                prints = _bytes(sums[place + (length - SHINGLE + 1)] - sums[place])
            mask = tables[0][prints[:, 0]]
            for b in range(1, BLOCKS):
                mask = mask | tables[b][prints[:, b]]
            for k in range(len(some)):
                hit = np.flatnonzero(mask >> np.uint64(k) & np.uint64(1))
                hit = hit[_BYTE[prints[hit] ^ self.prints[some[k]]].sum(axis=1) <= RADIUS]
                begin.append(place[hit])
                item.append(np.full(len(hit), some[k]))
        join = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        return join(begin), join(item)

    def longer(self, prints: np.ndarray, count: np.ndarray):
        """(document, item) of whole documents within RADIUS of an item that has more words.

        ``prints`` are the fingerprints of whole documents and ``count`` their shingles.
        """
        doc, item = [], []
        for length, some, tables in self.index:
            place = np.flatnonzero(count < length - SHINGLE + 1)
            mask = tables[0][prints[place, 0]]
            for b in range(1, BLOCKS):
                mask = mask | tables[b][prints[place, b]]
            for k in range(len(some)):
                hit = place[np.flatnonzero(mask >> np.uint64(k) & np.uint64(1))]
                hit = hit[_BYTE[prints[hit] ^ self.prints[some[k]]].sum(axis=1) <= RADIUS]
                doc.append(hit)
                item.append(np.full(len(hit), some[k]))
        join = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        return join(doc), join(item)

    def verified(self, begin, item, grams, weights, count=None):
        """Exact weighted Jaccard similarity of each window with its item, as multisets of shingles.

        ``count`` has the shingles of each window; without it a window has as many as its item.
        """
        size = np.array([len(g) for g in self.grams])[item]
        row, step = _steps(size)
        window, shift = (row, step) if count is None else _steps(count)
        at = begin[window] + shift
        flat, offset = np.concatenate(self.grams), np.cumsum([0] + [len(g) for g in self.grams])
        own, heavy = flat[offset[item][row] + step], np.concatenate(self.weights)[offset[item][row] + step]
        return similarity(len(item), _summed(window, _fold(grams[at]), weights[at]), _summed(row, _fold(own), heavy))


def _steps(size: np.ndarray):
    """(row, step) of ``size`` steps a row."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def _summed(row: np.ndarray, gram: np.ndarray, weight: np.ndarray):
    key = (row.astype(np.uint64) << np.uint64(50)) | gram
    turn = np.argsort(key, kind="stable")
    key = key[turn]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight[turn], new) if len(new) else np.zeros(0)
    key = key[new]
    return (key >> np.uint64(50)).astype(np.int64), key & np.uint64((1 << 50) - 1), total.astype(np.float64)


def _scan(items: Items, data: np.ndarray, at: np.ndarray, similar: float):
    """(document, item, similarity, first word, words) of the best window of each document and item that it holds."""
    _, _, first, hashes = words(data, at, PLAIN)
    found = []
    for length, table in items.short.items():
        if len(hashes) >= length:
            gram = rolling(hashes, length)
            ends = doc_ends(first)
            some = np.flatnonzero(np.isin(gram, np.array(list(table), np.uint64)) & (np.arange(len(gram)) + length <= ends[: len(gram)]))
            for p in some.tolist():
                doc = int(np.searchsorted(first, p, "right")) - 1
                found += [(doc, k, 1.0, p - int(first[doc]), length) for k in table[int(gram[p])]]
    if len(hashes) >= SHINGLE and len(items.known):
        gram = rolling(hashes, SHINGLE)
        maybe = np.flatnonzero(items.filter[(gram >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(items.known, gram[maybe]), len(items.known) - 1)
        hit = maybe[items.known[place] == gram[maybe]]
        ends = doc_ends(first)
        hit = hit[hit + SHINGLE <= ends[hit]]
        doc = np.searchsorted(first, hit, "right") - 1
        # a window with enough similarity shares a shingle, so it lies within an item's size of a shared one
        low, high = runs_of(np.maximum(hit - items.longest, first[doc]), np.minimum(hit + items.longest, first[doc + 1]))
        owner = np.searchsorted(first, low, "right") - 1
        weight = _weights(hashes, items.rare)
        # a document with fewer words than an item has no window of its size: it is one window itself
        some = np.unique(doc)
        some = some[first[some + 1] - first[some] < items.longest]
        start, size = first[some], first[some + 1] - first[some] - SHINGLE + 1
        group = 0
        while group < len(some):
            upto = max(group + 1, int(np.searchsorted(np.cumsum(size[group:]), _GROUP)) + group)
            row, step = _steps(size[group:upto])
            index = start[group:upto][row] + step
            ends_at = np.cumsum(size[group:upto])
            sums = _sums(gram[index], weight[index])
            own, item = items.longer(_bytes(sums[ends_at] - sums[ends_at - size[group:upto]]), size[group:upto])
            for cut in range(0, len(own), 1 << 13):
                o, k = own[cut : cut + (1 << 13)] + group, item[cut : cut + (1 << 13)]
                near = items.verified(start[o], k, gram, weight, size[o])
                found += [(int(some[p]), q, s, 0, int(size[p]) + SHINGLE - 1) for p, q, s in zip(o[near >= similar].tolist(), k[near >= similar].tolist(), near[near >= similar].tolist())]
            group = upto
        group = 0
        while group < len(low):
            upto = max(group + 1, int(np.searchsorted(np.cumsum(high[group:] - low[group:]), _GROUP)) + group)
            spans = []  # shingle ranges of the runs, cut at the ends of their documents
            for a, b, d in zip(low[group:upto].tolist(), high[group:upto].tolist(), owner[group:upto].tolist()):
                while a < b:
                    z = min(b, int(first[d + 1]))
                    if z - a >= SHINGLE:
                        spans.append((a, z - SHINGLE + 1))
                    a, d = z, d + 1
            group = upto
            if not spans:
                continue
            index = np.concatenate([np.arange(a, z) for a, z in spans])
            size = np.array([z - a for a, z in spans])
            stop = np.repeat(np.cumsum(size), size)
            begin, item = items.candidates(_sums(gram[index], weight[index]), np.arange(len(index)), stop)
            for cut in range(0, len(begin), 1 << 13):
                b, k = begin[cut : cut + (1 << 13)], item[cut : cut + (1 << 13)]
                near = items.verified(b, k, gram[index], weight[index])
                for p, q, s in zip(index[b[near >= similar]].tolist(), k[near >= similar].tolist(), near[near >= similar].tolist()):
                    d = int(np.searchsorted(first, p, "right")) - 1
                    found.append((d, q, s, p - int(first[d]), len(items.grams[q]) + SHINGLE - 1))
    best: dict = {}
    for row in found:
        old = best.get(row[:2])
        if old is None or (-row[2], row[3]) < (-old[2], old[3]):
            best[row[:2]] = row
    return [best[k] for k in sorted(best)]


def item_blocks(benchmark: DataFrame, rare: np.ndarray, limit: int = ITEMS):
    """The stated item set in blocks of about ``limit`` items; null and empty items match nothing."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    parts = 1 + rows.count() // limit
    for part in range(parts):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        yield Items([r["item_id"] for r in some], [r["text"] for r in some], rare)


def leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, limit: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each document that repeats an item.

    Weights of shingles come from document frequencies over all ``docs``. An item of one to four words matches where
    its words stand in a row. A document of fewer words than an item is one window. Documents without a match, null and empty texts give no row.
    """
    prepare(docs.sparkSession)
    rare, out = rarity(docs), None
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    for items in item_blocks(benchmark, rare, limit):

        def find(stream, items=items):
            for batch in stream:
                data, offsets = text_buffers(lowered(batch.column("text")))
                ids = batch.column("doc_id").to_pylist()
                for low, high in pieces(offsets):
                    rows = _scan(items, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], similar)
                    if rows:
                        doc, item, near, first, size = zip(*rows)
                        arrays = [[ids[low + d] for d in doc], [items.ids[k] for k in item], near, first, size]
                        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        rows = own.mapInArrow(find, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = rows if out is None else out.unionByName(rows)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, limit: int = ITEMS) -> DataFrame:
    """``docs`` with all columns, without the documents that hold a benchmark item; nothing is shuffled."""
    prepare(docs.sparkSession)
    rare, schema = rarity(docs), docs.schema
    for items in item_blocks(benchmark, rare, limit):

        def drop(stream, items=items):
            for batch in stream:
                data, offsets = text_buffers(lowered(batch.column("text").fill_null("")))
                keep = np.ones(batch.num_rows, bool)
                for low, high in pieces(offsets):
                    for row in _scan(items, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], similar):
                        keep[low + row[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(drop, schema)
    return docs
