"""Phrase collocations: a prefix-free parse into overlapping chunks, n-grams counted once in each distinct chunk."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segflow.llm.common import chunks, doc_ends, mixed, prepare, rolling, signed, stored, text_buffers, words
from segflow.llm.repeats import unpacked

#: Words of the longest phrase, and words that a chunk shares with the next: a phrase that starts before them is inside.
LONGEST = 5
OVERLAP = LONGEST - 1
#: A chunk starts at about one word in so many.
SPACING = 64
#: Bits of the table of frequent keys: it only leaves out what cannot be frequent, so its size bounds memory, not results.
MOST_BITS = 26
#: Bits of a key that is counted, and of the group of keys that one task sums: the highest of them.
KEY_BITS, GROUP_BITS = 40, 12
#: A key's places in that table: its bits from these on.
PROBES = (0, KEY_BITS - MOST_BITS)
#: Groups that a language's phrases are ordered in before the last order, so that no task orders all of them.
SALTS = 64
BATCH = 8 << 20

BREAKS = np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
INSIDE = ~BREAKS
INSIDE[[32, 9]] = False


def _breaks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word whether a piece ends between the word before and it."""
    seen = np.concatenate([[0], np.cumsum(BREAKS[data])])
    out = np.ones(len(starts), bool)
    out[1:] = seen[starts[1:]] > seen[ends[:-1]]
    return out


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, chunk, tail, freq): the distinct chunks of the parse and how often each occurs.

    A chunk starts where the hash of ``OVERLAP`` words says so, and ends with those of the next start; the phrases that
    start in its last ``tail`` words belong to the next chunk. So equal passages have equal chunks wherever they stand.
    """
    prepare(docs.sparkSession)

    def parse(stream):
        for batch in stream:
            data, offsets = text_buffers(batch.column("text"))
            for low, high in chunks(offsets):
                own, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                own = own + ((own >= 65) & (own <= 90)).astype(np.uint8) * np.uint8(32)
                starts, ends, first, hashes = words(own, at, INSIDE)
                if not len(starts):
                    continue
                last = doc_ends(first)
                keyed = hashes + _breaks(own, starts, ends).astype(np.uint64)
                window = rolling(keyed, OVERLAP)
                begins = np.zeros(len(starts), bool)
                begins[: len(window)] = (window % np.uint64(SPACING) == 0) & (np.arange(len(window)) + OVERLAP <= last[: len(window)])
                begins[first[:-1][np.diff(first) > 0]] = True
                begin = np.flatnonzero(begins)
                follow = np.append(begin[1:], len(starts))
                whole = follow == last[begin]
                stop = np.where(whole, follow, follow + OVERLAP)
                left, size = starts[begin], ends[stop - 1] - starts[begin]
                edge = np.concatenate([[0], np.cumsum(size)])
                take = np.arange(edge[-1]) + np.repeat(left - edge[:-1], size)
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(own[take])])
                doc = np.searchsorted(first, begin, "right") - 1
                tail = np.where(whole, 0, OVERLAP).astype(np.int32)
                lang = batch.column("lang").slice(low, high - low).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([lang, text.cast(pa.binary()), pa.array(tail)], names=["lang", "chunk", "tail"])

    narrow = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text")).where(F.length("text") > 0)
    return narrow.mapInArrow(parse, "lang string, chunk binary, tail int").groupBy("lang", "chunk", "tail").agg(F.count(F.lit(1)).alias("freq"))


class _Part:
    """The words of some chunks of the dictionary, and which phrases start at each."""

    def __init__(self, batch, low, high, data, offsets):
        own, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        self.starts, self.ends, first, hashes = words(own, at, INSIDE)
        self.data, self.n = own, len(self.starts)
        chunk = np.repeat(np.arange(high - low), np.diff(first))
        self.weight = batch.column("freq").slice(low, high - low).to_numpy()[chunk]
        lang = pc.dictionary_encode(batch.column("lang").slice(low, high - low))
        self.langs, self.lang = lang.dictionary, lang.indices.to_numpy()[chunk].astype(np.int64)
        own_start = np.zeros(self.n, bool)
        own_start[first[:-1][np.diff(first) > 0]] = True
        self.piece = np.cumsum(_breaks(own, self.starts, self.ends) | own_start)
        self.counted = np.arange(self.n) < (first[1:] - batch.column("tail").slice(low, high - low).to_numpy())[chunk]
        seed = np.array([int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") for v in self.langs.to_pylist()], np.uint64)
        self.keyed = mixed(hashes ^ seed[self.lang]) if self.n else hashes

    def together(self, size: int) -> np.ndarray:
        """Places where ``size`` words stand in one piece."""
        count = max(self.n - size + 1, 0)
        return self.piece[:count] == self.piece[size - 1 : size - 1 + count]

    def flagged(self, size: int, bits: np.ndarray) -> np.ndarray:
        key, out = _keys(self.keyed, size), True
        for shift in PROBES:
            slot = (key >> np.uint64(shift)) & np.uint64(len(bits) * 64 - 1)
            out = out & ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1)
        return out


def _parts(stream):
    for batch in stream:
        data, offsets = text_buffers(batch.column("chunk"))
        for low, high in chunks(offsets, BATCH):
            part = _Part(batch, low, high, data, offsets)
            if part.n:
                yield part


def _grouped(key: np.ndarray, weight: np.ndarray):
    """Distinct keys as (rank of each row, a row of each key, sum of weights)."""
    turn = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[turn][1:] != key[turn][:-1]])[: len(key)]
    rank = np.empty(len(key), np.int64)
    rank[turn] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return rank, turn[at], np.add.reduceat(weight[turn], at) if len(at) else weight[:0]


def _keys(keyed: np.ndarray, size: int) -> np.ndarray:
    return rolling(keyed, size) & np.uint64((1 << KEY_BITS) - 1)


def _squeezed(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """(part, packed): ascending keys and their counts, by the highest bits of the key; gaps are stored, by place of the byte."""
    if not len(key):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.binary())], names=["part", "packed"])
    part = (key >> np.uint64(KEY_BITS - GROUP_BITS)).astype(np.int32)
    edge = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(key)]])
    low = (key & np.uint64((1 << KEY_BITS - GROUP_BITS) - 1)).astype("<u4")
    gap = np.diff(low, prepend=low[:1])
    gap[edge[:-1]] = low[edge[:-1]]
    rows = np.concatenate([gap.view(np.uint8).reshape(-1, 4), n.astype("<i8").view(np.uint8).reshape(-1, 8)], axis=1)
    press = zstandard.ZstdCompressor(level=1)
    packed = [press.compress(rows[a:b].T.tobytes()) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
    return pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]]), pa.array(packed, pa.binary())], names=["part", "packed"])


def _summed(part: int, packed: list[bytes], least: int) -> pa.RecordBatch:
    """The keys of a part whose counts sum up to ``least``."""
    key, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for rows in packed:
        rows = np.frombuffer(rows, np.uint8).reshape(12, -1).T
        key.append(np.cumsum(np.ascontiguousarray(rows[:, :4]).view("<u4").ravel(), dtype=np.uint64))
        n.append(np.ascontiguousarray(rows[:, 4:]).view("<i8").ravel())
    key, n = np.concatenate(key), np.concatenate(n)
    _, one, total = _grouped(key, n)
    often = key[one][total >= least] | np.uint64(part << KEY_BITS - GROUP_BITS)
    return pa.RecordBatch.from_arrays([pa.array(signed(often))], names=["key"])


def _frequent(chunk: DataFrame, size: int, least: int, below: np.ndarray | None) -> np.ndarray:
    """Bits of the hashes of the phrases of ``size`` words that may occur ``least`` times.

    Two phrases of one hash count together, so a bit may be set too much but none is missing. Each batch's counts go to
    the shuffle as sorted and packed lists of the keys of a part, which take fewer bytes than rows.
    """

    def count(stream):
        for part in _parts(stream):
            ok = part.together(size)
            ok &= part.counted[: len(ok)]
            if below is not None:
                once = part.flagged(1, below)
                for k in range(size):
                    ok &= once[k : k + len(ok)]
            at = np.flatnonzero(ok)
            key = _keys(part.keyed, size)[at]
            _, one, total = _grouped(key, part.weight[at])
            yield _squeezed(key[one], total)

    def add(stream):
        part, packed = 0, []
        for batch in stream:
            for own, rows in zip(batch.column("part").to_pylist(), unpacked(batch.column("packed"))):
                if own != part:
                    yield _summed(part, packed, least)
                    part, packed = own, []
                packed.append(rows)
        yield _summed(part, packed, least)

    counted = lambda: chunk.mapInArrow(count, "part int, packed binary").repartition("part").sortWithinPartitions("part")
    # nothing here refers to what was shuffled once the keys are stored, so Spark can delete it before the next pass
    keys = stored(counted().mapInArrow(add, "key long"), "frequent")
    bits = 1 << min(MOST_BITS, max(16, (64 * keys.count()).bit_length()))
    slots = [F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(bits - 1)) for shift in PROBES]
    slots = keys.select(F.explode(F.array(*slots)).alias("slot"))
    mark = F.expr("shiftleft(1L, cast(slot & 63L as int))")
    rows = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(mark).alias("mark")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("mark").to_numpy().view(np.uint64)
    return out


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, size, n) of the phrases of one to five words that occur ``least`` times, and the words of each lang as size 0.

    Two passes over the distinct chunks find by hash which words, then which pairs can be frequent; the third counts
    by the words themselves the phrases whose pairs all can be.
    """
    spark = docs.sparkSession
    chunk = stored(dictionary(docs), "parse")
    prepare(spark, BATCH)
    single = _frequent(chunk, 1, least, None)
    double = _frequent(chunk, 2, least, single)

    def count(stream):
        for part in _parts(stream):
            lens = part.ends - part.starts
            edge = np.concatenate([[0], np.cumsum(lens)])
            raw = part.data[np.arange(edge[-1]) + np.repeat(part.starts - edge[:-1], lens)]
            coded = pc.dictionary_encode(pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.n, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(raw)]))
            known, word = coded.dictionary.cast(pa.large_string()), coded.indices.to_numpy().astype(np.int64)
            total = np.zeros(len(part.langs), np.int64)
            np.add.at(total, part.lang, part.weight * part.counted)
            empty = pa.nulls(len(total), pa.large_string())
            yield _counted(part.langs, empty, 0, total)
            once = part.flagged(1, single)
            pair = part.flagged(2, double)
            count = max(part.n - 1, 0)
            pair &= part.together(2) & once[:count] & once[1 : 1 + count]
            at = np.flatnonzero(once)
            rank = part.lang[at] * len(known) + word[at]
            for size in range(1, LONGEST + 1):
                if size > 1:  # extend the phrases of one word less, where the pair at their end may be frequent
                    more = at + size - 2 < len(pair)
                    more[more] = pair[at[more] + size - 2]
                    at, rank = at[more], rank[more]
                    rank = rank * len(known) + word[at + size - 1]
                rank, one, n = _grouped(rank, part.weight[at] * part.counted[at])
                one, n = one[n > 0], n[n > 0]
                columns = [known.take(pa.array(word[at[one] + k])) for k in range(size)]
                phrase = columns[0] if size == 1 else pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()))
                yield _counted(part.langs.take(pa.array(part.lang[at[one]])), phrase, size, n)

    rows = chunk.mapInArrow(count, "lang string, phrase string, size int, n long")
    rows = rows.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return rows.where((F.col("n") >= least) | (F.col("size") == 0))


def _counted(lang, phrase, size, n):
    return pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(np.full(len(n), size, np.int32)), pa.array(n)], names=["lang", "phrase", "size", "n"])


def _parts_of(phrase, size):
    """Contiguous parts of two or more words of a phrase, but itself."""
    word = F.split(phrase, " ")
    each = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice(word, i, m), " "))))
    return F.array_distinct(each)


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, share: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each lang by the score of their weakest cut.

    Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line ends and into words at blanks and tabs. A
    phrase of two to five words that occurs ``least`` times is a candidate; it goes when a longer candidate holds its
    words and has ``share`` hundredths of its count. The score of a cut is floor(1000 a n / (l r)), in whole numbers of
    up to 38 digits. A null or empty text has no words, a null lang is ``und``, repeated rows count each, doc_id is not
    read, ties go by count and then by the bytes of the phrase; an empty table gives no rows.
    """
    found = stored(phrase_counts(docs, least), "phrases")
    totals = found.where("size = 0").select("lang", F.col("n").alias("words"))
    counts = found.where("size > 0").select("lang", "phrase", "size", "n")
    cuts = counts.where("size > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    word = F.split("phrase", " ")
    cuts = cuts.select("lang", "phrase", "n", "k", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice(word, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    side = counts.select("lang", "phrase", "n")
    cuts = cuts.join(side.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(side.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= 10000 else totals, "lang")
    cuts = cuts.withColumn("score", F.expr("(cast(1000 as decimal(38,0)) * n * words) div (cast(l as decimal(38,0)) * r)"))
    weakest = F.min(F.struct("score", "k", "l", "r", "words")).alias("cut")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("n").alias("a"), weakest)
    longer = counts.where("size > 2").select("lang", F.explode(_parts_of(F.col("phrase"), F.col("size"))).alias("phrase"), F.col("n").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.words").alias("n"), "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
