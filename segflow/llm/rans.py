"""Token ids in files coded by a static range asymmetric numeral system.

Layout of a segment (little endian): magic ``SFR1``, documents (u32), tokens (u64), blocks (u32), lanes (u32), crc32 of
the frequency table (u32); per document its id (i64) and its tokens (u32); per block a checkpoint: first token (u64),
byte where it starts (u64), tokens (u32), words (u32), crc32 of its ids (u32); then the blocks: the coder state of each
lane (u64) and the words (u32). Token i of a block is in lane i modulo lanes. Blocks decode independently.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segflow.llm.common import partitions, stored, texts
from segflow.llm.repeats import NO_ID
from segflow.llm.tokens import ARROW_BYTES, batches, tokenizer

SCALE = 20
LANES = 1024
BLOCK_TOKENS = 1 << 18
SEGMENT_TOKENS = 1 << 22
#: Segments in a file; Spark reads the rows of a file in batches.
FILE_SEGMENTS = 16
#: Bytes of text of an id range, and the most that one has when there are over RANGES of the first size.
RANGE_BYTES, MOST_RANGE_BYTES = 8 << 20, 64 << 20
RANGES = 4096
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIQIII")
_POINT = np.dtype([("first", "<u8"), ("byte", "<u8"), ("tokens", "<u4"), ("words", "<u4"), ("crc", "<u4")])


class Model:
    """Frequencies that sum to ``2 ** SCALE``, at least one for each id, shared by all blocks."""

    def __init__(self, counts: np.ndarray):
        room = (1 << SCALE) - len(counts)
        if room < 0:
            raise ValueError("more ids than the frequency table can hold")
        total = max(1, int(counts.sum()))
        freq = 1 + (counts.astype(object) * room // total).astype(np.int64) if total > 1 << 40 else 1 + counts.astype(np.int64) * room // total
        if len(freq):
            freq[int(np.argmax(counts))] += (1 << SCALE) - int(freq.sum())
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self.symbol = None

    def lookup(self) -> np.ndarray:
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self.symbol


def encode_block(model: Model, ids: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """(state of each lane, words): all lanes step together, from the last row of tokens to the first."""
    state, out = np.full(lanes, _LOW, np.uint64), []
    for first in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        row = ids[first : first + lanes]
        x, freq = state[: len(row)], model.freq[row]
        full = x >= (freq << np.uint64(63 - SCALE))
        out.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(full, x >> np.uint64(32), x)
        whole = x // freq
        state[: len(row)] = (whole << np.uint64(SCALE)) + (x - whole * freq) + model.start[row]
    return state, np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")


def decode_block(model: Model, tokens: int, state: np.ndarray, words: np.ndarray) -> np.ndarray:
    lanes, lookup, mask, at = len(state), model.lookup(), np.uint64((1 << SCALE) - 1), 0
    state, ids = state.copy(), np.empty(tokens, np.uint32)
    for first in range(0, tokens, lanes):
        x = state[: min(lanes, tokens - first)]
        slot = x & mask
        row = lookup[slot]
        ids[first : first + len(x)] = row
        x = model.freq[row] * (x >> np.uint64(SCALE)) + slot - model.start[row]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
        at += len(low)
        state[: len(x)] = x
    if at != len(words) or (state != _LOW).any():
        raise ValueError("a block does not end where it began")
    return ids


def write_segment(model: Model, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK_TOKENS) -> bytes:
    points, bodies, lanes = np.zeros(-(-len(ids) // block), _POINT), [], LANES
    at = _HEAD.size + 12 * len(doc_ids) + points.nbytes
    for k in range(len(points)):
        own = ids[k * block : (k + 1) * block]
        state, words = encode_block(model, own, lanes)
        body = state.astype("<u8").tobytes() + words.tobytes()
        points[k] = (k * block, at, len(own), len(words), zlib.crc32(own.astype("<u4").tobytes()))
        at += len(body)
        bodies.append(body)
    head = _HEAD.pack(b"SFR1", len(doc_ids), len(ids), len(points), lanes, model.crc)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), points.tobytes(), *bodies])


def read_segment(model: Model, data: bytes, blocks=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, sizes, token ids) of a segment, or the tokens of some of its ``blocks``; checksums are verified."""
    magic, docs, tokens, count, lanes, crc = _HEAD.unpack_from(data)
    if magic != b"SFR1" or crc != model.crc:
        raise ValueError("not a segment of this frequency table")
    doc_ids = np.frombuffer(data, "<i8", docs, _HEAD.size)
    sizes = np.frombuffer(data, "<u4", docs, _HEAD.size + 8 * docs)
    points = np.frombuffer(data, _POINT, count, _HEAD.size + 12 * docs)
    out = []
    for p in points if blocks is None else points[list(blocks)]:
        at = int(p["byte"])
        state = np.frombuffer(data, "<u8", lanes, at)
        words = np.frombuffer(data, "<u4", int(p["words"]), at + 8 * lanes)
        ids = decode_block(model, int(p["tokens"]), state, words)
        if zlib.crc32(ids.astype("<u4").tobytes()) != p["crc"]:
            raise ValueError("a block does not match its checksum")
        out.append(ids)
    return doc_ids, sizes, np.concatenate(out) if out else np.zeros(0, np.uint32)


def _ranges(docs: DataFrame) -> list[int]:
    """Ids that split the documents into ranges of RANGE_BYTES to MOST_RANGE_BYTES of text, however many these are."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    parts = 1 + max(min(RANGES, total // RANGE_BYTES), total // MOST_RANGE_BYTES)
    if parts == 1:
        return []
    found = sized.where("doc_id is not null").select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], F.lit(max(10_000, 4 * parts))).alias("q")).first()["q"]
    return sorted(set(found or []))


def raw_segments(docs: DataFrame, path: str, end_id: int, wide: bool) -> DataFrame:
    """(bucket, part, doc_ids, sizes, ids): token ids in ascending doc_id order, cut into segments between documents."""
    splits = np.array(_ranges(docs), np.int64)
    kind = np.dtype("<u4" if wide else "<u2")

    def encode(stream):
        for batch in stream:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            for first, last, flat, at in batches(path, batch.column("text"), end_id):
                own, raw = ids[first:last], flat.astype(kind).tobytes()
                cut = pa.py_buffer((at * kind.itemsize).astype(np.int64))
                data = pa.Array.from_buffers(pa.large_binary(), last - first, [None, cut, pa.py_buffer(raw)]).cast(pa.binary())
                bucket = pa.array(np.searchsorted(splits, own, "right").astype(np.int32))
                yield pa.RecordBatch.from_arrays([bucket, pa.array(own), data], names=["bucket", "doc_id", "ids"])

    def gather(stream):
        part, bucket, own, data, size = 0, None, [], [], 0

        def closed():
            names = ["bucket", "part", "doc_ids", "sizes", "ids"]
            sizes = [len(d) // kind.itemsize for d in data]
            columns = [pa.array([bucket], pa.int32()), pa.array([part], pa.int32()), pa.array([own], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(data)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in stream:
            for b, d, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "ids"))):
                if own and (b != bucket or size >= SEGMENT_TOKENS * kind.itemsize):
                    yield closed()
                    part, own, data, size = (part + 1 if b == bucket else 0), [], [], 0
                bucket = b
                own.append(d)
                data.append(raw)
                size += len(raw)
        if own:
            yield closed()

    rows = texts(docs, ARROW_BYTES).mapInArrow(encode, "bucket int, doc_id long, ids binary")
    # ids break ties between rows of one doc_id
    rows = rows.repartition(max(partitions(docs.sparkSession), 1 + len(splits) // 8), "bucket").sortWithinPartitions("bucket", "doc_id", F.crc32("ids"))
    return rows.mapInArrow(gather, "bucket int, part int, doc_ids array<long>, sizes array<int>, ids binary")


def write_tokens(docs: DataFrame, path: str, end_id: int = 2) -> tuple[DataFrame, Model]:
    """Files of coded segments (bucket, part, tokens, segment) and their shared frequency table.

    The table counts every token of every document; it has one number per id of the tokenizer, so it is bounded.
    """
    # coded segments do not get smaller by a compression of the file, ids hardly
    size = max(tokenizer(path)[0].get_vocab_size(), end_id + 1)
    wide = size > 1 << 16
    kind = np.dtype("<u4" if wide else "<u2")
    raw = stored(raw_segments(docs, path, end_id, wide), "token-ids", FILE_SEGMENTS, "snappy")

    def count(stream):
        total = np.zeros(size, np.int64)
        for batch in stream:
            for data in batch.column("ids").to_pylist():
                total += np.bincount(np.frombuffer(data, kind), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in raw.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    model = Model(counts)

    def code(stream):
        for batch in stream:
            for b, p, d, s, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "doc_ids", "sizes", "ids"))):
                ids = np.frombuffer(data, kind)
                segment = write_segment(model, np.array(d, np.int64), np.array(s, np.int64), ids)
                columns = [pa.array([b], pa.int32()), pa.array([p], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([segment], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "part", "tokens", "segment"])

    return stored(raw.mapInArrow(code, "bucket int, part int, tokens long, segment binary"), "token-files", FILE_SEGMENTS, "uncompressed"), model


def read_tokens(files: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the coded segments alone."""
    bucket = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = files.select("bucket", "part", "tokens")
    sums = heads.groupBy("bucket").agg(F.sum("tokens").alias("n"))  # one row for each range of 8 to 64 MB
    whole = Window.partitionBy().orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("before"))
    places = heads.select("bucket", "part", F.coalesce(F.sum("tokens").over(bucket), F.lit(0)).alias("inside")).join(sums, "bucket")

    def decode(stream):
        for batch in stream:
            for b, p, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "segment"))):
                doc_ids, sizes, ids = read_segment(model, data)
                ends = np.cumsum(sizes, dtype=np.int64)
                begins, raw = ends - sizes, ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(begins.tolist(), ends.tolist())]
                n = len(doc_ids)
                columns = [np.full(n, b, np.int32), np.full(n, p, np.int32), doc_ids, begins, sizes.astype(np.int64), np.array(crc, np.int64)]
                arrays = [pa.array(c) for c in columns]
                arrays[2] = pa.array(doc_ids, mask=doc_ids == NO_ID)
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "part", "doc_id", "begin", "n_tokens", "ids_crc32"])

    rows = files.select("bucket", "part", "segment").mapInArrow(decode, "bucket int, part int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    rows = rows.join(places, ["bucket", "part"])
    return rows.select("doc_id", (F.col("before") + F.col("inside") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the ids of all documents and read them back.

    A null or empty text is the end id alone; a null doc_id comes last; rows of one doc_id are separate documents,
    one after the other; an empty table gives no rows.
    """
    return read_tokens(*write_tokens(docs, path, end_id))
