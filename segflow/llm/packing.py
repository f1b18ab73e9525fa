"""Best-fit decreasing packing of token pieces into sequences of fixed length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segflow.llm.common import even_key, stored, texts
from segflow.llm.tokens import ARROW_BYTES, batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Words that a worker remembers here; what follows in a pipeline needs memory as well.
REMEMBERED = 150_000
#: Rows of one length that are ranked in one task.
RANK_ROWS = 500_000


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: the ids of a document and ``end_id``, cut into pieces of ``capacity`` if they are more.

    The remainder of a cut document is its first piece. A null or empty text is the end id alone. Rows that share a
    ``doc_id`` are separate documents; other columns are ignored.
    """

    def pieces(stream):
        for batch in stream:
            ids = batch.column("doc_id")
            for first, last, flat, at in batches(path, batch.column("text"), end_id, REMEMBERED):
                size = np.diff(at)
                head = np.where(size > capacity, size % capacity, size)
                head = np.where(head == 0, capacity, head)
                count = 1 + (size - head) // capacity
                doc = np.repeat(np.arange(last - first), count)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = np.where(number == 0, 0, head[doc] + (number - 1) * capacity)
                length = np.where(number == 0, head[doc], capacity)
                raw, begin = flat.astype("<u4").tobytes(), (at[doc] + start) * 4
                crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(begin.tolist(), (length * 4).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first).take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return texts(docs, ARROW_BYTES).mapInArrow(pieces, PIECES)


class Capacities:
    """Segment tree over remaining capacities: the number of open bins of each, and the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += bins
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """Smallest capacity of an open bin that is at least ``length``."""
        node = length + self.size
        if self.count[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[length]`` pieces, as runs (length, first rank, pieces, first bin, per bin, offset).

    Pieces of one length are alike and bins of one remaining capacity too, so a whole run of them is placed at once:
    a bin that was tightest stays so until the length no longer fits. The result is that of placing piece by piece.
    """
    tree, open_bins, runs, bins = Capacities(capacity), {}, [], 0

    def keep(left: int, first: int, number: int) -> None:
        if left and number:
            open_bins.setdefault(left, []).append((first, number))
            tree.add(left, number)

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, first = capacity, bins
                number = -(-todo // (capacity // length))
                bins += number
            else:
                first, number = open_bins[left].pop()
                tree.add(left, -number)
            each = left // length
            full = min(number, todo // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - left))
                keep(left - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            if full < number and todo:
                runs.append((length, rank, todo, first + full, todo, capacity - left))
                keep(left - todo * length, first + full, 1)
                full, todo = full + 1, 0
            keep(left, first + full, number - full)
    return runs


def ranked(pieces: DataFrame, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``pieces`` with ``rank``, gapless from 0 within each length; a common length is ranked in salted parts."""
    total = pieces.count()
    pieces = pieces.withColumn("salt", even_key(F.struct("doc_id", "piece"), 1 + total // rank_rows))
    part = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    sizes = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = pieces.withColumn("inside", F.row_number().over(part) - 1)
    return inside.join(sizes, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inside")).drop("salt", "before", "inside")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Every piece of ``docs`` with its sequence and its offset there, packed by best-fit decreasing.

    Only the counts by length (``capacity`` numbers) reach the driver, where the runs of the packing are made; the
    runs go out to the ranked pieces. An empty table gives no rows.
    """
    pieces = stored(token_pieces(docs, path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(best_fit(counts, capacity), np.int64).reshape(-1, 6)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    length, rank, _, first, each, offset = runs[order].T
    key = (length << 44) + rank

    def place(stream):
        for batch in stream:
            own, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = np.searchsorted(key, (own << 44) + at, "right") - 1
            inside = at - rank[run]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(first[run] + inside // each[run]), pa.array(offset[run] + inside % each[run] * own)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PACKED)
