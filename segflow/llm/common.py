"""Shared pieces: narrow inputs, scratch tables, and array kernels over Arrow text."""

from __future__ import annotations

import gc
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segflow.session import scratch_path, ship_package

#: Bytes of text that an array kernel works on at once; a longer document is taken alone.
CHUNK_BYTES = 1 << 19
#: Bytes of an Arrow batch.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Ship the package, and bound the bytes of a batch that a worker gets, as a text may have any length."""
    ship_package(spark)
    spark.conf.set(BATCH_CONF, str(batch_bytes))


def texts(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as an empty one; other columns are not read."""
    prepare(docs.sparkSession, batch_bytes)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def stored(df: DataFrame, label: str, rows_per_file: int = 0, codec: str = "zstd") -> DataFrame:
    """Write ``df`` below the cluster's shared folder and read it from there: cuts lineage, survives lost executors.

    ``rows_per_file`` bounds what a reader holds of rows of several megabytes (0: no bound). What was shuffled for
    the table is no longer needed; the collection of garbage lets Spark delete those files now.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, label)
    if _SCOPE:
        _SCOPE[-1].append(path)
    df.write.option("compression", codec).option("maxRecordsPerFile", rows_per_file).parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


_SCOPE: list[list[str]] = []


@contextmanager
def scratch_scope(paths: list[str]):
    """Collects in ``paths`` what ``stored`` writes inside."""
    _SCOPE.append(paths)
    try:
        yield paths
    finally:
        _SCOPE.pop()


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    context = spark.sparkContext
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Array kernels ---------------------------------------------------------------------------------------------------


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a text column, without a copy where Arrow allows it."""
    pa.default_memory_pool().release_unused()  # what the batch before took
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of documents of about ``limit`` bytes each."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def mixed(values: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value of each 64-bit value (multiply and shift)."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(31)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xA0761D6478BD642F)
    values ^= values >> np.uint64(29)
    return values


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every run of ``width`` values (length n - width + 1), by doubling."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    step, size, out, done = values.astype(np.uint64), 1, None, 0
    n = len(values) - width + 1
    while True:
        if width & size:
            part = step[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(_MULTIPLIER, size, 1 << 64)) + part
            done += size
        if done == width:
            return mixed(out)
        step = step[:-size] * np.uint64(pow(_MULTIPLIER, size, 1 << 64)) + step[size:]
        size *= 2


def sliding(values: np.ndarray, width: int, choose) -> np.ndarray:
    """``choose`` (np.minimum or np.maximum) over every ``width`` values (length n - width + 1), by doubling."""
    size, step = 1, values
    while size * 2 <= width:
        step = choose(step[:-size], step[size:])
        size *= 2
    extra = width - size
    return choose(step[: len(step) - extra], step[extra:]) if extra else step


def anchors(hashes: np.ndarray, ends: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions chosen by content alone, at least one in every run of ``window`` units inside a document.

    ``hashes`` are of the grams that start at each unit and ``ends`` the end of the unit's document. A gram is chosen
    when it is the smallest (ties all count) of the grams in some window, so equal windows choose equal places.
    """
    n, grams = len(ends), window - gram + 1
    if n < window:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    least = sliding(hashes, grams, np.minimum)[: n - window + 1].copy()
    least[at[: len(least)] + window > ends[: len(least)]] = 0
    padded = np.concatenate([np.zeros(grams - 1, np.uint64), least, np.zeros(grams - 1, np.uint64)])
    most = sliding(padded, grams, np.maximum)
    return np.flatnonzero((most == hashes[: len(most)]) & (most != 0))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Word bytes of the shingle stages: ASCII letters and digits, and every byte of other characters.
PLAIN = np.zeros(256, bool)
PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = PLAIN[128:] = True
_POWERS = np.array([pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64) for i in range(1 << 12)], np.uint64)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Runs of ``inside`` bytes within documents: starts, ends, first word of each document, 64-bit hashes."""
    n = len(data)
    flag = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = flag.copy()
    begins[1:] &= ~flag[:-1] | edge[1:n]
    starts = np.flatnonzero(begins)
    stops = flag.copy()
    stops[:-1] &= ~flag[1:] | edge[1:n]
    ends = np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return starts, ends, first, np.zeros(0, np.uint64)
    place = np.arange(n) - starts[np.maximum(np.cumsum(begins) - 1, 0)]
    weighted = (data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095] + (place >> 12).astype(np.uint64)
    weighted[~flag] = 0
    hashes = mixed(np.add.reduceat(weighted, starts) + (ends - starts).astype(np.uint64))
    return starts, ends, first, hashes


def doc_ends(first: np.ndarray) -> np.ndarray:
    """For each unit the end of its document, from the first units of all documents."""
    return np.repeat(first[1:], np.diff(first))


def runs_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as maximal runs."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], np.maximum.reduceat(reach, np.flatnonzero(new))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def even_key(column: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts))
