"""Repeated windows by anchors: what suffix buckets (bytes) and relative factors (words) share.

A window is ``window`` consecutive units of one document. Anchors are grams chosen by content alone, at least one in
every window and at the same place of equal windows, so two equal windows always share an anchor. Only grams that
occur twice go on, and only what stands around them is compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.common import NONE, anchors, chunks, doc_ends, rolling, signed, stored, text_buffers, texts

#: A gram with more anchors than this is compared by rows of single windows, in a plain aggregate.
HOT_ROWS = 100_000
#: Anchors in one bucket.
BUCKET_ROWS = 20_000
#: Splitters drawn from the places to compare; more buckets divide each range by hash.
SPLITTERS = 2_000
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Rule:
    """Units of a text, and what is a repeat: any other place, or only a document with a smaller id."""

    units: object  # (data, offsets) -> (hash of each unit, first unit of each document)
    gram: int
    window: int
    smaller: bool


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): ``key`` tells rows of one id apart; a null id is NO_ID here, after all others."""
    rows = texts(docs)
    return rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("key"), "text")


def packed_texts(docs: DataFrame) -> DataFrame:
    """``keyed`` with the text compressed, for a shuffle."""

    def squeeze(stream):
        for batch in stream:
            press = zstandard.ZstdCompressor(level=3)
            data = [press.compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(data, pa.binary())], names=["doc_id", "key", "packed"])

    return keyed(docs).mapInArrow(squeeze, "doc_id long, key long, packed binary")


def unpacked(column) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(v) for v in column.to_pylist()]


def _grams(rule: Rule, data: np.ndarray, at: np.ndarray):
    """Gram hashes, document ends and first units of a chunk."""
    hashes, first = rule.units(data, at)
    ends = doc_ends(first)
    grams = rolling(hashes, rule.gram)
    grams = np.concatenate([grams, np.full(len(ends) - len(grams), NONE, np.uint64)])
    grams[grams == NONE] -= np.uint64(1)
    grams[grams == 0] += np.uint64(1)
    grams[np.arange(len(ends)) + rule.gram > ends] = NONE
    return hashes, grams, ends, first


def anchor_table(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, key, grams, places): one row per document with anchors."""

    def choose(stream):
        for batch in stream:
            data, offsets = text_buffers(batch.column("text"))
            for low, high in chunks(offsets):
                _, grams, ends, first = _grams(rule, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                at = anchors(grams, ends, rule.gram, rule.window)
                cut = np.searchsorted(at, first)
                doc = np.searchsorted(first, at, "right") - 1
                columns = [batch.column(c).slice(low, high - low) for c in ("doc_id", "key")]
                own = pa.array(cut.astype(np.int32))
                columns.append(pa.ListArray.from_arrays(own, pa.array(signed(grams[at]))))
                columns.append(pa.ListArray.from_arrays(own, pa.array((at - first[doc]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "grams", "places"])

    rows = keyed(docs).mapInArrow(choose, "doc_id long, key long, grams array<long>, places array<int>")
    return rows.where(F.size("grams") > 0)


def _splitters(hits: DataFrame, buckets: int) -> np.ndarray:
    """Sampled quantiles of the grams of all places to compare."""
    if buckets < 2:
        return np.zeros(0, np.int64)
    parts = min(buckets, SPLITTERS)
    marks = [i / parts for i in range(1, parts)]
    found = hits.select(F.explode("hits.gram").alias("gram")).select(F.percentile_approx("gram", marks, F.lit(10_000)).alias("q")).first()["q"]
    return np.unique(np.array(found or [], np.int64))


def repeat_spans(docs: DataFrame, rule: Rule, surroundings, fields: str, compare, hot_rows: int = HOT_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, key, start, end) in units: spans whose every window is a repeat, possibly overlapping.

    ``surroundings(data, at, hashes, first, doc, place)`` gives the columns ``fields`` of anchors, and
    ``compare(table)`` the least and largest number of units before the anchor at which a window is a repeat
    (-1: none). Grams are counted with a combining aggregate. A bucket holds whole grams of about ``bucket_rows``
    anchors; a gram of more than ``hot_rows`` anchors is dealt by single windows instead, counted before they meet.
    """
    spark = docs.sparkSession
    table = stored(anchor_table(docs, rule), "anchors")
    both = table.select("doc_id", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    counts = stored(both.where("low < high" if rule.smaller else "n > 1").select("gram", "n"), "grams")
    size = counts.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > hot_rows).alias("hot")).first()
    window, gram = rule.window, rule.gram
    hits = table.select("doc_id", "key", F.explode(F.arrays_zip("grams", "places")).alias("a")).select("doc_id", "key", F.col("a.grams").alias("gram"), F.col("a.places").alias("place"))
    places = F.collect_set(F.struct("place", "gram", (F.col("n") > hot_rows).alias("hot")))
    hits = stored(hits.join(counts, "gram").groupBy("doc_id", "key").agg(places.alias("hits")), "hits")
    buckets = 1 + (size["rows"] or 0) // bucket_rows
    splitters = _splitters(hits, buckets)
    split = max(1, -(-buckets // SPLITTERS))

    def around(hot: bool):
        def emit(stream):
            for batch in stream:
                packed = batch.column("packed")
                sizes = [zstandard.frame_content_size(v) for v in packed.to_pylist()]
                offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                hits = batch.column("hits")
                cut = np.asarray(hits.offsets)
                inner = hits.values.flatten() if isinstance(hits.values, pa.StructArray) else hits.values
                place, found, is_hot = (c.to_numpy(zero_copy_only=False) for c in inner)
                ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key"))
                for low, high in chunks(offsets):
                    # a chunk at a time: texts of one line many times take a thousandth of their size in a batch
                    data = np.frombuffer(b"".join(unpacked(packed.slice(low, high - low))), np.uint8)
                    at = offsets[low : high + 1] - offsets[low]
                    hashes, first = rule.units(data, at)
                    span = slice(cut[low], cut[high])
                    doc = np.repeat(np.arange(high - low), np.diff(cut[low : high + 1]))
                    keep = is_hot[span].astype(bool) == hot
                    doc, own, gram_of = doc[keep], place[span][keep].astype(np.int64), found[span][keep]
                    if not len(doc):
                        continue
                    base = [ids[low:high][doc], keys[low:high][doc], own.astype(np.int32), gram_of]
                    if hot:
                        here = first[doc] + own
                        begin, stop = np.maximum(first[doc], here - (window - gram)), np.minimum(here, first[doc + 1] - window) + 1
                        good = begin < stop
                        edge = np.zeros(len(hashes) + 1, np.int64)
                        np.add.at(edge, begin[good], 1)
                        np.add.at(edge, stop[good], -1)
                        start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                        if not len(start):
                            continue
                        whole, doc = rolling(hashes, window)[start], np.searchsorted(first, start, "right") - 1
                        turn = np.lexsort((start, whole, doc))
                        whole, doc, start = whole[turn], doc[turn], start[turn]
                        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])]))
                        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(start)).astype(np.int32)), pa.array((start - first[doc]).astype(np.int32)))
                        columns = [pa.array(ids[low:high][doc[new]]), pa.array(keys[low:high][doc[new]]), pa.array(signed(whole[new])), lists]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "whole", "starts"])
                        continue
                    columns = [pa.array(c) for c in base]
                    bucket = np.searchsorted(splitters, gram_of, "right").astype(np.int64) * split + gram_of % split
                    columns += [pa.array(bucket), *surroundings(data, at, hashes, first, doc, own)]
                    names = ["doc_id", "key", "place", "gram", "bucket", *(f.split()[0] for f in fields.split(","))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        return emit

    def bucketed(table: pa.Table) -> pa.Table:
        least, most = compare(table)
        keep = most >= 0
        place = table.column("place").to_numpy()[keep].astype(np.int64)
        columns = [table.column(c).filter(pa.array(keep)) for c in ("doc_id", "key")]
        columns += [pa.array(place - most[keep]), pa.array(place + window - least[keep])]
        return pa.table(columns, names=["doc_id", "key", "start", "end"])

    spans = "doc_id long, key long, start long, end long"
    joined = packed_texts(docs).join(hits, ["doc_id", "key"])
    plain = joined.mapInArrow(around(False), "doc_id long, key long, place int, gram long, bucket long, " + fields)
    out = plain.groupBy("bucket").applyInArrow(bucketed, spans)
    if size["hot"]:
        # each window start once, equal windows of a document in one row
        single = joined.where(F.exists("hits", lambda h: h["hot"])).mapInArrow(around(True), "doc_id long, key long, whole long, starts array<int>")
        single = stored(single, "hot-windows")
        equal = single.groupBy("whole").agg(F.sum(F.size("starts")).alias("n"), F.min("doc_id").alias("low"))
        again = single.join(equal, "whole").where("low < doc_id" if rule.smaller else "n > 1").select("doc_id", "key", F.explode("starts").alias("start"))
        again = again.withColumn("start", F.col("start").cast("long"))
        out = out.unionByName(again.withColumn("end", F.col("start") + window))
    return stored(out, "spans")


def with_spans(docs: DataFrame, spans: DataFrame, finish, schema: str, columns: list[str] = ()) -> DataFrame:
    """``finish(raw, starts, ends)`` of every document with its merged spans; rows as in ``docs``, none left out."""
    merged = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = packed_texts(docs).join(merged, ["doc_id", "key"], "left")

    def close(stream):
        for batch in stream:
            raw = unpacked(batch.column("packed"))
            lists = batch.column("spans")
            if not isinstance(lists, pa.ListArray):
                lists = lists.cast(pa.list_(lists.type.value_type))
            cut = np.asarray(lists.offsets)
            starts, ends = (c.to_numpy(zero_copy_only=False) for c in lists.values.flatten())
            out = [finish(r, starts[a:b], ends[a:b]) for r, a, b in zip(raw, cut[:-1], cut[1:])]
            ids = [None if i == NO_ID else i for i in batch.column("doc_id").to_pylist()]
            arrays = [pa.array(ids, pa.int64()), *(pa.array(list(c)) for c in zip(*out))] if out else []
            if out:
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in schema.split(",")])

    return rows.mapInArrow(close, schema)
