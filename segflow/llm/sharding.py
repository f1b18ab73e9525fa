"""Shards by fixed virtual slots and a versioned slot-to-shard map; DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segflow.llm.common import stored

SLOTS = 4096
#: A text with more than this part of a shard's share of bytes or rows is split by id.
HEAVY = 0.5
PARTS = 64


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, home, own, turn): the slot of each document by its text, so equal texts share one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("home"),
        F.xxhash64(F.lit(3), text).alias("own"),
        F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(PARTS)).cast("int").alias("turn"),
    )


def hot_texts(rows: DataFrame, shards: int) -> DataFrame:
    """(home, own, number): texts that alone have over ``HEAVY`` of a shard's bytes or rows, at most ``4 * shards`` of them.

    Slots are summed first, so texts are told apart only in the few slots that are heavy.
    """
    sums = (F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    share = F.lit(HEAVY / shards)
    total = rows.agg((F.sum("size") * share).alias("most_bytes"), (F.count(F.lit(1)) * share).alias("most_rows"))  # one row
    heavy = lambda df: df.join(F.broadcast(total)).where("bytes > most_bytes or rows > most_rows").drop("bytes", "rows", "most_bytes", "most_rows")
    slots = heavy(rows.groupBy("home").agg(*sums))
    texts = heavy(rows.join(F.broadcast(slots), "home").groupBy("home", "own").agg(*sums))
    return texts.select("home", "own", F.row_number().over(Window.partitionBy("home").orderBy("own")).alias("number"))


def balanced(sizes: list[tuple[int, int, int]], shards: int) -> dict[tuple[int, int], int]:
    """Slot-to-shard map: the largest slot first, each into the shard that holds least."""
    load, out = [0] * shards, {}
    for home, part, size in sorted(sizes, key=lambda s: (-s[2], s[0], s[1])):
        out[home, part] = shard = min(range(shards), key=lambda s: (load[s], s))
        load[shard] += size
    return out


def rebalanced(mapping: dict[tuple[int, int], int], sizes: list[tuple[int, int, int]], shards: int) -> dict[tuple[int, int], int]:
    """An edited map for ``shards`` shards: slots move only from shards above the mean into shards below it."""
    size = {(h, p): n for h, p, n in sizes}
    load = [0] * shards
    for slot, shard in mapping.items():
        load[shard] += size.get(slot, 0)
    goal, out = sum(load) / shards, dict(mapping)
    for slot in sorted(mapping, key=lambda s: (-size.get(s, 0), s)):
        home, own = mapping[slot], size.get(slot, 0)
        to = min(range(shards), key=lambda s: (load[s], s))
        if own and load[home] - own >= goal * 0.999 and load[to] + own <= goal * 1.001:
            out[slot], load[home], load[to] = to, load[home] - own, load[to] + own
    return out


def edited(old: dict[tuple[int, int], int], sizes: list[tuple[int, int, int]], shards: int) -> dict[tuple[int, int], int]:
    """The map after ``old`` for other sizes: known slots stay, new ones go where least is, then it is rebalanced."""
    out = {(h, p): old[h, p] for h, p, _ in sizes if old.get((h, p), shards) < shards}
    load = [0] * shards
    for h, p, n in sizes:
        if (h, p) in out:
            load[out[h, p]] += n
    for h, p, n in sorted((s for s in sizes if s[:2] not in out), key=lambda s: (-s[2], s[0], s[1])):
        out[h, p] = to = min(range(shards), key=lambda s: (load[s], s))
        load[to] += n
    return rebalanced(out, sizes, shards)


def map_table(spark, mapping: dict[tuple[int, int], int], version: int) -> DataFrame:
    """(version, home, part, shard), one row per slot."""
    rows = json.dumps([{"home": h, "part": p, "shard": s} for (h, p), s in sorted(mapping.items())])
    kind = "array<struct<home: int, part: int, shard: int>>"
    return spark.range(1).select(F.lit(version).alias("version"), F.explode(F.from_json(F.lit(rows), kind)).alias("s")).select("version", "s.*")


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, before: DataFrame | None = None) -> DataFrame:
    """Every document with its shard (bytes near equal) and its gapless place there.

    Documents hash into fixed slots by their text; bytes are summed by slot before any shuffle of rows, and the
    slot map (bounded: ``slots`` rows and ``PARTS`` for each hot text) is made from the sums and stored with its version.
    ``before`` is a stored map: its newest version is edited, so only slots that must move do, and stored as the next.
    A text that alone would fill half a shard, as one that a third of all rows share, has slots of its own by id; the
    other texts of its slot stay together. Null text counts one byte, like an empty one. Equal rows are kept apart only
    by their place. No rows give no rows.
    """
    spark = docs.sparkSession
    rows = stored(slotted(docs, slots), "slotted")
    hot = stored(hot_texts(rows, shards), "hot-texts")
    part = F.when(F.col("number").isNull(), -1).otherwise((F.col("number") - 1) * PARTS + F.col("turn"))
    rows = rows.join(F.broadcast(hot), ["home", "own"], "left").withColumn("part", part.cast("int"))
    sizes = stored(rows.groupBy("home", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "slots")
    known = [(r["home"], r["part"], r["bytes"]) for r in sizes.collect()]
    old, version = {}, 0
    if before is not None:
        version = before.agg(F.max("version")).first()[0] or 0
        old = {(r["home"], r["part"]): r["shard"] for r in before.where(F.col("version") == version).collect()}
    chosen = edited(old, known, shards) if old else balanced(known, shards)
    mapping = stored(map_table(spark, chosen, version + 1), "slot-map") if known else map_table(spark, {(0, -1): 0}, version + 1)
    upto = Window.partitionBy("shard").orderBy("home", "part").rowsBetween(Window.unboundedPreceding, -1)
    slots_of = sizes.join(mapping, ["home", "part"]).select("home", "part", "shard", "version", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"))
    place = Window.partitionBy("home", "part").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("inside", F.row_number().over(place) - 1).join(F.broadcast(slots_of), ["home", "part"])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("home").alias("virtual_slot"), F.col("part").alias("slot_part"), F.col("version").alias("map_version"),
    )


def map_of(sharded: DataFrame) -> DataFrame:
    """The stored map (version, home, part, shard) that a result of ``shard`` was made by."""
    return sharded.select(F.col("map_version").alias("version"), F.col("virtual_slot").alias("home"), F.col("slot_part").alias("part"), "shard").distinct()
