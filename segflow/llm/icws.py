"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segflow.llm.common import mixed, rolling, signed, stored, text_buffers, texts, words, PLAIN
from segflow.llm.repeats import packed_texts, unpacked
from segflow.llm.shingles import SLOTS, lowered, pieces, rarity, similarity, weighted

BANDS, ROWS = 10, 3
SIMILAR = 0.8
#: Members of a bucket that is compared in full, and those of a tile of it that meet in one task.
FULL, TILE = 512, 256
_TABLE = 1 << 16


def _draws(seed: int = 20):
    """Fixed draws of the sampling: r and c from Gamma(2, 1), beta uniform; a shingle takes one row per sample."""
    made = np.random.Generator(np.random.PCG64(seed))
    r, c = made.gamma(2, 1, _TABLE).astype(np.float32), made.gamma(2, 1, _TABLE)
    return 1 / r, r, np.log(c).astype(np.float32) - r, made.random(_TABLE).astype(np.float32)


def samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, number: int, first: int = 0) -> np.ndarray:
    """``number`` consistent weighted samples of each document (0 where it has no shingle), from sample ``first`` on.

    For each sample the shingle with the least ln a = ln c - r (t - beta) - r wins, t = floor(ln w / r + beta); two
    documents agree on (shingle, t) with the probability of their weighted Jaccard similarity.
    """
    inverse, r, base, beta = _draws()
    out = np.zeros((docs, number), np.uint64)
    if not len(doc):
        return out
    new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.append(new, len(doc)))
    log = np.log(weight).astype(np.float32)
    for place, j in enumerate(range(first, first + number)):
        row = (shingle * np.uint64(0x9E3779B97F4A7C15 + 2 * j * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF | 1)) >> np.uint64(48)
        b = beta[row]
        t = np.floor(log * inverse[row] + b)
        value = base[row] - r[row] * (t - b)
        least = np.minimum.reduceat(value, new)
        hit = np.flatnonzero(value == np.repeat(least, size))
        own = doc[hit]
        one = np.concatenate([[True], own[1:] != own[:-1]])  # of equal values the least shingle
        hit = hit[one]
        out[doc[hit], place] = mixed(shingle[hit] * np.uint64(0x2545F4914F6CDD1D) + t[hit].astype(np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(j + 1))
    return out


def signatures(docs: DataFrame, rare: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, same_high, same_low, bands): a 128-bit hash of the words and a key per band; texts without words have none."""

    def sign(stream):
        for batch in stream:
            data, offsets = text_buffers(lowered(batch.column("text")))
            for low, high in pieces(offsets):
                own, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                doc, shingle, weight = weighted(own, at, rare)
                drawn = samples(doc, shingle, weight, high - low, bands * rows)
                keys = [rolling(np.append(drawn[:, k * rows : (k + 1) * rows].ravel(), np.uint64(k)), rows)[: (high - low) * rows : rows] + np.uint64(k) for k in range(bands)]
                _, _, first, hashes = words(own, at, PLAIN)
                place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
                some = np.flatnonzero(np.diff(first))
                same = []
                for turn in (1, 2):
                    each = mixed(hashes * np.uint64(2 * turn + 1) + (place * turn).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    same.append(np.add.reduceat(each, first[:-1][some]) if len(some) else np.zeros(0, np.uint64))
                table = np.stack(keys, axis=1)[some] if len(some) else np.zeros((0, bands), np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), pa.array(signed(np.ascontiguousarray(table)).ravel()))
                ids = batch.column("doc_id").slice(low, high - low).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(signed(s)) for s in same), lists], names=["doc_id", "same_high", "same_low", "bands"])

    return texts(docs).where("doc_id is not null").mapInArrow(sign, "doc_id long, same_high long, same_low long, bands array<long>")


def _buckets(keyed: DataFrame) -> DataFrame:
    """(key, doc_id, leader, n) of the buckets with two or more members, of those with the same members only one.

    The leader is the least id. Near copies meet under several keys, often all of them the same ones: their rows go on once.
    """
    members = [F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y")]
    size = keyed.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("n"), *members).where("n > 1")
    one = size.groupBy("leader", "n", "x", "y").agg(F.min("key").alias("key"))
    return keyed.join(one.select("key", "leader", "n").hint("merge"), "key")  # a large bucket is split where the rows are skewed


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, packed) of ``ids``: one text of each, dealt by id, as the ids grow with the documents."""
    held = packed_texts(docs).join(ids.hint("merge"), "doc_id", "left_semi")
    return held.groupBy("doc_id").agg(F.min("packed").alias("packed"))


def _links(docs: DataFrame, keyed: DataFrame, rare: np.ndarray, similar: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, leader, similarity) of links that join what the links between members of the buckets of ``keyed`` join.

    Beside them (doc_id, leader) that join the same and are mostly stars: the classes of the links that were found before
    the last ones, and the last ones. Classes are carried on and only joined anew where links were found.

    All members are compared with the leader of their bucket. A bucket that then holds members of several classes is
    compared in full, but pairs of one class, when it has at most ``FULL`` members or ``TILE`` outside of its commonest
    class. The members of the others meet again in a bucket for each of their rarest shingles (``_rarest``), of which
    two texts that are alike always share one; there those outside of the commonest class are compared with one of it,
    then every bucket that still holds several classes in full. So no link between members of a bucket is lost.
    """
    rows = stored(_buckets(keyed), "buckets")
    held = stored(_texts(docs, rows.select("doc_id").distinct()), "texts")
    links = stored(verified(held, rows.where("doc_id <> leader").select("doc_id", "leader").distinct(), rare, similar), "links")
    classes = _joined(links)
    rows = stored(_mixed(rows, classes), "buckets")
    whole = (F.col("n") <= FULL) | (F.col("n") - F.col("most") <= TILE)
    found = stored(_compared(rows.where(whole), held, rare, similar), "links")
    links = links.unionByName(found)
    rows = rows.where(~whole)
    if rows.isEmpty():
        return links, classes.unionByName(found.select("doc_id", "leader"))
    if not found.isEmpty():
        classes = _joined(classes, found)
    rows = stored(_mixed(_buckets(stored(_rarest(rows, held, rare, similar), "rarest")), classes), "buckets")
    led = rows.where((F.col("n") > FULL) & (F.col("class_id") != F.col("main")))
    led = led.select(F.greatest("doc_id", "leader").alias("doc_id"), F.least("doc_id", "leader").alias("leader")).distinct()
    if not led.isEmpty():
        found = stored(verified(held, led, rare, similar), "links")
        if not found.isEmpty():  # otherwise the buckets hold the same classes as before
            links, classes = links.unionByName(found), _joined(classes, found)
            rows = stored(_mixed(rows, classes), "buckets")
    found = stored(_compared(rows, held, rare, similar), "links")
    return links.unionByName(found), classes.unionByName(found.select("doc_id", "leader"))


def _joined(*links: DataFrame) -> DataFrame:
    """(doc_id, leader) of what ``links`` join: each member but the least id of its class under that one."""
    edges = [f.select(F.col("doc_id").alias("one"), F.col("leader").alias("two")) for f in links]
    return stored(components(reduce(DataFrame.unionByName, edges), "classes").withColumnRenamed("class_id", "leader"), "classes")


def _mixed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, doc_id, n, class_id, main, most, leader) of the buckets that hold several of ``classes`` (``_joined``).

    ``main`` is the class with the most members, ``leader`` one of them, another in each bucket.
    """
    classes = classes.select("doc_id", F.col("leader").alias("class_id"))
    rows = rows.select("key", "doc_id", "n").join(classes, "doc_id", "left").select("key", "doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id"))
    parts = rows.groupBy("key", "class_id").agg(F.count(F.lit(1)).alias("most"), F.min_by("doc_id", F.xxhash64("doc_id", "key")).alias("leader"))
    main = parts.groupBy("key").agg(F.max(F.struct("most", F.col("class_id").alias("main"), "leader")).alias("m"), F.count(F.lit(1)).alias("classes"))
    return rows.join(main.where("classes > 1").select("key", "m.*").hint("merge"), "key")


def _rarest(rows: DataFrame, held: DataFrame, rare: np.ndarray, similar: float) -> DataFrame:
    """(key, doc_id): the members of buckets under each of their rarest shingles; two that are alike share one.

    The shingles of all members have one order, by how many members hold those of a slot, then by hash. A text is
    under those from which on the order holds ``similar`` of its weight. What two alike texts have in common weighs that
    much of either, and none of it comes before the first shingle they share, so both are under that one.
    """
    members = held.join(rows.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").select("doc_id", "packed")
    members = stored(members, "members")  # read twice

    def shingled(batch):
        data, offsets = _lowered_texts(batch.column("packed"))
        for low, high in pieces(offsets):
            yield low, high, *weighted(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], rare)

    def count(stream):
        total = np.zeros(SLOTS, np.int64)
        for batch in stream:
            for _, _, _, shingle, _ in shingled(batch):
                total += np.bincount((shingle & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["slot", "n"])

    counted = members.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()

    def choose(stream):
        for batch in stream:
            for low, high, doc, shingle, weight in shingled(batch):
                turn = np.lexsort((shingle, often[(shingle & np.uint64(SLOTS - 1)).astype(np.int64)], doc))
                shingle, weight = shingle[turn], weight[turn]
                before = np.cumsum(weight) - weight
                before -= before[np.searchsorted(doc, doc)]
                total = np.bincount(doc, weight, minlength=high - low)[doc]
                under = np.flatnonzero(total - before >= total * (similar - 1e-6))
                ids = batch.column("doc_id").slice(low, high - low).take(pa.array(doc[under]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(signed(shingle[under]))], names=["doc_id", "key"])

    return members.mapInArrow(choose, "doc_id long, key long")


def _compared(rows: DataFrame, held: DataFrame, rare: np.ndarray, similar: float) -> DataFrame:
    """Links that join the classes of each bucket of ``rows`` (as ``_mixed`` gives them) whose members are alike.

    The members of a bucket are dealt into parts, and each two parts meet in a tile; there every member that is not of
    the commonest class is compared with all members of other classes at once, over arrays. Of the links found only
    those that join two classes of the tile go on, so rows grow with the members and not with the pairs. In a bucket of
    more than ``FULL`` members only the parts of those outside of its commonest class meet all parts.
    """
    share = lambda n: F.ceil(n / F.lit(TILE)).cast("int")
    place = lambda parts: F.pmod(F.xxhash64("doc_id"), parts).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    parts, seeking = share(F.col("n")), share(F.col("n") - F.col("most"))
    small, large = rows.where(F.col("n") <= FULL), rows.where(F.col("n") > FULL)
    small = small.withColumn("part", place(parts)).withColumn("other", each(parts))
    tiles = small.select("key", "doc_id", "class_id", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    sought = large.select("key", "doc_id", "class_id", F.lit(0).alias("part"), each(seeking).alias("low"), place(parts).alias("high"))
    seek = large.where("class_id <> main").select("key", "doc_id", "class_id", F.lit(1).alias("part"), place(seeking).alias("low"), each(parts).alias("high"))
    tiles = tiles.unionByName(sought).unionByName(seek)
    tiles = tiles.join(held.hint("merge"), "doc_id").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "doc_id")

    def compare(stream):
        tile, kept = None, []
        for batch in stream:
            at = np.stack([np.asarray(batch.column(c)) for c in ("key", "low", "high")])
            edges = [0, *(np.flatnonzero(np.any(at[:, 1:] != at[:, :-1], axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if tile != (own := tuple(at[:, low].tolist())):
                    yield _joined_classes(kept, rare, similar)
                    tile, kept = own, []
                kept.append(batch.slice(low, high - low))
        yield _joined_classes(kept, rare, similar)

    return tiles.select("key", "low", "high", "doc_id", "class_id", "part", "packed").mapInArrow(compare, "doc_id long, leader long, similarity double")


def _joined_classes(tile: list, rare: np.ndarray, similar: float) -> pa.RecordBatch:
    """Links that join the classes of a tile; members of one part meet in the tile of that part alone."""
    out = []
    if tile:
        ids, classes, part = (np.concatenate([np.asarray(b.column(c)) for b in tile]) for c in ("doc_id", "class_id", "part"))
        names, counts = np.unique(classes, return_counts=True)
        seeking = np.flatnonzero(classes != names[np.argmax(counts)])
        if len(seeking):
            data, offsets = _lowered_texts(pa.concat_arrays([b.column("packed") for b in tile]))
            made = [(low, weighted(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], rare)) for low, high in pieces(offsets)]
            doc, shingle, weight = (np.concatenate([m[k] + low if k == 0 else m[k] for low, m in made]) for k in range(3))
            total = np.bincount(doc, weight, minlength=len(ids))
            _, word, often = np.unique(shingle, return_inverse=True, return_counts=True)
            shared = often[word] > 1
            doc, word, weight = doc[shared], word[shared], weight[shared]
            edge, mine = np.searchsorted(doc, np.arange(len(ids) + 1)), np.zeros(len(often))
            several, into = bool((part != part[0]).any()), {}

            def root(name):
                while name in into:
                    name = into[name]
                return name

            for k in seeking.tolist():
                span = slice(edge[k], edge[k + 1])
                mine[word[span]] = weight[span]
                common = np.bincount(doc, np.minimum(weight, mine[word]), minlength=len(ids))
                mine[word[span]] = 0
                near = common / np.maximum(total[k] + total - common, 1e-300)
                found = (near >= similar) & (classes != classes[k])
                if several:
                    found &= part != part[k]
                for j in np.flatnonzero(found).tolist():
                    a, b = root(classes[k]), root(classes[j])
                    if a != b:
                        into[a] = b
                        out.append((max(ids[k], ids[j]), min(ids[k], ids[j]), near[j]))
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "leader", "similarity"])


def _lowered_texts(column):
    return text_buffers(lowered(pa.array([t.decode("utf-8", "surrogatepass") for t in unpacked(column)], pa.large_string())))


def verified(held: DataFrame, pairs: DataFrame, rare: np.ndarray, similar: float) -> DataFrame:
    """``pairs`` (doc_id, leader) whose whole texts, packed in ``held``, have a weighted Jaccard similarity of ``similar`` or more."""
    other = held.select(F.col("doc_id").alias("leader"), F.col("packed").alias("other"))
    both = pairs.join(other.hint("merge"), "leader").join(held.hint("merge"), "doc_id")  # few leaders: while the rows are narrow

    def compare(stream):
        for batch in stream:
            sides = [_lowered_texts(batch.column(name)) for name in ("packed", "other")]
            joint = sides[0][1] + sides[1][1]
            for low, high in pieces(joint):
                made = [weighted(d[o[low] : o[high]], o[low : high + 1] - o[low], rare) for d, o in sides]
                near = similarity(high - low, *made)
                columns = [batch.column(c).slice(low, high - low) for c in ("doc_id", "leader")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(near)], names=["doc_id", "leader", "similarity"])

    rows = both.select("doc_id", "leader", "packed", "other").mapInArrow(compare, "doc_id long, leader long, similarity double")
    return rows.where(F.col("similarity") >= similar)


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """(doc_id, class_id): the least id of each connected component of ``edges`` (one, two), other than itself.

    ``edges`` are read several times and may repeat. Each node hangs on the least of its smaller neighbours; its others
    are joined with that one, of equal such edges one stays. A node without larger neighbours then takes the class of
    what it hangs on. So what goes through the rounds of stars are the few nodes that others hang on, not the members of
    a group or the links of each.
    """
    edges = edges.select(F.greatest("one", "two").alias("one"), F.least("one", "two").alias("two")).where("one <> two")
    hung = edges.withColumn("m", F.min("two").over(Window.partitionBy("one")))
    across = hung.where("two <> m").select(F.col("two").alias("one"), F.col("m").alias("two"))
    ends = edges.select("one", "two", F.lit(False).alias("held")).unionByName(edges.select(F.col("two").alias("one"), F.lit(None).cast("long").alias("two"), F.lit(True).alias("held")))
    nodes = ends.groupBy("one").agg(F.min("two").alias("two"), F.max("held").alias("held")).where("two is not null")
    core = _stars(stored(across.unionByName(nodes.where("held").select("one", "two")).distinct(), label), label)
    leaves = nodes.where("not held").select("one", "two").join(core.withColumnRenamed("doc_id", "two"), "two", "left")
    return core.unionByName(leaves.select(F.col("one").alias("doc_id"), F.coalesce("class_id", "two").alias("class_id")))


def _stars(edges: DataFrame, label: str) -> DataFrame:
    """(doc_id, class_id) of distinct ``edges`` (one > two), by alternating stars.

    Every round is written to the shared folder; minima combine before the shuffle, so a node with very many links
    is no group in one task.
    """
    while not _flat(edges):
        both = edges.union(edges.select("two", "one"))
        least = both.groupBy("one").agg(F.min("two").alias("m")).select("one", F.least("one", "m").alias("m"))
        large = both.join(least, "one").where("two > one").select(F.col("two").alias("one"), F.col("m").alias("two")).where("one <> two")
        least = large.groupBy("one").agg(F.min("two").alias("m"))
        small = large.join(least, "one").select(F.explode(F.array(F.struct("one", F.col("m").alias("two")), F.struct(F.col("two").alias("one"), F.col("m").alias("two")))).alias("e"))
        edges = stored(small.select("e.*").where("one <> two").distinct(), label)
    return edges.select(F.col("one").alias("doc_id"), F.col("two").alias("class_id"))


def _flat(edges: DataFrame) -> bool:
    """Whether distinct ``edges`` (one > two) are stars: no node has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("one").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("two", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.max(F.expr("up + down > 1 and up > 0"))).first()[0]


def near_classes(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, n_links): one row per document; a class is named by its least id.

    Texts of equal words are collapsed first. Members of a band bucket are compared with its leader; buckets with several
    classes are compared in full, large ones by what alike members always share (``_links``); no bucket is cut. A text
    without words (also null) is a class of its own, as is a null id, whose class is null; rows of one id are in one
    class; an empty table gives no rows.
    """
    rare = rarity(docs)
    signed_rows = stored(signatures(docs, rare, bands, rows), "signatures")
    same = signed_rows.groupBy("same_high", "same_low")
    singles = same.agg(F.min_by(F.struct("doc_id", "bands"), "doc_id").alias("one")).select("one.*")
    links, joined = _links(docs, singles.select("doc_id", F.explode("bands").alias("key")).distinct(), rare, similar)
    leaders = same.agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = signed_rows.join(stored(leaders, "leaders").hint("merge"), ["same_high", "same_low"])  # a large group of copies is split
    copies = stored(copies.where("doc_id <> leader").select("doc_id", "leader"), "copies")
    classes = components(joined.unionByName(copies).select(F.col("doc_id").alias("one"), F.col("leader").alias("two")))
    edges = links.select("doc_id", "leader").unionByName(copies).distinct()
    degree = edges.select(F.explode(F.array("doc_id", "leader")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_links"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = ids.join(classes, "doc_id", "left").join(degree, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with all columns, of each class only the document with the least id.

    Of rows that share an id one stays; rows without an id all stay.
    """
    classes = near_classes(docs, **settings)
    others = stored(classes.where("class_id <> doc_id").select(F.col("doc_id").alias("other_id")).distinct(), "copies")
    kept = docs.join(others, docs["doc_id"] == others["other_id"], "left_anti")
    repeated = classes.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
