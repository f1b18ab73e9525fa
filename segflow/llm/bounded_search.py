"""Exact search of the nearest vectors by inner product: columnar branch and bound over blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segflow.llm.common import partitions, prepare, stored

#: Vectors of a block of candidates and of a block of queries, and how many blocks of each meet in one task at most.
BLOCK, QUERIES = 4096, 512
MOST_BLOCKS, MOST_QUERIES = 64, 8
#: Dimensions that are added up before candidates are dropped.
STEP = 8
#: Share of pairs alive below which sums go on pair by pair instead of over whole columns.
SPARSE = 0.1
#: Whole numbers that a double holds exactly.
EXACT = 1 << 53
_LAYOUT = "block long, dims int, ids binary, columns binary"


def _blocks(vectors: DataFrame) -> DataFrame:
    """(block, dims, ids, columns): up to ``BLOCK`` vectors of one length, as whole numbers, dimension after dimension."""
    prepare(vectors.sparkSession)
    # components that fit neither a whole number of 64 bits nor a useful score are held at that bound
    whole = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * 256, F.lit(-9.0e18)), F.lit(9.0e18))))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))

    def lay(stream):
        number, held = TaskContext.get().partitionId() << 32, {}

        def block(dims):
            nonlocal number
            ids, values = (np.concatenate(side) for side in zip(*held.pop(dims)))
            number += 1
            return pa.RecordBatch.from_pydict({"block": [number], "dims": pa.array([dims], pa.int32()), "ids": [ids.tobytes()], "columns": [np.ascontiguousarray(values.T).tobytes()]})

        for batch in stream:
            lists, ids = batch.column("v"), batch.column("vec_id").to_numpy()
            at = np.asarray(lists.offsets)
            flat, size = np.asarray(lists.values), np.diff(at)
            for dims in np.unique(size).tolist():
                mine = np.flatnonzero(size == dims)
                values = flat[at[mine][:, None] + np.arange(dims)] if dims else np.zeros((len(mine), 0), np.int64)
                for low in range(0, len(mine), BLOCK):
                    held.setdefault(dims, []).append((ids[mine[low : low + BLOCK]], values[low : low + BLOCK]))
                    if sum(len(i) for i, _ in held[dims]) >= BLOCK:
                        yield block(dims)
        for dims in list(held):
            yield block(dims)

    return rows.mapInArrow(lay, _LAYOUT)


def _queries(blocks: DataFrame, every: int) -> DataFrame:
    """(block, dims, ids, columns, owners) of the vectors whose id ``every`` divides; owners are their places (block, row)."""

    def choose(stream):
        number, held = TaskContext.get().partitionId() << 32, {}

        def block(dims):
            nonlocal number
            ids, owners, values = (np.concatenate(side) for side in zip(*held.pop(dims)))
            for low in range(0, len(ids), QUERIES):
                number += 1
                cut = slice(low, low + QUERIES)
                yield pa.RecordBatch.from_pydict({"block": [number], "dims": pa.array([dims], pa.int32()), "ids": [ids[cut].tobytes()], "columns": [np.ascontiguousarray(values[cut].T).tobytes()], "owners": [owners[cut].tobytes()]})

        for batch in stream:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                mine = np.flatnonzero(ids % every == 0)
                if len(mine):
                    values = np.frombuffer(row["columns"], np.int64).reshape(row["dims"], len(ids)).T[mine]
                    owners = np.stack([np.full(len(mine), row["block"]), mine], axis=1).astype(np.int64)
                    held.setdefault(row["dims"], []).append((ids[mine], owners, values))
                    if sum(len(h[0]) for h in held[row["dims"]]) >= QUERIES:
                        yield from block(row["dims"])
        for dims in list(held):
            yield from block(dims)

    return blocks.mapInArrow(choose, _LAYOUT + ", owners binary")


class _Best:
    """The best ``top`` scores so far of some queries, ties to the smaller id."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        query, score, vec = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.id, vec)))
        turn = np.lexsort((vec, -score, query))
        query, score, vec = query[turn], score[turn], vec[turn]
        new = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(new, np.diff(np.append(new, len(query))))
        keep = rank < self.top
        self.query, self.score, self.id = query[keep], score[keep], vec[keep]
        full = rank == self.top - 1
        self.least[query[full]] = score[full]


def branch_and_bound(best: _Best, queries: np.ndarray, columns: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
    """Add to ``best`` the candidates (dims, rows) ``columns`` that can be among the best of ``queries`` (dims, rows).

    Scores are summed up by ``STEP`` dimensions at a time. What the other dimensions can add is at most the product
    of the lengths that both vectors have there; a pair whose sum and bound stay under the worst of the best is dropped,
    and the pairs left are put together before the next columns are read. ``own`` (query, row) pairs take no part.
    """
    dims = max(len(queries), len(columns))
    queries, columns = (np.concatenate([v, np.zeros((dims - len(v), v.shape[1]), v.dtype)]) for v in (queries, columns))
    reach = [float(np.abs(v.astype(np.float64)).max(initial=0)) for v in (queries, columns)]
    if reach[0] * reach[1] * max(dims, 1) >= EXACT:  # too large for doubles: whole numbers of any size, score held in 64 bits
        score = queries.astype(object).T @ columns.astype(object)
        score = np.clip(score, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64) if dims else np.zeros((queries.shape[1], columns.shape[1]), np.int64)
        alive = np.ones(score.shape, bool)
        alive[own[:, 0], own[:, 1]] = False
        q, c = np.nonzero(alive)
        best.add(q, score[q, c], ids[c])
        return
    queries, columns = queries.astype(np.float64), columns.astype(np.float64)
    left = [np.sqrt(np.concatenate([np.cumsum((v * v)[::-1], axis=0)[::-1], np.zeros((1, v.shape[1]))])) for v in (queries, columns)]
    left[0] *= 1 + 1e-12  # no rounding makes a bound too small
    score = np.zeros((queries.shape[1], columns.shape[1]))
    q = None
    for low in range(0, dims, STEP):
        high = min(low + STEP, dims)
        if q is None:  # over whole columns
            score += queries[low:high].T @ columns[low:high]
            bound = score + left[0][high][:, None] * left[1][high] + 0.5
            alive = bound >= best.least[:, None]
            if high < dims and np.count_nonzero(alive) < SPARSE * alive.size:
                q, c = np.nonzero(alive)
                score = score[q, c]
        else:  # over the pairs left
            score += np.einsum("ij,ij->j", queries[low:high, q], columns[low:high, c])
            keep = score + left[0][high][q] * left[1][high][c] + 0.5 >= best.least[q]
            q, c, score = q[keep], c[keep], score[keep]
    if q is None:
        q, c = np.nonzero(score >= best.least[:, None])
        score = score[q, c]
    if len(own):
        other = ~np.isin(q * len(ids) + c, own[:, 0] * len(ids) + own[:, 1])
        q, c, score = q[other], c[other], score[other]
    best.add(q, np.rint(score).astype(np.int64), ids[c])


def top_scores(vectors: DataFrame, every: int = 50, top: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id ``every`` divides its ``top`` best scores with other rows.

    The score is the inner product of floor(256 x), ties to the smaller id. Vectors that are null or hold a null or
    not finite component take no part, nor do rows without an id; of vectors of unlike length the shorter counts as
    filled up with 0. Rows that share an id are rows of their own: each is a query, and each a candidate of the others.
    Components beyond 9e18 / 256 and scores beyond 64 bits are held at that bound. An empty table gives no rows.

    Blocks of queries and of candidates meet in tiles of a bounded number of each; a tile reads its queries, then its
    candidates one after the other, so that the bounds of a query grow as it goes on.
    """
    spark = vectors.sparkSession
    blocks = stored(_blocks(vectors.select("vec_id", "embedding")), "vectors")
    asked = stored(_queries(blocks, every), "queries")
    shape = [f.agg(F.count(F.lit(1)).alias("n")).first()["n"] for f in (blocks, asked)]
    across = max(1, -(-shape[1] // MOST_QUERIES))
    down = max(-(-shape[0] // MOST_BLOCKS), min(shape[0], -(-2 * partitions(spark) // across)), 1)
    group = lambda name, parts: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    empty = F.lit(None).cast("binary")
    left = blocks.select("*", empty.alias("owners"), F.lit(1).alias("kind"), group("block", down).alias("down"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("across"))
    right = asked.select("*", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("down"), group("block", across).alias("across"))
    tiles = left.unionByName(right).repartition(down * across, "down", "across").sortWithinPartitions("down", "across", "kind", "block")

    def search(stream):
        tile, held = None, []

        def found():
            for ids, _, _, best in held:
                yield pa.RecordBatch.from_pydict({"query_block": np.full(len(best.id), _), "query": best.query, "query_id": ids[best.query], "vec_id": best.id, "score": best.score})

        for batch in stream:
            for row in batch.to_pylist():
                if (row["down"], row["across"]) != tile:
                    yield from found()
                    tile, held = (row["down"], row["across"]), []
                ids = np.frombuffer(row["ids"], np.int64)
                values = np.frombuffer(row["columns"], np.int64).reshape(row["dims"], len(ids))
                if row["kind"] == 0:
                    owners = np.frombuffer(row["owners"], np.int64).reshape(-1, 2)
                    held.append((ids, (values, owners), row["block"], _Best(len(ids), top)))
                    continue
                for _, (queries, owners), _, best in held:
                    mine = np.flatnonzero(owners[:, 0] == row["block"])
                    branch_and_bound(best, queries, values, ids, np.stack([mine, owners[mine, 1]], axis=1))
        yield from found()

    rows = tiles.mapInArrow(search, "query_block long, query long, query_id long, vec_id long, score long")
    each = Window.partitionBy("query_block", "query").orderBy(F.desc("score"), F.asc("vec_id"))
    return rows.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
