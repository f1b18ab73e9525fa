"""Ordered analytics over keyed rows, safe when one key holds most of the data.

A plain ``Window.partitionBy(key).orderBy(time)`` puts one key into one task.
``ordered`` first counts the rows per key.  If every key is small, the plain
window is used (one shuffle).  Otherwise the rows are range-partitioned by
(keys, order), so that a hot key spreads over many blocks; each running value is
computed inside its block and completed by a carry from the earlier blocks.
Only keys that span blocks need a carry, and there are at most two such keys
per block, so the carry table is bounded by the number of partitions.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from segflow.session import group_limit, stable

BLOCK = "__block"
_FIRST = "__first"
_ENTER = "__enter"


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` of lag, lead, total, peak, last or number."""

    kind: str
    value: Column | None = None


def lag(value: Column | str) -> Running:
    """Value of the previous row."""
    return Running("lag", _col(value))


def lead(value: Column | str) -> Running:
    """Value of the next row."""
    return Running("lead", _col(value))


def total(value: Column | str) -> Running:
    """Sum of all rows up to this one."""
    return Running("total", _col(value))


def peak(value: Column | str) -> Running:
    """Maximum of all rows up to this one."""
    return Running("peak", _col(value))


def last(value: Column | str) -> Running:
    """Last non-null value up to this row."""
    return Running("last", _col(value))


def number() -> Running:
    """Position of the row, from 1."""
    return Running("number")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of the same names in which null matches null; Spark picks the form from the sizes."""
    right = right.select(*[F.col(c).alias(f"__on_{c}" if c in on else c) for c in right.columns])
    same = [left[c].eqNullSafe(right[f"__on_{c}"]) for c in on]
    return left.join(right, same, how).drop(*[f"__on_{c}" for c in on])


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


@dataclass(frozen=True)
class Ordered:
    """Rows with keys and a total order; ``spanning`` is set when blocks are in use."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool = False
    spanning: DataFrame | None = None

    @property
    def _parts(self) -> list[str]:
        return [*self.keys, BLOCK] if self.split else list(self.keys)

    def _window(self):
        return Window.partitionBy(*self._parts).orderBy(*self.order)

    def _frame(self):
        return self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def with_df(self, df: DataFrame) -> Ordered:
        """Same grouping over changed rows (projections and filters only)."""
        return replace(self, df=df)

    def columns(self, **exprs: Column) -> Ordered:
        return self.with_df(self.df.withColumns(exprs))

    def where(self, condition: Column) -> Ordered:
        return self.with_df(self.df.where(condition))

    def rows(self) -> DataFrame:
        """The rows without helper columns."""
        return self.df.drop(BLOCK)

    def _span_only(self) -> DataFrame:
        if not self.keys:
            return self.df
        return null_safe_join(self.df, self.spanning, self.keys, "left_semi")

    # -- running values ---------------------------------------------------

    def scan(self, **specs: Running) -> Ordered:
        """Add running values; each spec sees only columns that exist before the call."""
        local = {name: self._local(spec) for name, spec in specs.items()}
        if not self.split:
            return self.with_df(self.df.withColumns(local))
        at, rn, rev = Window.partitionBy(*self._parts), "__rn", "__rev"
        df = self.df.withColumns(
            {**local, rn: F.row_number().over(self._window()), rev: F.count(F.lit(1)).over(at)}
        )
        carry = self._carry(specs)
        join_on = self._parts
        df = null_safe_join(df, carry, join_on, "left")
        done = {name: self._complete(name, spec, rn, rev) for name, spec in specs.items()}
        kept = [c for c in self.df.columns if c not in specs]
        return self.with_df(df.select(*kept, *[c.alias(n) for n, c in done.items()]))

    def _local(self, spec: Running) -> Column:
        if spec.kind == "lag":
            return F.lag(spec.value).over(self._window())
        if spec.kind == "lead":
            return F.lead(spec.value).over(self._window())
        if spec.kind == "total":
            return F.sum(spec.value).over(self._frame())
        if spec.kind == "peak":
            return F.max(spec.value).over(self._frame())
        if spec.kind == "last":
            return F.last(spec.value, ignorenulls=True).over(self._frame())
        if spec.kind == "number":
            return F.row_number().over(self._window()).cast("long")
        raise ValueError(f"unknown running value {spec.kind!r}")

    def _carry(self, specs: dict[str, Running]) -> DataFrame:
        """One row per (spanning key, block): what the other blocks hand over."""
        place = F.struct(*self.order)
        aggregates = []
        for name, spec in specs.items():
            if spec.kind == "lag":
                agg = F.max_by(F.struct(spec.value.alias("v")), place)
            elif spec.kind == "lead":
                agg = F.min_by(F.struct(spec.value.alias("v")), place)
            elif spec.kind == "total":
                agg = F.sum(spec.value)
            elif spec.kind == "peak":
                agg = F.max(spec.value)
            elif spec.kind == "last":
                agg = F.max_by(spec.value, F.when(spec.value.isNotNull(), place))
            else:
                agg = F.count(F.lit(1))
            aggregates.append(agg.alias(f"__s_{name}"))
        summary = self._span_only().groupBy(*self._parts).agg(*aggregates)
        blocks = Window.partitionBy(*self.keys).orderBy(BLOCK)
        before = blocks.rowsBetween(Window.unboundedPreceding, -1)
        carries = []
        for name, spec in specs.items():
            value = F.col(f"__s_{name}")
            if spec.kind == "lag":
                value = F.lag(value).over(blocks)
            elif spec.kind == "lead":
                value = F.lead(value).over(blocks)
            elif spec.kind in ("total", "number"):
                value = F.sum(value).over(before)
            elif spec.kind == "peak":
                value = F.max(value).over(before)
            else:
                value = F.last(value, ignorenulls=True).over(before)
            carries.append(value.alias(f"__c_{name}"))
        return summary.select(*self._parts, *carries)

    def _complete(self, name: str, spec: Running, rn: str, rev: str) -> Column:
        here, carried = F.col(name), F.col(f"__c_{name}")
        if spec.kind == "lag":
            return F.when(F.col(rn) == 1, carried["v"]).otherwise(here)
        if spec.kind == "lead":
            return F.when(F.col(rn) == F.col(rev), carried["v"]).otherwise(here)
        if spec.kind == "total":
            return F.when(carried.isNull(), here).when(here.isNull(), carried).otherwise(here + carried)
        if spec.kind == "peak":
            return F.greatest(here, carried)
        if spec.kind == "last":
            return F.coalesce(here, carried)
        return here + F.coalesce(carried, F.lit(0))

    # -- order-dependent folds --------------------------------------------

    def fold(self, kernel: Kernel) -> Ordered:
        """Run an order-dependent rule row by row; see :class:`Kernel`.

        The window forces the clustering and the sort that the rule needs, and
        Spark reuses them if the rows are already laid out that way.
        """
        df = self.df.withColumn(_FIRST, F.row_number().over(self._window()) == 1)
        schema = ", ".join(
            [f"`{f.name}` {f.dataType.simpleString()}" for f in self.df.schema.fields]
            + [f"`{n}` {t}" for n, t in kernel.outputs.items()]
        )
        if self.split:
            df = null_safe_join(df, self._enter_states(kernel), self._parts, "left")
            # the join keeps the rows of a block together but not their order
            df = df.sortWithinPartitions(*self._parts, *self.order)
        else:
            df = df.withColumn(_ENTER, F.lit(None).cast("binary"))
        # only the first row of a block needs the state it is entered in
        df = df.select(*self.df.columns, _FIRST, F.when(F.col(_FIRST), F.col(_ENTER)).alias(_ENTER))
        types = {n: _arrow_type(t) for n, t in kernel.outputs.items()}
        return self.with_df(df.mapInArrow(_replay(kernel, types), schema))

    def _enter_states(self, kernel: Kernel) -> DataFrame:
        """State in which each later block of a spanning key is entered."""
        parts, order, keys = self._parts, list(self.order), list(self.keys)
        rows = self._span_only().select(*dict.fromkeys([*parts, *order, *kernel.inputs]))
        types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        head = ", ".join(f"`{c}` {types[c]}" for c in parts)

        def summarise(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by([(c, "ascending") for c in order])
            columns = {c: kernel.values(table.column(c)) for c in kernel.inputs}
            out = {c: pa.array([v.as_py()], table.schema.field(c).type) for c, v in zip(parts, key)}
            out["summary"] = pa.array([pickle.dumps(kernel.summary(columns))], pa.binary())
            return pa.table(out)

        def chain(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by(BLOCK)
            state, entered = kernel.start(), []
            for blob in table.column("summary").to_pylist():
                entered.append(pickle.dumps(state))
                state = kernel.follow(state, pickle.loads(blob))
            return table.drop_columns(["summary"]).append_column(_ENTER, pa.array(entered, pa.binary()))

        summaries = rows.groupBy(*parts).applyInArrow(summarise, f"{head}, summary binary")
        return summaries.groupBy(*keys).applyInArrow(chain, f"{head}, {_ENTER} binary")


class Kernel:
    """An order-dependent rule.

    ``run`` replays rows from a known state.  ``summary`` describes what a block
    does to *any* state it may be entered in, and ``follow`` applies that
    description; with these two a hot key is folded block by block in parallel.
    """

    inputs: tuple[str, ...] = ()
    outputs: dict[str, str] = {}

    def start(self) -> Any:
        raise NotImplementedError

    def values(self, column: pa.ChunkedArray | pa.Array) -> list:
        return column.to_pylist()

    def run(self, columns: dict[str, list], first: list[bool], enter: dict[int, Any], state: Any):
        """Return ({output: list}, state after the last row)."""
        raise NotImplementedError

    def summary(self, columns: dict[str, list]) -> Any:
        raise NotImplementedError

    def follow(self, state: Any, summary: Any) -> Any:
        raise NotImplementedError


def _arrow_type(ddl: str) -> pa.DataType:
    return to_arrow_type(StructType.fromDDL(f"v {ddl}")["v"].dataType)


def _replay(kernel: Kernel, types: dict[str, pa.DataType]):
    def replay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = kernel.start()
        for batch in batches:
            if not batch.num_rows:
                continue
            first = kernel.values(batch.column(batch.schema.get_field_index(_FIRST)))
            marks = batch.column(batch.schema.get_field_index(_ENTER))
            enter = {}
            if marks.null_count < len(marks):
                enter = {i: pickle.loads(marks[i].as_py()) for i, f in enumerate(first) if f and marks[i].is_valid}
            columns = {
                c: kernel.values(batch.column(batch.schema.get_field_index(c))) for c in kernel.inputs
            }
            outputs, state = kernel.run(columns, first, enter, state)
            keep = [i for i, n in enumerate(batch.schema.names) if n not in (_FIRST, _ENTER)]
            arrays = [batch.column(i) for i in keep]
            names = [batch.schema.names[i] for i in keep]
            for name, kind in types.items():
                arrays.append(pa.array(outputs[name], kind))
                names.append(name)
            yield pa.RecordBatch.from_arrays(arrays, names)

    return replay


def ordered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int | None = None
) -> Ordered:
    """Group ``df`` by ``keys`` (a null is a key like any other) in the total order ``order``.

    One aggregate over the key columns decides between the plain and the block form.
    """
    spark = df.sparkSession
    limit = group_limit(spark) if limit is None else limit
    keys, order = tuple(keys), tuple(order)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    size = counts.agg(F.max("n").alias("largest"), F.sum("n").alias("all")).first()
    if (size["largest"] or 0) <= limit:
        return Ordered(df, keys, order)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["all"] // limit))
    blocks = stable(
        df.repartitionByRange(parts, *keys, *order).withColumn(BLOCK, F.spark_partition_id())
    )
    spanning = None
    if keys:
        # a key that spans blocks is the first or the last key of each of them
        whole = F.struct(*keys)
        ends = blocks.groupBy(BLOCK).agg(F.min(whole).alias("a"), F.max(whole).alias("b"))
        spanning = (
            ends.select(BLOCK, F.explode(F.array_distinct(F.array("a", "b"))).alias("k"))
            .groupBy("k")
            .count()
            .where("count > 1")
            .select("k.*")
        )
        spanning = stable(spanning)
    return Ordered(blocks, keys, order, True, spanning)


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolated percentiles per group, as columns named by ``shares``.

    Equal values are counted before the shuffle; ranks come from a running count
    over the distinct values, so no group is gathered in one place.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    rows = ordered(counted, keys, [value]).scan(__upto=total("__n"))
    if not rows.split:
        # every group fits one window task and is already there
        joined = rows.df.withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    else:
        sizes = rows.df.groupBy(*keys).agg(F.sum("__n").alias("__all"))
        joined = null_safe_join(rows.df, sizes, keys) if keys else rows.df.crossJoin(F.broadcast(sizes))
    aggregates = []
    for name, share in shares.items():
        place = (F.col("__all") - 1) * F.lit(share)
        low = F.floor(place)
        # 0-based positions of a value are [upto - n, upto)
        at = lambda p: F.max(F.when((p >= F.col("__upto") - F.col("__n")) & (p < F.col("__upto")), F.col(value)))
        a, b = at(low), at(F.ceil(place))
        aggregates.append((a + (b - a) * F.max(place - low)).alias(name))
    return joined.groupBy(*keys).agg(*aggregates)


def head(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """First ``n`` rows per group; Spark cuts each group to ``n`` before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__at", F.row_number().over(window)).where(F.col("__at") <= n).drop("__at")
