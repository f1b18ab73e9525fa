"""Joins whose physical form depends on a checked size, and joins on time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow.operators.ordered import last, ordered
from segflow.session import small_enough


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Broadcast ``small`` when its rows and bytes are within the limits, else an ordinary join.

    The ordinary join is a shuffle that adaptive execution splits at skewed keys; the hint keeps it one where the plan's
    own estimate of ``small``, the bytes of a compressed file, is far too low.
    """
    return big.join(F.broadcast(small) if small_enough(small) else small.hint("merge"), list(on), how)


def with_default(big: DataFrame, dimension: DataFrame, on: str, column: str, default: str) -> DataFrame:
    """Left join to a dimension; rows without a match get ``default``."""
    joined = join_small(big, dimension.select(on, column), [on], "left")
    return joined.withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    value: str,
    default: Column | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Last ``value`` of ``right`` at or before ``left.at``, per key.

    Both sides are merged into one ordered stream (right rows first at equal times) and
    the value is carried forward; nothing is paired, and a hot key runs in blocks.
    """
    keys = list(keys)
    names = [c for c in left.columns if c not in keys and c != at]
    row = F.struct(*names) if names else F.struct(F.lit(1).alias("__x"))
    second = F.col(tie) if tie else F.lit(0)
    a = left.select(*keys, at, F.lit(1).alias("__side"), second.cast("long").alias("__tie"), row.alias("__row"))
    empty = F.lit(None)
    b = right.select(*keys, at, F.lit(0).alias("__side"), F.lit(0).cast("long").alias("__tie"), F.col(value).alias("__value"))
    a = a.withColumn("__value", empty.cast(right.schema[value].dataType))
    b = b.withColumn("__row", empty.cast(a.schema["__row"].dataType))
    rows = ordered(a.unionByName(b), keys, [at, "__side", "__tie"]).scan(__found=last("__value"))
    found = F.col("__found") if default is None else F.coalesce(F.col("__found"), default)
    kept = rows.where(F.col("__side") == 1).rows()
    return kept.select(*keys, at, *[F.col("__row")[n].alias(n) for n in names], found.alias(value))
