"""Seeded draws without state: the same (seed, key) gives the same value on any executor.

``u = first 8 hex digits of md5(seed || ':' || key) / 2^32``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bits(seed: int | str, *keys: Column | str) -> Column:
    """Unsigned 32-bit integer for the key."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """Uniform double in [0, 1)."""
    return bits(seed, *keys) / F.lit(4294967296.0)


def between(low: float, high: float, seed: int | str, *keys: Column | str) -> Column:
    """Uniform double in [low, high)."""
    return F.lit(low) + uniform(seed, *keys) * F.lit(high - low)


def integer(n: Column | int, seed: int | str, *keys: Column | str) -> Column:
    """Uniform integer in [0, n)."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.floor(uniform(seed, *keys) * size)


def chance(p: float, seed: int | str, *keys: Column | str) -> Column:
    """True with probability ``p``."""
    return uniform(seed, *keys) < F.lit(p)


def choice(options: Sequence, seed: int | str, *keys: Column | str) -> Column:
    """One of ``options``, all equally likely."""
    values = F.array(*[F.lit(o) for o in options])
    return F.get(values, integer(len(options), seed, *keys).cast("int"))


def weighted(options: Sequence, weights: Sequence[float], seed: int | str, *keys: Column | str) -> Column:
    """One of ``options`` by weight: the first whose cumulative share exceeds the draw."""
    draw, upto, whole = uniform(seed, *keys), 0.0, float(sum(weights))
    pick = None
    for option, weight in zip(options[:-1], weights[:-1]):
        upto += weight / whole
        test = draw < F.lit(upto)
        pick = F.when(test, F.lit(option)) if pick is None else pick.when(test, F.lit(option))
    return F.lit(options[-1]) if pick is None else pick.otherwise(F.lit(options[-1]))
