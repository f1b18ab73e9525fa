"""Bind a computed value to a name inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A lambda of an array function evaluates its whole body per element, so values that
    do not depend on the element must be bound outside of it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
