"""Name an intermediate value within a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    A value used within a higher-order function is otherwise evaluated anew for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
