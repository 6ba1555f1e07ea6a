"""Name an intermediate value inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often it is used.

    Without this, every use of a derived Column repeats its whole expression,
    and chains of such uses grow the plan exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
