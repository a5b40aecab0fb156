"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often it stands there."""
    return F.transform(F.array(value), use)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, x: t + x)
