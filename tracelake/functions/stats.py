"""Aggregates and window functions that Spark has no single name for."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SEQ = "_seq"  # ingest order of an event


def quantile(name: str, q: float) -> Column:
    """The discrete percentile of a column: the smallest value that q of the rows do not exceed."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{name}`)")


def p90(name: str) -> Column:
    return quantile(name, 0.9)


def p95(name: str) -> Column:
    return quantile(name, 0.95)


def p99(name: str) -> Column:
    return quantile(name, 0.99)


def p999(name: str) -> Column:
    return quantile(name, 0.999)


def continuous(name: str, q: float) -> Column:
    """The interpolated percentile."""
    return F.expr(f"percentile_cont({q}) WITHIN GROUP (ORDER BY `{name}`)")


def last(x: str | Column) -> Column:
    """The value of the event that was ingested last, null if it is null there."""
    return F.max_by(x, SEQ)


def first(x: str | Column) -> Column:
    return F.min_by(x, SEQ)


def count_unique(x: str | Column) -> Column:
    return F.count_distinct(x)


def normalized(x: Column) -> Column:
    """x over the largest x of the whole input, null where that is 0. A window over all rows: for large inputs join the maximum."""
    return F.try_divide(x, F.max(x).over(Window.partitionBy()))


def diff(x: Column) -> Column:
    """The gap to the next smaller value."""
    return x - F.lag(x).over(Window.orderBy(x.asc_nulls_last()))
