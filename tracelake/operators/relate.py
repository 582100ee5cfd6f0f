"""Joins that analysis views share: dictionaries of methods and classes, shares of a total, optional unions, as-of lookups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_ROWS = 1_000_000  # rows of one span of an as-of lookup
MOST_SPANS = 10_000


def sites(methods: DataFrame, classes: DataFrame, role: str = "", how: str = "inner", dot: str = ".") -> DataFrame:
    """Methods with their class: ``<role>site_id``, ``<role>site`` (class, method and descriptor) and ``<role>site_class``."""
    m, c = methods.alias("m"), classes.alias("c")
    text = F.concat("c.javaName", F.lit(dot), "m.name", "m.descriptor")
    return m.join(c, F.col("m.type") == F.col("c._id"), how).select(F.col("m._id").alias(f"{role}site_id"), text.alias(f"{role}site"), F.col("c.javaName").alias(f"{role}site_class"), F.col("m.name").alias(f"{role}site_method"), F.col("m.descriptor").alias(f"{role}site_descriptor"))


def with_site(df: DataFrame, tables, method: str, role: str = "", how: str = "inner", dot: str = ".") -> DataFrame:
    """df with the site that its column ``method`` refers to. Dictionaries are broadcast where Spark finds them small enough."""
    found = sites(tables["Method"], tables["Class"], role, how, dot)
    return df.join(found, F.col(f"`{method}`") == found[f"{role}site_id"], how)


def with_name(df: DataFrame, dictionary: DataFrame, key: str, name: str, how: str = "inner", column: str = "javaName") -> DataFrame:
    """df with ``name``, the dictionary's name for its column ``key``."""
    found = dictionary.select(F.col("_id").alias(f"{name}_id"), F.col(column).alias(name))
    return df.join(found, F.col(f"`{key}`") == found[f"{name}_id"], how)


def share_of_total(parts: DataFrame, rows: DataFrame, part: str, total: Column, share: str) -> DataFrame:
    """parts with ``share``, the column ``part`` over an aggregate of all rows, a table of one row."""
    return parts.crossJoin(F.broadcast(rows.agg(total.alias("_total")))).withColumn(share, F.try_divide(F.col(part).cast("double"), F.col("_total").cast("double"))).drop("_total")


def union_present(tables, branches: Iterable[tuple[str, dict[str, Column]]]) -> DataFrame | None:
    """The union of the branches whose table exists, each with the named columns; None if none exists."""
    out = None
    for name, columns in branches:
        if name in tables:
            one = tables[name].select(*(c.alias(k) for k, c in columns.items()))
            out = one if out is None else out.unionByName(one)
    return out


def asof(events: DataFrame, marks: DataFrame, at: str, mark_at: str, value: str, out: str, key: str, forward: bool = False) -> DataFrame:
    """events with ``out``, the ``value`` of the last mark at or before ``at`` (forward: of the first after it), else null.

    One sort in place of a join of every event with every mark. Time is cut into spans of about SPAN_ROWS rows, by quantiles, so busy
    times have short ones: within a span a window carries the mark along; the mark that reaches a span from others comes from a
    window over one row for each span. So a task holds a span and not all rows. Of marks at one time the largest value counts
    (forward: the smallest). ``key`` names a column that orders events of one time. Events without a time get null.
    """
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{c}` as timestamp_ntz))")
    names = events.columns
    left = events.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), micros(at).alias("t"), F.lit(None).cast(dict(marks.dtypes)[value]).alias("v"), F.lit(0 if forward else 1).alias("side"), F.col(f"`{key}`").cast("string").alias("k"))
    none = F.lit(None).cast(left.schema["row"].dataType)
    right = marks.where(F.col(f"`{mark_at}`").isNotNull()).select(none.alias("row"), micros(mark_at).alias("t"), F.col(f"`{value}`").alias("v"), F.lit(1 if forward else 0).alias("side"), F.lit(None).cast("string").alias("k"))
    both = _spans(left.unionByName(right))
    order = [F.col("t").desc(), F.col("side"), F.col("v").desc_nulls_last()] if forward else [F.col("t"), F.col("side"), F.col("v").asc_nulls_last()]
    within = Window.partitionBy("b").orderBy(*order, "k").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("near", F.last("v", ignorenulls=True).over(within))
    mark_row = F.col("row").isNull()
    edge = F.struct("t", "v")
    ends = both.where(mark_row & F.col("v").isNotNull()).groupBy("b").agg((F.min(edge) if forward else F.max(edge)).alias("end"))
    spans = both.select("b").distinct().join(ends, "b", "left")
    across = Window.orderBy(F.col("b").desc() if forward else F.col("b")).rowsBetween(Window.unboundedPreceding, -1)
    reach = spans.select("b", F.last("end.v", ignorenulls=True).over(across).alias("far"))
    reach = reach.withColumnRenamed("b", "far_b")
    return carried.where(~mark_row).join(reach, F.col("b") == F.col("far_b"), "left").select("row.*", F.when(F.col("t").isNotNull(), F.coalesce("near", "far")).alias(out))


def _spans(rows: DataFrame) -> DataFrame:
    """rows with ``b``, the span of their time ``t``; rows of one time share one."""
    k = min(MOST_SPANS, rows.count() // SPAN_ROWS + 1)
    # at most MOST_SPANS times come to the driver
    cuts = sorted(set(rows.approxQuantile("t", [i / k for i in range(1, k)], 1 / (4 * k)))) if k > 1 else []
    if not cuts:
        return rows.withColumn("b", F.lit(0.0))
    cut = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="t_", outputCol="b", handleInvalid="keep")
    return cut.transform(rows.withColumn("t_", F.coalesce(F.col("t").cast("double"), F.lit(0.0)))).drop("t_")
