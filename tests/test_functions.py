from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tracelake.functions import formatting as fmt
from tracelake.functions import macros, stats
from tracelake.plans.queries import QUERIES
from tracelake.plans.spec import Tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


MEMORY = [(1023, "1023.00 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (1 << 20, "1.00 MB"), (-(1 << 30), "-1.00 GB"), (1 << 41, "2.00 TB"), (None, None)]
DURATION = [(0.0, "0s"), (0.999, "999.00ms"), (1.0, "1.00s"), (1.5, "1.50s"), (60.0, "60.00s"), (-1e-6, "-1.00us"), (2.5e-8, "25.00ns"), (float("inf"), None), (4e10, None), (None, None)]
HUMAN = [(0.999, "999ms"), (1.0, "1s"), (1.5, "1s 500ms"), (0.0, "0s"), (3600.0, "1h"), (90061.0, "1d 1h"), (-61.0, "-1m 1s"), (1e-9, "1ns"), (None, None)]


@pytest.mark.parametrize(("x", "text"), MEMORY)
def test_memory(spark, x, text):
    assert one(spark, fmt.format_memory(F.lit(x).cast("double"))) == text


@pytest.mark.parametrize(("x", "text"), DURATION)
def test_duration(spark, x, text):
    assert one(spark, fmt.format_duration(F.lit(x).cast("double"))) == text


@pytest.mark.parametrize(("x", "text"), HUMAN)
def test_human_duration(spark, x, text):
    assert one(spark, fmt.format_human_duration(F.lit(x).cast("double"))) == text


def test_human_duration_beyond_bigint(spark):
    macros.install(spark, Tables({}))
    for x, text in [(1e10, "115740d 17h"), (-1e22, "-115740740740740740d 17h"), (1e24, None), (float("inf"), None), (float("nan"), None)]:
        assert one(spark, fmt.format_human_duration(F.lit(x))) == text
        assert spark.sql(f"SELECT format_human_duration(double('{x}')) AS x").first()["x"] == text
    # as doubles these two are the same number
    assert one(spark, fmt.format_human_duration(F.lit(Decimal("863999999999.999999999")))) == "9999999d 23h"
    assert one(spark, fmt.format_human_duration(F.lit(Decimal("864000000000")))) == "10000000d"


def test_human_duration_of_large_ids(spark, tmp_path):
    ids = [0, 1, 33725, 33726, 60000, 1079219, 1079220, 5999999, 10**9]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    for i, took in QUERIES["m_format_human_duration"](spark, str(tmp_path)).collect():
        hours = i * i * 7919 // (3600 * 10**6)
        if hours >= 24:
            assert took == f"{hours // 24}d" + (f" {hours % 24}h" if hours % 24 else ""), i
        else:
            assert (i, took) in ((0, "0s"), (1, "7ms 919us"))


def test_decimals_percent_hex(spark):
    assert one(spark, fmt.format_decimals(F.lit(1023.9), 0)) == "1023"
    assert one(spark, fmt.format_decimals(F.lit(float("-inf")))) == "-inf"
    assert one(spark, fmt.format_percentage(F.lit(0.123456))) == "12.35%"
    assert [one(spark, fmt.format_hex(F.lit(i))) for i in (255, -255, 0)] == ["0xff", "-0xff".replace("-0x", "0x-"), "0x0"]


def test_quantiles_and_windows(spark):
    rows = spark.range(1, 11).withColumnRenamed("id", "x")
    got = rows.agg(stats.p90("x").alias("p"), stats.p999("x").alias("q")).first()
    assert (got["p"], got["q"]) == (9, 10)
    four = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "x double")
    assert [r[0] for r in four.select(stats.normalized(F.col("x"))).collect()] == [0.25, 0.5, 0.75, 1.0]
    gaps = spark.createDataFrame([(1,), (2,), (4,)], "x int")
    assert [r[0] for r in gaps.select("x", stats.diff(F.col("x")).alias("d")).orderBy("x").select("d").collect()] == [None, 1, 2]


def test_sql_macros_equal_columns(spark):
    installed = macros.install(spark, Tables({}))
    assert "format_memory" in installed and "before_gc" not in installed
    for name, cases in (("format_memory", MEMORY), ("format_duration", DURATION), ("format_human_duration", HUMAN)):
        for x, text in cases:
            arg = "CAST(NULL AS DOUBLE)" if x is None else f"double('{x}')"
            assert spark.sql(f"SELECT {name}({arg}) AS x").first()["x"] == text, (name, x)
    assert spark.sql("SELECT format_memory(1023, decimals => 0) AS x").first()["x"] == "1023 B"
    assert spark.sql("SELECT format_hex(-255) AS x").first()["x"] == "0x-ff"


def test_expansion(spark):
    assert macros.expand("SELECT p90(a) FROM t") == "SELECT percentile_disc(0.9) WITHIN GROUP (ORDER BY a) FROM t"
    assert macros.expand("SELECT 'P90(a)', format_memory(x, decimals := 1)") == "SELECT 'P90(a)', format_memory(x, decimals => 1)"
    assert macros.expand("COUNT_UNIQUE(coalesce(a, f(b)))") == "count(DISTINCT coalesce(a, f(b)))"
    spark.range(1, 11).createOrReplaceTempView("ten")
    assert spark.sql(macros.expand("SELECT P90(id) AS p, COUNT_UNIQUE(id % 3) AS n FROM ten")).first()[:] == (9, 3)
    with pytest.raises(ValueError):
        macros.expand("P90(a")


def test_gc_macros(spark):
    t0 = "timestamp_ntz'2024-01-01 00:00:0"
    gc = spark.sql(f"SELECT 1L AS gcId, {t0}1' AS startTime UNION ALL SELECT 2L, {t0}3'")
    heap = spark.sql("SELECT 1L AS gcId, 'Before GC' AS `when`, 10L AS heapUsed UNION ALL SELECT 1L, 'After GC', 4L")
    tables = {"GarbageCollection": gc, "GCHeapSummary": heap, "YoungGarbageCollection": gc.where("gcId = 1"), "OldGarbageCollection": gc.where("gcId = 5")}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    macros.install(spark, Tables(tables))
    row = spark.sql(f"SELECT before_gc({t0}2') AS a, after_gc({t0}2') AS b, before_gc({t0}0') AS c, after_gc({t0}3') AS d, duration_since_last_gc({t0}2') AS e, HEAP_BEFORE_GC(1) AS f, HEAP_AFTER_GC(1) AS g, GC_TYPE(1) AS h, GC_TYPE(9) AS i").first()
    assert row[:] == (1, 2, -1, -1, 1.0, 10, 4, "Young", "Unknown")
