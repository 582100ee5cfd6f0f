import itertools
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracelake.operators import relate
from tracelake.operators.relate import union_present
from tracelake.plans.queries import ORACLE_SQL, QUERIES
from tracelake.plans.spec import VIEWS, Tables
from tracelake.sources.shapes import SHAPES, ShapedTables

SF = "/root/testdata/sf0.001"


def test_inventory():
    assert len(VIEWS) == 83
    assert set(QUERIES) == set(ORACLE_SQL)
    assert {v.category for v in VIEWS.values()} == {"application", "environment", "jvm"}
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_needs_are_shaped():
    for v in VIEWS.values():
        assert set(v.requires) | set(v.any_of) <= set(SHAPES), v.name


def _value(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6)
    return x.isoformat() if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", ["v_hot_methods", "v_gc_references", "v_thread_start", "v_active_settings", "v_allocation_by_class", "v_jvm_flags", "v_safepoints", "m_before_gc", "m_after_gc", "join_full", "union_prune", "view_alternative"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    want = sorted([tuple(map(_value, r)) for r in want.fetchall()], key=repr)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    rows = sorted([tuple(_value(r[got.columns.index(c)]) for c in columns) for r in got.collect()], key=repr)
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_union_of_what_is_there(spark):
    one = spark.createDataFrame([(1,)], "x int")
    names = ["A", "B", "C"]
    for n in range(4):
        for held in itertools.combinations(names, n):
            out = union_present(Tables({k: one for k in held}), [(k, {"tag": F.lit(k), "x": F.col("x")}) for k in names])
            assert (out is None) == (not held)
            if held:
                assert sorted(r["tag"] for r in out.collect()) == list(held)


def test_view_without_its_tables(spark):
    assert VIEWS["gc"].frame(Tables({})) is None
    assert VIEWS["jvm-flags"].choose(Tables({})) is None
    assert VIEWS["jvm-flags"].choose(ShapedTables(spark, SF, without=("IntFlag",))) is not None


def test_views_over_empty_tables(spark):
    class Empty(ShapedTables):
        def __getitem__(self, name):
            return super().__getitem__(name).limit(0)

    for v in VIEWS.values():
        v.frame(Empty(spark, SF)).schema  # noqa: B018  analysis alone
    assert VIEWS["gc-pauses"].frame(Empty(spark, SF)).count() == 1


@pytest.mark.parametrize("rows", [2, 7, 1_000_000])
def test_asof_spans_and_ties(spark, monkeypatch, rows):
    monkeypatch.setattr(relate, "SPAN_ROWS", rows)
    random.seed(rows)
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    # most times lie in one minute, and many are equal
    at = [t(random.choice([random.randint(0, 60), random.randint(0, 86400)])) for _ in range(60)] + [None, t(0)]
    when = [(random.randint(0, 9), t(random.choice([random.randint(0, 60), random.randint(0, 86400)]))) for _ in range(25)] + [(4, None), (None, t(30))]
    events = spark.createDataFrame(list(enumerate(at)), "id int, at timestamp_ntz").withColumn("b", F.lit("clash"))
    marks = spark.createDataFrame(when, "v int, t timestamp_ntz")
    found = [(v, x) for v, x in when if v is not None and x is not None]
    for forward in (False, True):
        got = relate.asof(events, marks, "at", "t", "v", "m", "id", forward=forward)
        assert got.columns == ["id", "at", "b", "m"]
        for r in got.collect():
            fit = [(x, v) for v, x in found if r["at"] is not None and (x > r["at"] if forward else x <= r["at"])]
            assert r["m"] == ((min(fit) if forward else max(fit))[1] if fit else None)
