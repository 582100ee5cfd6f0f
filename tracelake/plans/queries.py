"""Queries over the generic test tables: every view, the macros, and the relational operators, each with oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import tracelake.plans.application
import tracelake.plans.environment
import tracelake.plans.jvm  # noqa: F401  (these three register their views)
from tracelake.functions import formatting as fmt
from tracelake.functions import stats
from tracelake.operators import relate
from tracelake.plans import oracle
from tracelake.plans.spec import VIEWS
from tracelake.sources import shapes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(q: Query) -> Query:
        QUERIES[name] = q
        ORACLE_SQL[name] = sql
        return q

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = VIEWS[name].frame(shapes.ShapedTables(spark, sf_dir))
        if name == "deprecated-methods-for-removal":  # lists compare as text
            out = out.withColumn("Called from Class", F.array_join("Called from Class", "; "))
        return out

    return run


for _name in VIEWS:
    QUERIES[f"v_{_name.replace('-', '_')}"] = _view_query(_name)
    ORACLE_SQL[f"v_{_name.replace('-', '_')}"] = oracle.with_tables(oracle.SQL[_name])


# ---- macros -------------------------------------------------------------------------------------------------------------------


@query("m_percentiles", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.999) AS p999, round(median(value), 6) AS mid FROM events GROUP BY event_type")
def percentiles(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), stats.p90("value").alias("p90"), stats.p95("value").alias("p95"), stats.p99("value").alias("p99"), stats.p999("value").alias("p999"), F.round(F.median("value"), 6).alias("mid"))


@query("m_percentile_cont", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.9), 6) AS p90 FROM lineitem GROUP BY l_returnflag")
def percentile_cont(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(stats.continuous("l_quantity", 0.9), 6).alias("p90"))


@query("m_normalized", "SELECT event_id, round(value / nullif(max(value) OVER (), 0), 9) AS share FROM events")
def normalized(spark, sf_dir):
    """The largest value joins as a table of one row: no window over all rows."""
    rows = _table(spark, sf_dir, "events")
    top = rows.agg(F.max("value").alias("top"))
    return rows.crossJoin(F.broadcast(top)).select("event_id", F.round(F.try_divide("value", F.nullif("top", F.lit(0.0))), 9).alias("share"))


@query("m_diff", "SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders")
def diff(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") - F.lag("o_orderkey").over(w)).alias("gap"))


@query("m_count_unique", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def count_unique(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(stats.count_unique("user_id").alias("users"))


@query("m_format_decimals", f"SELECT event_id, {oracle.fixed('value')} AS two, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS none FROM events")
def format_decimals(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", fmt.format_decimals(F.col("value")).alias("two"), fmt.format_decimals(F.col("value"), 0).alias("none"))


@query("m_format_percentage", f"SELECT event_id, {oracle.pct('value / 1e3')} AS share FROM events")
def format_percentage(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", fmt.format_percentage(F.col("value") / 1e3).alias("share"))


@query("m_format_memory", f"SELECT event_id, k, {oracle.mem('(value * (10 ** k) - event_id)')} AS size FROM events, (VALUES (0), (3), (6), (9), (12)) t(k)")
def format_memory(spark, sf_dir):
    powers = F.explode(F.array(*(F.lit(k) for k in (0, 3, 6, 9, 12))))
    return _table(spark, sf_dir, "events").select("event_id", "value", powers.alias("k")).select("event_id", "k", fmt.format_memory(F.col("value") * F.pow(F.lit(10.0), "k") - F.col("event_id")).alias("size"))


@query("m_format_duration", f"SELECT event_id, k, {oracle.dur('(value / (10 ** k) - 1e-3)')} AS took FROM events, (VALUES (-9), (0), (3), (6), (9)) t(k)")
def format_duration(spark, sf_dir):
    powers = F.explode(F.array(*(F.lit(k) for k in (-9, 0, 3, 6, 9))))
    return _table(spark, sf_dir, "events").select("event_id", "value", powers.alias("k")).select("event_id", "k", fmt.format_duration(F.col("value") / F.pow(F.lit(10.0), "k") - 1e-3).alias("took"))


def _human(ns: str) -> str:
    """Nested cases for the oracle, largest unit first."""
    units = [("d", 86400 * 10**9), ("h", 3600 * 10**9), ("m", 60 * 10**9), ("s", 10**9), ("ms", 10**6), ("us", 10**3), ("ns", 1)]
    out = "'0s'"
    for i in range(len(units) - 1, -1, -1):
        own = f"(({ns} % {units[i - 1][1]}) // {units[i][1]})" if i else f"({ns} // {units[0][1]})"
        text = f"{own} || '{units[i][0]}'"
        if i + 1 < len(units):
            below = f"(({ns} % {units[i][1]}) // {units[i + 1][1]})"
            text += f" || CASE WHEN {below} > 0 THEN ' ' || {below} || '{units[i + 1][0]}' ELSE '' END"
        out = f"CASE WHEN {own} > 0 THEN {text} ELSE {out} END"
    return out


@query("m_format_human_duration", f"SELECT event_id, {_human('(event_id * event_id * 7919 * 1000)')} AS took FROM events")
def format_human_duration(spark, sf_dir):
    """Seconds as decimals: a bigint of nanoseconds ends at an event_id of 1,079,219, and a double is exact to 33,725."""
    number = F.col("event_id").cast("decimal(19, 0)")
    seconds = number * number * F.lit(7919) * F.lit(Decimal("0.000001"))
    rows = _table(spark, sf_dir, "events").select("event_id", seconds.alias("seconds"))
    return rows.select("event_id", fmt.format_human_duration(F.col("seconds")).alias("took"))


@query("m_format_hex", f"SELECT event_id, {oracle.hexa('(event_id * 31 - 5000)')} AS text FROM events")
def format_hex(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", fmt.format_hex(F.col("event_id") * 31 - 5000).alias("text"))


def _gc(spark, sf_dir):
    return shapes.frame(spark, sf_dir, "GarbageCollection"), _table(spark, sf_dir, "events").withColumnRenamed("ts", "at")


@query("m_before_gc", oracle.with_tables("SELECT e.event_id, coalesce((SELECT max_by(gcId, g.startTime) FROM GarbageCollection g WHERE g.startTime <= e.ts), -1) AS gc FROM events e"))
def before_gc(spark, sf_dir):
    marks, rows = _gc(spark, sf_dir)
    return relate.asof(rows, marks, "at", "startTime", "gcId", "gc", "event_id").select("event_id", F.coalesce("gc", F.lit(-1)).cast("long").alias("gc"))


@query("m_after_gc", oracle.with_tables("SELECT e.event_id, coalesce((SELECT min_by(gcId, g.startTime) FROM GarbageCollection g WHERE g.startTime > e.ts), -1) AS gc FROM events e"))
def after_gc(spark, sf_dir):
    marks, rows = _gc(spark, sf_dir)
    return relate.asof(rows, marks, "at", "startTime", "gcId", "gc", "event_id", forward=True).select("event_id", F.coalesce("gc", F.lit(-1)).cast("long").alias("gc"))


@query("m_duration_since_last_gc", oracle.with_tables("SELECT e.event_id, coalesce((epoch_us(e.ts) - epoch_us((SELECT max(startTime) FROM GarbageCollection g WHERE g.startTime <= e.ts))) / 1e6, -1.0) AS seconds FROM events e"))
def duration_since_last_gc(spark, sf_dir):
    marks, rows = _gc(spark, sf_dir)
    found = relate.asof(rows, marks.withColumn("when", F.col("startTime")), "at", "startTime", "when", "gc_time", "event_id")
    return found.select("event_id", F.coalesce(F.timestamp_diff("MICROSECOND", F.col("gc_time"), F.col("at")) / 1e6, F.lit(-1.0)).alias("seconds"))


@query("m_heap_around_gc", oracle.with_tables("""SELECT g.gcId, (SELECT min(heapUsed) FROM GCHeapSummary h WHERE h.gcId = g.gcId AND "when" = 'Before GC') AS before, (SELECT min(heapUsed) FROM GCHeapSummary h WHERE h.gcId = g.gcId AND "when" = 'After GC') AS after FROM GarbageCollection g"""))
def heap_around_gc(spark, sf_dir):
    heap = shapes.frame(spark, sf_dir, "GCHeapSummary").groupBy("gcId").agg(F.min(F.when(F.col("when") == "Before GC", F.col("heapUsed"))).alias("before"), F.min(F.when(F.col("when") == "After GC", F.col("heapUsed"))).alias("after"))
    return shapes.frame(spark, sf_dir, "GarbageCollection").select("gcId").join(heap, "gcId", "left")


@query("m_gc_type", oracle.with_tables("SELECT gcId, CASE WHEN gcId IN (SELECT gcId FROM YoungGarbageCollection) THEN 'Young' WHEN gcId IN (SELECT gcId FROM OldGarbageCollection) THEN 'Old' ELSE 'Unknown' END AS type FROM GarbageCollection"))
def gc_type(spark, sf_dir):
    young = shapes.frame(spark, sf_dir, "YoungGarbageCollection").select("gcId", F.lit("Young").alias("y")).distinct()
    old = shapes.frame(spark, sf_dir, "OldGarbageCollection").select("gcId", F.lit("Old").alias("o")).distinct()
    rows = shapes.frame(spark, sf_dir, "GarbageCollection").select("gcId").join(young, "gcId", "left").join(old, "gcId", "left")
    return rows.select("gcId", F.coalesce("y", "o", F.lit("Unknown")).alias("type"))


@query("m_event_type_label", oracle.with_tables("SELECT event_id, (SELECT label FROM EventLabels l WHERE l.name = event_type) AS label FROM events"))
def event_type_label(spark, sf_dir):
    labels = shapes.frame(spark, sf_dir, "EventLabels")
    rows = _table(spark, sf_dir, "events")
    return rows.join(labels, rows["event_type"] == labels["name"], "left").select("event_id", "label")


@query("m_event_name_for_id", oracle.with_tables("SELECT event_id, (SELECT min(name) FROM EventIDs i WHERE i.id = event_id) AS name FROM events"))
def event_name_for_id(spark, sf_dir):
    names = shapes.frame(spark, sf_dir, "EventIDs").groupBy(F.col("id").alias("event_id")).agg(F.min("name").alias("name"))
    return _table(spark, sf_dir, "events").select("event_id").join(names, "event_id", "left")


# ---- fallback of views ---------------------------------------------------------------------------------------------------------


@query("union_prune", oracle.with_tables(oracle.sel({"Class": "c.javaName", "Count": "count(*)"}, "(SELECT thrownClass AS x FROM JavaExceptionThrow) u JOIN Class c ON c._id = u.x GROUP BY u.x, c.javaName")))
def union_prune(spark, sf_dir):
    return VIEWS["exception-by-type"].frame(shapes.ShapedTables(spark, sf_dir, without=("JavaErrorThrow",)))


@query("view_alternative", oracle.with_tables(oracle.SQL["safepoints"].replace("LEFT JOIN SafepointCleanup k ON k.safepointId = b.safepointId", "").replace(oracle.dur("k.duration"), "CAST(NULL AS VARCHAR)")))
def view_alternative(spark, sf_dir):
    return VIEWS["safepoints"].frame(shapes.ShapedTables(spark, sf_dir, without=("SafepointCleanup",)))


# ---- relational operators ------------------------------------------------------------------------------------------------------


@query("proj_filter", "SELECT event_id, value * 2 AS twice, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS class, coalesce(nullif(event_type, 'error'), 'none') AS kind FROM events WHERE value > 10 AND event_type <> 'view'")
def proj_filter(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").where((F.col("value") > 10) & (F.col("event_type") != "view"))
    return rows.select("event_id", (F.col("value") * 2).alias("twice"), F.when(F.col("value") > 50, "high").otherwise("low").alias("class"), F.coalesce(F.nullif("event_type", F.lit("error")), F.lit("none")).alias("kind"))


@query("join_inner", "SELECT n_name, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_inner(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_OUTER = "SELECT l.user_id AS a, r.user_id AS b, l.n AS left_n, r.n AS right_n FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' AND user_id % 3 > 0 GROUP BY user_id) l {how} JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' AND user_id % 5 > 0 GROUP BY user_id) r ON l.user_id = r.user_id"


def _outer(how: str) -> Query:
    def run(spark, sf_dir):
        rows = _table(spark, sf_dir, "events")
        left = rows.where("event_type = 'signup' and user_id % 3 > 0").groupBy(F.col("user_id").alias("a")).agg(F.count("*").alias("left_n"))
        right = rows.where("event_type = 'purchase' and user_id % 5 > 0").groupBy(F.col("user_id").alias("b")).agg(F.count("*").alias("right_n"))
        return left.join(right, left["a"] == right["b"], how).select("a", "b", "left_n", "right_n")

    return run


for _how in ("left", "right", "full"):
    query(f"join_{_how}", _OUTER.format(how=_how.upper()))(_outer(_how))

for _how, _not in (("left_semi", ""), ("left_anti", "NOT ")):
    query(f"join_{_how}", f"SELECT c_custkey, c_name FROM customer WHERE {_not}EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")(
        lambda spark, sf_dir, how=_how: _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), how).select("c_custkey", "c_name")
    )


@query("cross_scalar_aggs", "SELECT * FROM (SELECT CAST(count(*) AS BIGINT) AS events_n, round(avg(value), 6) AS mean FROM events) a, (SELECT CAST(count(*) AS BIGINT) AS orders_n, max(o_totalprice) AS top FROM orders) b")
def cross_scalar_aggs(spark, sf_dir):
    return _table(spark, sf_dir, "events").agg(F.count("*").alias("events_n"), F.round(F.avg("value"), 6).alias("mean")).crossJoin(_table(spark, sf_dir, "orders").agg(F.count("*").alias("orders_n"), F.max("o_totalprice").alias("top")))


@query("share_top25", f"SELECT p_name, n, {oracle.pct('n / (SELECT count(*) FROM lineitem)')} AS share FROM (SELECT p_partkey, p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_name ORDER BY n DESC, p_partkey LIMIT 25)")
def share_top25(spark, sf_dir):
    """Counts are summed by key before parts are joined; the total is a table of one row."""
    rows = _table(spark, sf_dir, "lineitem")
    counts = rows.groupBy("l_partkey").agg(F.count("*").alias("n")).join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    top = relate.share_of_total(counts, rows, "n", F.count("*"), "s").orderBy(F.desc("n"), "p_partkey").limit(25)
    return top.select("p_name", "n", fmt.format_percentage(F.col("s")).alias("share"))


@query("scalar_subqueries", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS done, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open, (SELECT count(*) FROM events) AS events")
def scalar_subqueries(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    return orders.crossJoin(_table(spark, sf_dir, "events").agg(F.count("*").alias("events")))


@query("first_last", "SELECT user_id, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM events GROUP BY user_id")
def first_last(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("value", "event_id").alias("first_value"), F.max_by("value", "event_id").alias("last_value"))


@query("having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5")
def having(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 5")


@query("window_row_number", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def window_row_number(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _table(spark, sf_dir, "events").withColumn("place", F.row_number().over(w)).where("place = 1").select("user_id", "event_id", "event_type")


@query("window_agg_of_agg", "SELECT user_id, round(last_value / sum(last_value) OVER (), 9) AS share FROM (SELECT user_id, arg_max(value, event_id) AS last_value FROM events GROUP BY user_id)")
def window_agg_of_agg(spark, sf_dir):
    each = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("v"))
    return relate.share_of_total(each, each, "v", F.sum("v"), "s").select("user_id", F.round("s", 9).alias("share"))


@query("topk_nulls_last", "SELECT event_id, nullif(event_type, 'view') AS kind FROM events ORDER BY kind DESC NULLS LAST, event_id LIMIT 100")
def topk_nulls_last(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("kind")).orderBy(F.desc_nulls_last("kind"), "event_id").limit(100)


@query("list_distinct", "SELECT p_type, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands FROM part GROUP BY p_type")
def list_distinct(spark, sf_dir):
    return _table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


for _kind, _text in (("rollup", "ROLLUP (o_orderstatus, o_orderpriority)"), ("cube", "CUBE (o_orderstatus, o_orderpriority)")):
    query(f"group_{_kind}", f"SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY {_text}")(
        lambda spark, sf_dir, kind=_kind: getattr(_table(spark, sf_dir, "orders"), kind)("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    )

for _kind, _op in (("union", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT")):
    query(f"set_{_kind}", f"SELECT user_id FROM events WHERE event_type = 'signup' {_op} SELECT user_id FROM events WHERE event_type = 'error'")(
        lambda spark, sf_dir, kind=_kind: {"union": lambda a, b: a.union(b).distinct(), "intersect": lambda a, b: a.intersect(b), "except": lambda a, b: a.subtract(b)}[kind](*(_table(spark, sf_dir, "events").where(F.col("event_type") == e).select("user_id") for e in ("signup", "error")))
    )
