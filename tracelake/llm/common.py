"""What the operators of this subpackage share: tables in the shared folder, free names and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT = 10_000  # rows of a key beyond which it meets by broadcast; raised so that at most HOT_ROWS keys do
HOT_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or in local mode a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracelake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, so later steps neither recompute it nor carry its lineage.

    Results read such tables lazily, so the tables stay as long as the application and go when it ends in order.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracelake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(held)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores before it until no column has it; Spark compares names without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def meet(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows joined with ``table``, which has a row for each of their keys and in ``count`` how many rows have it.

    A key with very many rows would be one key of a join. Such keys are few, at most HOT_ROWS, whatever the input: these meet by
    broadcast, the others by a shuffled join. Rows with a null key are left out. Both sides are read twice.
    """
    most = max(HOT, (table.agg(F.sum(count)).first()[0] or 0) // HOT_ROWS)
    hot = table.where(F.col(count) > most)
    cold = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(table.where(F.col(count) <= most), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def with_leaders(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose key occurs twice or more, with ``lead``, the least value of their key."""
    lead = stage_table(rows.groupBy(key).agg(F.min(value).alias("lead"), F.count("*").alias("_rows")).where("_rows > 1"), "leads")
    return meet(rows, lead, [key], "_rows").drop("_rows")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(a, b)`` with the smallest node it reaches: columns ``node, label``.

    Alternates large-star and small-star steps. Each is one partial aggregation and one join on the node, so a node with
    very many neighbours is an ordinary skewed join. Nulls and self links are ignored; an empty input gives no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stage_table(pairs, "links")
    mark = _digest(pairs)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), "m").where("x <> m")
        small = small.unionByName(least.select(F.col("u").alias("x"), "m"))
        pairs = stage_table(small.select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v")).distinct(), "links")
        before, mark = mark, _digest(pairs)
        if mark == before:
            break
    else:
        raise RuntimeError("connected components did not settle")
    heads = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(heads.select(F.col("v").alias("node"), F.col("v").alias("label")))


def _digest(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
