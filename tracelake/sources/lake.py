"""A recording as a folder of Parquet tables, one for each event type and dictionary, and what an import derives.

The folder's manifest names the tables and the time of the file they came from, so a later open can tell whether to import again.
Folders can be in any store that Spark writes to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.plans.spec import Tables

FRAMES = 10
MANIFEST = "table string, rows long, source string, source_time long, frames int"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def modified(spark: SparkSession, path: str) -> int | None:
    """Milliseconds of a path's last change, or None if there is none."""
    fs, at = _fs(spark, path)
    return fs.getFileStatus(at).getModificationTime() if fs.exists(at) else None


def drop(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def flatten(df: DataFrame) -> DataFrame:
    """Structs of numbers only, or of one field, become columns ``field$part``; other structs stay."""
    out = []
    for f in df.schema.fields:
        parts = f.dataType.fields if isinstance(f.dataType, T.StructType) else []
        if parts and (len(parts) == 1 or all(isinstance(p.dataType, (T.NumericType, T.BooleanType)) for p in parts)):
            out += [F.col(f"`{f.name}`.`{p.name}`").alias(f"{f.name}${p.name}") for p in parts]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def expand_stack(df: DataFrame, column: str = "stackTrace", depth: int = FRAMES) -> DataFrame:
    """Six columns for a stack: frames ``array<struct<method, name, loader, java>>`` and ``truncated`` in a struct.

    Top method; top method of an application class (a Java frame whose class loader is known and not the bootstrap one); top
    method that is no constructor; length before the cut; whether it was cut; and the ids of the top ``depth`` methods, filled
    with 0. A null stack has 0 for methods and length.
    """
    frames = F.col(f"{column}.frames")
    pick = lambda test: F.coalesce(F.get(F.filter(frames, test), F.lit(0))["method"], F.lit(0).cast("long"))
    size = F.coalesce(F.when(frames.isNotNull(), F.size(frames)), F.lit(0))
    ids = F.slice(F.concat(F.coalesce(F.transform(frames, lambda f: f["method"].cast("long")), F.array().cast("array<bigint>")), F.array_repeat(F.lit(0).cast("long"), depth)), 1, depth)
    named = {
        "topMethod": pick(lambda f: F.lit(True)),
        "topApplicationMethod": pick(lambda f: f["java"] & f["loader"].isNotNull() & (f["loader"] != "bootstrap")),
        "topNonInitMethod": pick(lambda f: f["java"] & (f["name"] != "<init>")),
        "length": size.cast("short"),
        "truncated": F.coalesce(F.col(f"{column}.truncated"), F.lit(False)) | (size > depth),
        "methods": ids,
    }
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != column), *(c.alias(f"{column}${k}") for k, c in named.items()))


def dictionary(rows: DataFrame, content: list[str], staging: str) -> DataFrame:
    """Distinct contents with ``_id`` from 1, and row 0 with nulls.

    Ids are dense without a sort on one task: rows are dealt by content, numbered within their partition, and each partition's
    numbers start where those before it end.
    """
    spark = rows.sparkSession
    path = f"{staging}/{uuid.uuid4().hex}"
    rows.select(*content).distinct().withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    starts = dealt.groupBy("_part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("_part").orderBy(*content)
    numbered = dealt.withColumn("n", F.row_number().over(within)).join(starts.select("_part", "start"), "_part")
    named = numbered.select((F.col("start") + F.col("n")).cast("long").alias("_id"), *content)
    nothing = spark.range(1).select(F.lit(0).cast("long").alias("_id"), *(F.lit(None).cast(t).alias(c) for c, t in rows.select(*content).dtypes))
    return nothing.unionByName(named)


def encode(rows: DataFrame, content: list[str], names: DataFrame, out: str) -> DataFrame:
    """rows with ``out``, the dictionary's id of their content, in place of the content columns; 0 where all of it is null."""
    d = names.where("_id > 0").select(F.col("_id").alias("_code"), *(F.col(f"`{c}`").alias(f"_key_{c}") for c in content))
    same = [rows[f"`{c}`"].eqNullSafe(d[f"`_key_{c}`"]) for c in content]
    found = rows.join(d, same, "left")
    return found.select(*(rows[f"`{c}`"] for c in rows.columns if c not in content), F.coalesce("_code", F.lit(0).cast("long")).alias(out))


def registers(events: dict[str, DataFrame], labels: dict[str, str] | None = None, ids: list[tuple[str, int]] | None = None) -> dict[str, DataFrame]:
    """Events (counts), EventLabels, EventIDs and RecordingInfo of the event tables.

    ``ids`` are the type numbers of the recording, of types without events too; tables without a recording are numbered from 1.
    """
    spark = next(iter(events.values())).sparkSession if events else SparkSession.active()
    counts = None
    spans = None
    for name, df in events.items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("count"))
        counts = one if counts is None else counts.unionByName(one)
        time = df.agg(F.count("*").alias("n"), F.min("startTime").alias("a"), F.max("startTime").alias("b"), (F.sum("duration") if "duration" in df.columns else F.lit(None).cast("double")).alias("d"))
        spans = time if spans is None else spans.unionByName(time)
    if counts is None:
        counts = spark.createDataFrame([], "name string, count long")
        spans = spark.createDataFrame([], "n long, a timestamp_ntz, b timestamp_ntz, d double")
    reason = spark.range(1).select(F.lit(None).cast("string").alias("dumpReason"))
    if "Shutdown" in events:
        reason = events["Shutdown"].agg(F.max_by("reason", "startTime").alias("dumpReason"))
    info = spans.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("eventCount"), F.min("a").alias("firstEvent"), F.max("b").alias("lastEvent"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("eventDurationSeconds")).crossJoin(reason)
    known = [n for n in events]
    return {
        "Events": counts.where("count > 0").orderBy(F.desc("count"), "name"),
        "EventLabels": spark.createDataFrame([(n, (labels or {}).get(n, n)) for n in known], "name string, label string"),
        "EventIDs": spark.createDataFrame([(n, i) for i, n in enumerate(known, 1)] if ids is None else ids, "name string, id long"),
        "RecordingInfo": info,
    }


def write(spark: SparkSession, tables: dict[str, DataFrame], path: str, source: str = "", frames: int = FRAMES) -> None:
    """Store tables as Parquet; the manifest comes last, so a folder without one is not a recording."""
    drop(spark, path)
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    rows = [(name, spark.read.parquet(f"{path}/{name}").count(), source, modified(spark, source) if source else None, frames) for name in tables]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{path}/_manifest")


def read(spark: SparkSession, path: str) -> Tables:
    """The tables of a stored recording."""
    names = [r["table"] for r in spark.read.schema(MANIFEST).parquet(f"{path}/_manifest").select("table").collect()]
    return Tables({n: spark.read.parquet(f"{path}/{n}") for n in names})


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a recording."""
    return modified(spark, f"{path}/_manifest") is not None


def current(spark: SparkSession, path: str, source: str) -> bool:
    """Whether a folder holds an import of this file as it is now."""
    fs, at = _fs(spark, f"{path}/_manifest")
    if not fs.exists(at):
        return False
    row = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest").first()
    return row is not None and row["source"] == source and row["source_time"] == modified(spark, source)
