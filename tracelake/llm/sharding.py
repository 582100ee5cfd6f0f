"""Sharding by size-tiered compaction.

A dataset is a folder of immutable Parquet shards, of manifests (tables that list the shards of a version) and of version files.
Appending writes the rows of an arrival as small shards and commits a manifest that lists them beside the old ones. Compaction puts
shards into tiers by size, cuts each tier's list into runs that fill a target file, writes each run as one file and commits a
manifest with these in place of the merged ones. Shards of at least half the target are left alone; one of more than twice the
target is cut. A version is committed by creating its file, which names its manifest and holds the schema; creation fails if
the file is there. Readers see whole versions only. Old shards stay for readers of old versions until :func:`vacuum`. Rows
are moved by DataFrame operations only, and lists of shards are tables: the driver sees folders, one for each arrival or merge.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tracelake.llm.common import free_name

SMALL = 8 << 20  # the least tier
FANOUT = 4  # sizes of one tier differ by less than this
TARGET = 64 << 20
ARRIVAL_ROWS = 20_000  # most rows of a shard of an arrival
MANIFEST = "shard string, rows long, bytes long, tier int"


class Conflict(RuntimeError):
    """Another writer took the version."""


def _path(spark: SparkSession, text: str):
    return spark._jvm.org.apache.hadoop.fs.Path(text)


def _fs(spark: SparkSession, root: str):
    return _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, in order; none for a new dataset."""
    fs, at = _fs(spark, root), _path(spark, f"{root}/versions")
    if not fs.exists(at):
        return []
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v"))


def _version(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{root}/versions/v{version:08d}", wholetext=True).first()[0])


def manifest(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The shards of a version: path below root, rows, bytes and tier."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifests/{_version(spark, root, version)['manifest']}")


def schema_of(spark: SparkSession, root: str, version: int) -> StructType:
    """The columns of a version: those of all its arrivals."""
    return StructType.fromJson(_version(spark, root, version)["schema"])


def _commit(spark: SparkSession, root: str, shards: DataFrame, version: int, schema: StructType) -> int:
    """Write the manifest, then create the version's file; of two writers of one version one raises Conflict and changes nothing.

    Creation is exclusive where the file system makes it so (HDFS does). Elsewhere the file is read again, so that a writer whose
    file was replaced learns it.
    """
    fs, name = _fs(spark, root), uuid.uuid4().hex
    shards.select("shard", "rows", "bytes", "tier").write.parquet(f"{root}/manifests/{name}")
    to = _path(spark, f"{root}/versions/v{version:08d}")
    try:
        out = fs.create(to, False)
        out.write(bytearray(json.dumps({"manifest": name, "schema": schema.jsonValue()}).encode()))
        out.close()
        mine = _version(spark, root, version)["manifest"] == name
    except Exception as error:
        if not fs.exists(to):
            raise
        mine, cause = False, error
    else:
        cause = None
    if not mine:
        fs.delete(_path(spark, f"{root}/manifests/{name}"), True)
        raise Conflict(f"version {version} of {root} was committed by another writer") from cause
    return version


def tier(size: Column) -> Column:
    """0 up to SMALL bytes, and one more for each factor of FANOUT."""
    return F.greatest(F.lit(0), F.ceil(F.log(size / float(SMALL)) / F.log(F.lit(float(FANOUT))))).cast("int")


def _file(df: DataFrame) -> Column:
    """The file of each row, also where a column is named like Spark's own."""
    return df.metadataColumn("_metadata")


def _listed(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """The files of a folder of shards, with rows and bytes; only file metadata and no column is read."""
    files = spark.read.parquet(f"{root}/{folder}")
    files = files.select(_file(files)["file_name"].alias("name"), _file(files)["file_size"].alias("bytes"))
    found = files.groupBy("name", "bytes").agg(F.count("*").alias("rows"))
    return found.select(F.concat(F.lit(f"{folder}/"), "name").alias("shard"), "rows", "bytes", tier(F.col("bytes")).alias("tier"))


def _joint(old: StructType, new: StructType) -> StructType:
    """The columns of both. Names are compared without case; a column keeps its first spelling and its type."""
    held = {f.name.lower(): f for f in old}
    fields = list(old)
    for f in new:
        known = held.get(f.name.lower())
        if known is None:
            fields.append(f)
        elif known.dataType != f.dataType:
            raise ValueError(f"column {f.name} is {known.dataType.simpleString()} in the dataset and {f.dataType.simpleString()} in the arrival")
    return StructType([StructField(f.name, f.dataType, True, f.metadata) for f in fields])


def append(df: DataFrame, root: str, most: int = ARRIVAL_ROWS) -> int:
    """Add the rows of df as shards of at most ``most`` rows; returns the new version.

    Any column names can be stored, and columns that older shards lack read as null in them; a column of another type than before
    raises ValueError. Nulls, repeated rows and texts of any length are kept as they are. An empty df adds no shard but commits a
    version. Two writers of one version: one raises Conflict, and its rows can be appended again.
    """
    spark = df.sparkSession
    folder = f"arrivals/{uuid.uuid4().hex}"
    now = versions(spark, root)
    schema = _joint(schema_of(spark, root, now[-1]) if now else StructType([]), df.schema)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", most).parquet(f"{root}/{folder}")
    new = _listed(spark, root, folder).where("rows > 0")
    if now:
        new = manifest(spark, root, now[-1]).unionByName(new)
    return _commit(spark, root, new, (now[-1] if now else 0) + 1, schema)


def _rows(spark: SparkSession, root: str, shards: DataFrame, schema: StructType, mark: str) -> DataFrame:
    """The rows of ``shards(shard, ...)`` with the shard of each in the column ``mark`` and the other columns of shards.

    Folders that hold some of the shards are read; the list of shards is small beside the rows, and Spark broadcasts it only below
    its own size limit.
    """
    folder = F.regexp_extract("shard", "^(.*)/[^/]+$", 1)
    folders = [r[0] for r in shards.select(folder.alias("folder")).distinct().collect()]  # one for each arrival or merge
    parts = []
    for name in folders:
        one = spark.read.schema(schema).parquet(f"{root}/{name}")
        parts.append(one.withColumn(mark, F.concat(F.lit(f"{name}/"), _file(one)["file_name"])))
    held = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema).withColumn(mark, F.lit(""))
    return held.join(shards.withColumnRenamed("shard", mark), mark)


def read(spark: SparkSession, root: str, version: int | None = None, mark: str = "shard") -> DataFrame:
    """The rows of a version (the last), with the shard that holds each as the last column.

    That column is named ``mark``, with underscores before it where the dataset has a column of that name. A version without
    shards has no rows.
    """
    found = versions(spark, root)
    version = found[-1] if version is None else version
    schema = schema_of(spark, root, version)
    mark = free_name(mark, schema.names)
    return _rows(spark, root, manifest(spark, root, version).select("shard"), schema, mark).select(*(f"`{c}`" for c in schema.names), mark)


def runs(shards: DataFrame, target: int = TARGET) -> DataFrame:
    """shard, bytes, ``run`` and ``files`` for the shards to rewrite.

    Each tier's list, by size, is cut into runs where it fills the target; a run becomes one file, and runs of a single shard are
    left out. A shard of more than twice the target is a run of its own and becomes several files. The window is over the list of
    files of a tier, not over rows of data.
    """
    small = shards.where(F.col("bytes") < target / 2)
    order = Window.partitionBy("tier").orderBy("bytes", "shard").rowsBetween(Window.unboundedPreceding, -1)
    cut = small.withColumn("run", F.concat_ws("-", "tier", F.floor(F.coalesce(F.sum("bytes").over(order), F.lit(0)) / target)))
    many = cut.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run")
    large = shards.where(F.col("bytes") > 2 * target).select("shard", "bytes", "shard", F.ceil(F.col("bytes") / target).cast("long"))
    return cut.join(many, "run").select("shard", "bytes", "run", F.lit(1).cast("long").alias("files")).union(large)


def compact(spark: SparkSession, root: str, target: int = TARGET) -> int:
    """Merge similarly sized shards into files of about the target size; returns the version (the old one if nothing is to do)."""
    now = versions(spark, root)[-1]
    shards, schema = manifest(spark, root, now), schema_of(spark, root, now)
    plan = runs(shards, target)
    # the runs are numbered on the driver: one for each file that is written, so few beside the shards and a row of a few bytes
    files = plan.groupBy("run").agg(F.max("files").alias("files")).orderBy("run").toPandas()
    if files.empty:
        return now
    files["first"] = files["files"].cumsum() - files["files"]
    total = int(files["files"].sum())
    numbered = plan.select("shard", "run").join(spark.createDataFrame(files, "run string, files long, first long"), "run").drop("run")
    mark, count, first = (free_name(c, schema.names) for c in ("_shard", "_files", "_first"))
    old = _rows(spark, root, numbered.withColumnsRenamed({"files": count, "first": first}), schema, mark)
    # every run is one partition, so one task and one file; rows of a shard that is cut are dealt by their number in their task
    piece = F.when(F.col(count) > 1, F.pmod(F.monotonically_increasing_id(), F.col(count))).otherwise(0)
    moved = old.withColumn(mark, (F.col(first) + piece).cast("int")).repartitionById(total, F.col(mark))
    folder = f"merged/{uuid.uuid4().hex}"
    moved.select(*(f"`{c}`" for c in schema.names)).write.option("compression", "zstd").parquet(f"{root}/{folder}")
    kept = shards.join(plan.select("shard"), "shard", "left_anti")
    return _commit(spark, root, kept.unionByName(_listed(spark, root, folder).where("rows > 0")), now + 1, schema)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Drop all but the last ``keep`` versions and the shards that only they list; returns how many shards went.

    Folders without a live shard go whole. In other folders dead files are deleted one by one, as their names stream past the driver.
    """
    found = versions(spark, root)
    old, held = found[:-keep], found[-keep:]
    if not old:
        return 0
    listed = lambda vs: reduce(DataFrame.union, (manifest(spark, root, v).select("shard") for v in vs)).distinct()
    stays = listed(held)
    gone = listed(old).join(stays, "shard", "left_anti").withColumn("folder", F.regexp_extract("shard", "^(.*)/[^/]+$", 1))
    live = stays.select(F.regexp_extract("shard", "^(.*)/[^/]+$", 1).alias("folder")).distinct()
    counts = gone.groupBy("folder").agg(F.count("*").alias("n")).join(live.withColumn("live", F.lit(True)), "folder", "left").collect()
    fs = _fs(spark, root)
    for r in counts:
        if not r["live"]:
            fs.delete(_path(spark, f"{root}/{r['folder']}"), True)
    for r in gone.join(live, "folder").select("shard").toLocalIterator():  # only what merges left beside live files
        fs.delete(_path(spark, f"{root}/{r[0]}"), False)
    for v in old:
        name = _version(spark, root, v)["manifest"]
        fs.delete(_path(spark, f"{root}/versions/v{v:08d}"), False)
        fs.delete(_path(spark, f"{root}/manifests/{name}"), True)
    return sum(r["n"] for r in counts)


def shard_documents(docs: DataFrame, root: str, target: int = TARGET, arrivals: int = 3) -> DataFrame:
    """Store docs in the dataset at root and return doc_id with where each row now lies.

    The rows come as ``arrivals`` arrivals, dealt by a hash of doc_id (null ids come in one); the dataset is compacted after each.
    Columns: doc_id, shard (path below root), shard_tier, shard_rows, shard_bytes and version, a row for each row of docs. All
    columns are stored under their own names, whatever these are; nulls, repeated rows and texts of any length stay as they are.
    An empty table returns no rows. ``root`` is a new dataset.
    """
    spark = docs.sparkSession
    version = 0
    for k in range(arrivals):
        append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == k), root)
        version = compact(spark, root, target)
        vacuum(spark, root)
    schema = schema_of(spark, root, version)
    mark, rows, size, level = (free_name(c, schema.names) for c in ("_shard", "_rows", "_bytes", "_tier"))
    shards = manifest(spark, root, version).withColumnsRenamed({"rows": rows, "bytes": size, "tier": level})
    stored = _rows(spark, root, shards, schema, mark)
    return stored.select("doc_id", F.col(mark).alias("shard"), F.col(level).alias("shard_tier"), F.col(rows).alias("shard_rows"), F.col(size).alias("shard_bytes"), F.lit(version).alias("version"))
