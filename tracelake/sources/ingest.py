"""From a recording file to a stored recording: event tables with references by id, and the dictionaries they refer to.

Ids are hashes of what they stand for, so every event is encoded where it is read and no table of ids travels; 0 stands for
nothing. A dictionary is the distinct contents over all event tables, with the same hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.sources import lake, recording

DICTIONARIES = {"java.lang.Class": "Class", "java.lang.Thread": "Thread", "jdk.types.ClassLoader": "ClassLoader", "jdk.types.Module": "Module", "jdk.types.Method": "Method", "jdk.types.OldObject": "OldObject"}
SCHEMAS = {
    "Class": "_id long, javaName string, name string",
    "ClassLoader": "_id long, javaName string, name string",
    "Module": "_id long, name string",
    "Thread": "_id long, javaName string, osName string, javaThreadId long, virtual boolean",
    "Method": "_id long, type long, name string, descriptor string",
    "OldObject": "_id long, address long, type long, description string, arrayElements int",
}


def table_name(event: str) -> str:
    """Built-in events lose their prefix, others keep their full name."""
    return event.removeprefix("jdk.")


def identity(*content: Column) -> Column:
    """A positive id of some content; 0 if its first part is null."""
    return F.when(content[0].isNull(), F.lit(0).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64(*content), 2) + 1)


def _method(c: Column) -> list[Column]:
    return [c["name"], c["type"], c["descriptor"]]


def _contents(df: DataFrame) -> dict[str, list[DataFrame]]:
    """Rows for each dictionary that a raw event table holds."""
    out: dict[str, list[DataFrame]] = {}
    methods = []
    for f in df.schema.fields:
        kind, c = f.metadata.get("kind"), F.col(f"`{f.name}`")
        if kind in ("java.lang.Class", "jdk.types.ClassLoader"):
            out.setdefault(DICTIONARIES[kind], []).append(df.select(identity(c).alias("_id"), c.alias("javaName"), c.alias("name")))
        elif kind == "jdk.types.Module":
            out.setdefault("Module", []).append(df.select(identity(c).alias("_id"), c.alias("name")))
        elif kind == "java.lang.Thread":
            out.setdefault("Thread", []).append(df.select(_thread(c).alias("_id"), c["javaName"].alias("javaName"), c["osName"].alias("osName"), c["javaThreadId"].alias("javaThreadId"), c["osName"].isNull().alias("virtual")))
        elif kind == "jdk.types.OldObject":
            out.setdefault("OldObject", []).append(df.select(identity(*_object(c)).alias("_id"), c["address"].alias("address"), identity(c["type"]).alias("type"), c["description"].alias("description"), c["arrayElements"].alias("arrayElements")))
            out.setdefault("Class", []).append(df.select(identity(c["type"]).alias("_id"), c["type"].alias("javaName"), c["type"].alias("name")))
        elif kind == "jdk.types.Method":
            methods.append(df.select(c.alias("m")))
        elif kind == "jdk.types.StackTrace":
            methods.append(df.select(F.explode(c["frames"]).alias("f")).select(F.struct("f.type", "f.name", "f.descriptor").alias("m")))
    for m in methods:
        c = F.col("m")
        out.setdefault("Method", []).append(m.select(identity(*_method(c)).alias("_id"), identity(c["type"]).alias("type"), c["name"].alias("name"), c["descriptor"].alias("descriptor")))
        out.setdefault("Class", []).append(m.select(identity(c["type"]).alias("_id"), c["type"].alias("javaName"), c["type"].alias("name")))
    return out


def _object(c: Column) -> list[Column]:
    return [c["address"], c["type"], c["description"]]


def _thread(c: Column) -> Column:
    name = F.coalesce(c["javaName"], c["osName"])
    return identity(name, c["osName"], c["javaThreadId"])


def encode_events(df: DataFrame, depth: int = lake.FRAMES) -> DataFrame:
    """A raw event table with references replaced by ids, stacks by their six columns and small structs by their parts."""
    columns = []
    for f in df.schema.fields:
        kind, c = f.metadata.get("kind"), F.col(f"`{f.name}`")
        if kind in ("java.lang.Class", "jdk.types.ClassLoader", "jdk.types.Module"):
            c = identity(c)
        elif kind == "java.lang.Thread":
            c = F.coalesce(_thread(c), F.lit(0).cast("long"))
        elif kind == "jdk.types.OldObject":
            c = identity(*_object(c))
        elif kind == "jdk.types.Method":
            c = identity(*_method(c))
        elif kind == "jdk.types.StackTrace":
            frames = F.transform(c["frames"], lambda x: F.struct(identity(*_method(x)).alias("method"), x["name"].alias("name"), x["loader"].alias("loader"), x["java"].alias("java")))
            c = F.struct(c["truncated"].alias("truncated"), frames.alias("frames"))
        columns.append(c.alias(f.name, metadata={k: v for k, v in f.metadata.items() if v}))
    out = df.select(*columns)
    for f in df.schema.fields:
        if f.metadata.get("kind") == "jdk.types.StackTrace":
            out = lake.expand_stack(out, f.name, depth)
    return lake.flatten(out)


def tables(spark: SparkSession, path: str, depth: int = lake.FRAMES, only: Collection[str] | None = None, staging: str | None = None) -> dict[str, DataFrame]:
    """All tables of a recording file: events (of the types ``only``, if given), dictionaries and registers.

    With a folder for staging, each event type is decoded once and written there, and the tables read that; without, the file is
    decoded again by each action.
    """
    types = recording.described(spark, path)
    labels = {e: t.label for e, t in types.items() if t.seen and (only is None or table_name(e) in only)}
    raw = {}
    for e in labels:
        schema = recording.event_schema(types[e].fields)
        df = spark.read.format("recording").schema(schema).option("event", e).load(path)
        if staging:
            df.write.parquet(f"{staging}/{table_name(e)}")
            df = spark.read.schema(schema).parquet(f"{staging}/{table_name(e)}")
        raw[table_name(e)] = df
    events = {n: encode_events(df, depth) for n, df in raw.items()}
    held: dict[str, list[DataFrame]] = {}
    for df in raw.values():
        for name, rows in _contents(df).items():
            held.setdefault(name, []).extend(r.distinct() for r in rows)
    found = {}
    for name, schema in SCHEMAS.items():
        kind = T._parse_datatype_string(schema)
        nothing = spark.createDataFrame([(0, *[None] * (len(kind.fields) - 1))], kind)
        rows = reduce(DataFrame.unionByName, held.get(name, []), nothing)
        found[name] = rows.groupBy("_id").agg(*(F.max(c).alias(c) for c in kind.names[1:]))  # one row an id
    ids = [(table_name(e), number) for e, t in types.items() for number in t.ids]
    return events | found | lake.registers(events, {table_name(e): text for e, text in labels.items()}, ids)


def import_recording(spark: SparkSession, path: str, out: str, depth: int = lake.FRAMES, again: bool = False, only: Collection[str] | None = None) -> None:
    """Store a recording file as a folder of tables, unless that folder holds it as it is now."""
    if not again and lake.current(spark, out, path):
        return
    staging = f"{out}.staging-{uuid.uuid4().hex}"
    try:
        lake.write(spark, tables(spark, path, depth, only, staging), out, path, depth)
    finally:
        lake.drop(spark, staging)
