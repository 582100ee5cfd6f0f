import shutil
import subprocess

import pytest
from pyspark.sql import types as T

from tracelake.engine import Engine
from tracelake.sources import ingest, lake, recording

MAIN = """
public class Busy { static java.util.List<byte[]> held = new java.util.ArrayList<>();
  public static void main(String[] a) throws Exception {
  for (int i = 0; i < 25; i++) { Thread.sleep(12); byte[] b = new byte[1 << 20]; held.add(new byte[1 << 20]); }
  System.gc(); } }
"""


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    if not shutil.which("java") or not shutil.which("jfr"):
        pytest.skip("no java here")
    folder = tmp_path_factory.mktemp("recording")
    (folder / "Busy.java").write_text(MAIN)
    subprocess.run(["java", f"-XX:StartFlightRecording=filename={folder}/busy.jfr,settings=profile", str(folder / "Busy.java")], check=True, capture_output=True, timeout=120)
    return str(folder / "busy.jfr")


def test_counts_equal_the_summary(file):
    text = subprocess.run(["jfr", "summary", file], check=True, capture_output=True, text=True, timeout=120).stdout
    want = {p[0]: int(p[1]) for p in (line.split() for line in text.splitlines()) if len(p) == 3 and "." in p[0] and p[1].isdigit() and int(p[1])}
    readers = [recording.load(c) for c in recording.chunks(file)]
    got = {e: sum(1 for r in readers for _ in r.events(e)) for e in recording.event_types(file)}
    internal = ("jdk.Metadata", "jdk.CheckPoint")
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if k not in internal}


def test_source(spark, file):
    recording.register(spark)
    sleeps = spark.read.format("recording").option("event", "jdk.ThreadSleep").load(file)
    rows = sleeps.where("eventThread.javaName = 'main'").collect()
    assert sleeps.schema["time"].metadata["comment"].startswith("Sleep Time")
    assert "DataAmount BYTES" in spark.read.format("recording").option("event", "jdk.PhysicalMemory").load(file).schema["totalSize"].metadata["comment"]
    assert len(rows) >= 25 and all(0.01 < r["duration"] < 5 for r in rows)
    assert any(f["type"] == "java.lang.Thread" and f["name"] == "sleep" for f in rows[0]["stackTrace"]["frames"])
    with pytest.raises(Exception, match="no event type"):
        spark.read.format("recording").option("event", "jdk.Nothing").load(file).count()


def test_open_imports_a_file(spark, file, tmp_path):
    store = str(tmp_path / "stored")
    engine = Engine.ingest(spark, file, store, only=["OldObjectSample", "ThreadSleep"])
    objects = engine.tables["OldObject"]
    assert objects.count() == objects.select("_id").distinct().count() > 1 and engine.tables["OldObjectSample"].where("object = 0").count() == 0
    assert "byte[]" in {r["Object Class"] for r in engine.query("memory-leaks-by-class").collect()}
    first = lake.modified(spark, f"{store}/_manifest")
    again = Engine.open(spark, file, store)  # as it is current, nothing is imported again
    assert lake.modified(spark, f"{store}/_manifest") == first and again.tables["ThreadSleep"].count() >= 25
    assert [p.name for p in tmp_path.iterdir()] == ["stored"] and Engine.open(spark, store).query("recording").count() == 1


def test_import_and_views(spark, file, tmp_path):
    known = ingest.tables(spark, file)
    wanted = ["ThreadSleep", "GarbageCollection", "GCHeapSummary", "ExecutionSample", "JVMInformation", "GCPhasePause", "Class", "Method", "Thread"]
    out = f"file://{tmp_path}/stored"
    lake.write(spark, {n: known[n] for n in wanted}, out, file)
    assert lake.current(spark, out, file) and not lake.current(spark, out, file + "x")
    engine = Engine.open(spark, out)
    for name in ("Class", "Method", "Thread"):
        ids = engine.tables[name]
        assert ids.where("_id = 0").count() == 1 and ids.count() == ids.select("_id").distinct().count()
    methods = engine.query('SELECT m.name, c.javaName FROM ThreadSleep s JOIN Method m ON m._id = s."stackTrace$topMethod" JOIN Class c ON c._id = m.type').collect()
    assert ("sleep", "java.lang.Thread") in {tuple(r) for r in methods}
    collections = engine.query("gc")
    assert collections.count() == engine.tables["GarbageCollection"].count() > 0
    assert engine.query("jvm-information").first()["Name"].startswith("OpenJDK")
    assert engine.query("gc-pauses").first()["Number of Pauses"] > 0


LATER = """
public class Later {
  @jdk.jfr.Name("test.Marker") @jdk.jfr.Label("A Marker") static class Marker extends jdk.jfr.Event { int number; String word; }
  public static void main(String[] a) throws Exception {
    for (int i = 0; i < 7; i++) { Marker m = new Marker(); m.number = i; m.word = "w" + i; m.commit(); } } }
"""


@pytest.fixture(scope="module")
def rotated(file, tmp_path_factory):
    """A file of more chunks, whose first one neither holds nor describes test.Marker."""
    folder = tmp_path_factory.mktemp("rotated")
    (folder / "Later.java").write_text(LATER)
    subprocess.run(["java", f"-XX:StartFlightRecording=filename={folder}/later.jfr", str(folder / "Later.java")], check=True, capture_output=True, timeout=120)
    with open(folder / "all.jfr", "wb") as out:
        for part in (file, folder / "later.jfr"):
            with open(part, "rb") as f:
                shutil.copyfileobj(f, out)
    return str(folder / "all.jfr")


def test_events_of_later_chunks(spark, file, rotated):
    assert len(recording.chunks(rotated)) > len(recording.chunks(file))
    assert "test.Marker" not in recording.event_types(file) and recording.event_types(rotated)["test.Marker"] == "A Marker"
    recording.register(spark)
    marks = spark.read.format("recording").option("event", "test.Marker").load(rotated).orderBy("_seq").collect()
    assert [(r["number"], r["word"]) for r in marks] == [(i, f"w{i}") for i in range(7)]
    known = ingest.tables(spark, rotated)
    assert known["test.Marker"].count() == 7
    assert known["Events"].where("name = 'test.Marker'").first()["count"] == 7
    readers = [recording.load(c) for c in recording.chunks(rotated)]
    assert known["RecordingInfo"].first()["eventCount"] == sum(1 for r in readers for e in recording.event_types(rotated) for _ in r.events(e))


def test_active_settings_name_their_events(spark, file, rotated):
    known = ingest.tables(spark, file)
    numbers = {n: k.name.removeprefix("jdk.") for c in recording.chunks(file) for n, k in recording.load(c).kinds.items() if k.event}
    ids = {r["id"]: r["name"] for r in known["EventIDs"].collect()}
    assert ids == numbers and set(ids.values()) > set(ingest.table_name(n) for n in recording.event_types(file))
    engine = Engine(spark, {n: known[n] for n in ("ActiveSetting", "EventIDs")})
    named = {r["Event Type"]: r for r in engine.query("active-settings").collect()}
    assert None not in named and {"ThreadSleep", "GarbageCollection"} <= set(named)
    assert named["ExecutionSample"]["Period"] == "10 ms" and named["ThreadSleep"]["Period"] is None
    number = next(n for n, name in numbers.items() if name == "ThreadSleep")
    assert engine.query(f"SELECT EVENT_NAME_FOR_ID({number}) AS name").first()["name"] == "ThreadSleep"
    assert ingest.tables(spark, rotated)["EventIDs"].where("name = 'test.Marker'").count() == 1


def test_types_of_chunks_merge_by_name():
    a = T.StructType([T.StructField("x", T.IntegerType(), True, {"kind": "int"}), T.StructField("s", T.StructType([T.StructField("p", T.LongType())]))])
    b = T.StructType([T.StructField("y", T.StringType()), T.StructField("x", T.LongType(), True, {"kind": "long"}), T.StructField("s", T.StructType([T.StructField("q", T.LongType())]))])
    both = recording.union(a, b)
    assert both.simpleString() == "struct<x:bigint,s:struct<p:bigint,q:bigint>,y:string>"
    assert recording.fit((5,), b["s"].dataType, both["s"].dataType) == (None, 5)
    assert recording.fit(3, T.IntegerType(), T.DoubleType()) == 3.0 and recording.fit(3, T.IntegerType(), T.StringType()) == "3"
