import pytest
from pyspark.sql import functions as F

from tracelake import engine, render
from tracelake.engine import Engine, UnknownName, distance, suggestions
from tracelake.functions.macros import MACROS
from tracelake.sources import lake, names
from tracelake.sources.shapes import ShapedTables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def recording(spark):
    shaped = ShapedTables(spark, SF)
    return Engine(spark, {n: shaped[n] for n in ("ExecutionSample", "Method", "Class", "Events", "EventLabels", "GCPhasePause", "EventIDs")})


def test_query_by_name_and_sql(recording):
    assert recording.query("HOT-methods").count() == recording.view("hot-methods").count()
    assert recording.query("events").columns == ["name", "count"]
    assert recording.query("SELECT format_duration(P90(duration)) AS p FROM GCPhasePause").first()["p"].endswith("s")
    with pytest.raises(UnknownName, match="hot-methods"):
        recording.query("hot-method")
    with pytest.raises(UnknownName):
        recording.query("gc")


def test_listing_and_context(recording):
    assert "hot-methods" in recording.names()["views"] and "gc" not in recording.names()["views"]
    text = recording.context()
    assert "format_memory" in text and "before_gc" not in text and "ExecutionSample" in text
    assert recording.macro_table().count() == 21
    assert recording.view_table().where("available").count() == len(recording.names()["views"])
    assert "Aggregate" in recording.view_plan("hot-methods")
    assert "hot-methods" in engine.views() and "P999" in engine.list_macros()


def test_views_and_registries_in_sql(recording):
    rows = recording.query('SELECT count(*) AS n FROM "hot-methods" h JOIN "gc-pauses" p ON 1 = 1')
    assert rows.first()["n"] == recording.view("hot-methods").count() * recording.view("gc-pauses").count()
    assert recording.query("SELECT P90(n) AS p FROM (SELECT 1 AS n) -- hot-methods").first()["p"] == 1
    assert recording.query("SELECT name FROM macros WHERE name = 'diff'").count() == 1 and recording.query("macros").count() == 21
    assert recording.query('SELECT category FROM "jfr$views" WHERE name = \'gc\'').count() == 1 and recording.query("jfr$views").count() == 83
    said = recording.query("SELECT macro_sql('P90') AS m, macro_sql('format_decimals') AS f, macro_sql('x') AS x, view_sql('hot-methods') AS v, view_sql('gc') AS g").first()
    assert said["m"] == MACROS["p90"].definition() and said["f"] == MACROS["format_decimals"].definition() and said["x"] is None and said["g"] is None
    assert "Aggregate" in said["v"]
    listed = {(r["name"], r["kind"]) for r in recording.query(" ").collect()}
    assert ("ExecutionSample", "table") in listed and ("hot-methods", "view") in listed and ("gc", "view") not in listed


def test_context_names_targets(spark):
    df = spark.range(1).select(F.col("id").alias("eventThread", metadata={"kind": "java.lang.Thread", "comment": "Event Thread"}), F.lit(1).alias("n"))
    text = Engine(spark, {"Noted": df}).context()
    assert "eventThread bigint  -- Event Thread, refers to Thread._id\n    n int\n" in text


def test_output(recording, tmp_path):
    out = tmp_path / "x.csv"
    recording.save("SELECT 'a,b' AS x, 1 AS y", str(out), csv=True)
    assert out.read_text() == "x,y\na\\,b,1\n"
    recording.save("SELECT id, 'l1\nl2' AS x FROM range(1000)", str(out), csv=True, limit=3, cell_width=4)
    assert out.read_text() == "id,x\n" + "".join(f"{i},l1\\nl\n" for i in range(3))
    assert recording.text("SELECT 'k' AS name, 12 AS n") == "name  n\n---- --\nk    12\n"


def test_suggestions():
    assert distance("kitten", "sitting") == 3
    assert suggestions("gx", ["gc", "gcc", "recording"]) == ["gc", "gcc"]


def test_render_widths():
    text = render.table(["id", "text"], [True, False], [["1", "x" * 200], ["22", "é"], ["3"]], 40)
    lines = text.splitlines()
    assert all(len(line) <= 40 for line in lines) and render.CUT in lines[2] and len(lines) == 5
    assert render.table(["a"], [False], []) == "a\n-\n"
    assert render.right_aligned([False, False], [["1.5%", "1.5 MB"], ["2kB", "x"]]) == [True, False]
    assert render.widths([5, 50, 50], [True, False, False], 47) == [5, 20, 20]
    assert render.widths([100, 100], [True, True], 41) == [20, 20]
    assert render.csv(["h,1"], [['say "x"\n', ""]]) == 'h,1\nsay ""x""\\n,\n'


def test_names():
    pairs = {"[I": "int[]", "[[Ljava/lang/String;": "java.lang.String[][]", "Lx/Y$Z;": "x.Y.Z", "java/util/Map": "java.util.Map", "I": "I", "": "", None: None, "[X": "[X"}
    assert {k: names.java_name(k) for k in pairs} == pairs
    pairs = {"(Ljava/lang/String;I)V": "(String, int)", "()V": "()", "([[J)I": "(long[][])", "nothing": "nothing", "(Q)V": "(Q)V", None: None}
    assert {k: names.simple_descriptor(k) for k in pairs} == pairs


def test_stack(spark):
    kind = "id int, stackTrace struct<truncated boolean, frames array<struct<method bigint, name string, loader string, java boolean>>>"
    frames = [(7, "<init>", None, True), (8, "run", "bootstrap", True), (9, "main", "app", True)]
    df = lake.expand_stack(spark.createDataFrame([(1, (False, frames)), (2, (True, [])), (3, None)], kind), depth=2)
    rows = {r["id"]: r for r in df.collect()}
    assert [rows[1][f"stackTrace${k}"] for k in ("topMethod", "topApplicationMethod", "topNonInitMethod", "length", "truncated", "methods")] == [7, 9, 8, 3, True, [7, 8]]
    assert [rows[2]["stackTrace$topMethod"], rows[2]["stackTrace$truncated"], rows[2]["stackTrace$methods"]] == [0, True, [0, 0]]
    assert [rows[3]["stackTrace$length"], rows[3]["stackTrace$truncated"]] == [0, False]


def test_dictionary_and_lake(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i % 50}" if i % 7 else None, i % 2) for i in range(500)], "id int, name string, kind int").repartition(5)
    found = lake.dictionary(rows, ["name", "kind"], f"file://{tmp_path}/staging")
    ids = sorted(r["_id"] for r in found.collect())
    assert ids == list(range(len(ids))) and len(ids) == rows.select("name", "kind").distinct().count() + 1
    coded = lake.encode(rows, ["name", "kind"], found, "ref")
    assert coded.count() == 500 and coded.where("ref = 0").count() == 0
    back = coded.join(found, coded["ref"] == found["_id"]).select("id", "name", "kind")
    assert back.exceptAll(rows).count() == 0
    flat = lake.flatten(spark.sql("SELECT struct(1 AS a, 2L AS b) AS s, struct('x' AS c) AS t, struct(1 AS d, 'y' AS e) AS u"))
    assert flat.columns == ["s$a", "s$b", "t$c", "u"]
    events = {"A": rows.select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("startTime"), F.lit(0.5).alias("duration"))}
    tables = events | lake.registers(events)
    lake.write(spark, tables, f"file://{tmp_path}/rec")
    again = Engine.open(spark, f"file://{tmp_path}/rec")
    info = again.tables["RecordingInfo"].first()
    assert (info["eventCount"], info["eventDurationSeconds"], info["dumpReason"]) == (500, 250.0, None)
    assert again.query("recording").count() == 1 and again.tables["Events"].first()[:] == ("A", 500)
