"""The engine: tables of a recording, views over them, and questions as view names or Spark SQL."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

import tracelake.plans.application
import tracelake.plans.environment
import tracelake.plans.jvm  # noqa: F401  (these three register their views)
from tracelake import render
from tracelake.functions import macros
from tracelake.plans.spec import VIEWS, Tables
from tracelake.sources import ingest, lake

MACRO_TABLE, VIEW_TABLE = "macros", "jfr$views"  # tables that every engine has


class UnknownName(ValueError):
    """No table or view of that name; the message suggests near ones."""


def distance(a: str, b: str) -> int:
    """Edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggestions(name: str, known: list[str], most: int = 3, count: int = 5) -> list[str]:
    """Up to ``count`` names within an edit distance of ``most``, nearest first."""
    near = [(distance(name.lower(), k.lower()), k) for k in known]
    return [k for d, k in sorted(near) if d <= most][:count]


class Engine:
    """Analysis of one recording: ``tables`` by name, as DataFrames."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]):
        self.spark = spark
        self.tables = tables if isinstance(tables, Tables) else Tables(tables)
        for name in self.tables:
            self.tables[name].createOrReplaceTempView(name)
        self.functions = macros.install(spark, self.tables)
        self._installed: set[str] = set()

    @classmethod
    def open(cls, spark: SparkSession, path: str, store: str | None = None) -> Engine:
        """The recording stored in a folder, or a recording file, which is imported to ``store`` (by default beside it) if need be."""
        if lake.stored(spark, path):
            return cls(spark, lake.read(spark, path))
        return cls.ingest(spark, path, store or f"{path}.tables")

    @classmethod
    def ingest(cls, spark: SparkSession, file: str, store: str, **options) -> Engine:
        """Import a recording file to a folder, unless that holds it as it is now; options as of :func:`ingest.import_recording`."""
        ingest.import_recording(spark, file, store, **options)
        return cls(spark, lake.read(spark, store))

    def view(self, name: str) -> DataFrame:
        """A view by name, without regard to case."""
        found = {k.lower(): v for k, v in VIEWS.items()}.get(name.lower())
        out = found.frame(self.tables) if found else None
        if out is None:
            raise self._unknown(name)
        return out

    def names(self) -> dict[str, list[str]]:
        """Tables, and the views that they suffice for."""
        return {"tables": sorted(self.tables), "views": [v.name for v in VIEWS.values() if v.choose(self.tables)]}

    def query(self, text: str) -> DataFrame:
        """The answer to a view or table name (one word), or to Spark SQL; an empty text lists what there is.

        SQL may call macros and read views: ``SELECT * FROM "hot-methods"``. The tables ``macros`` and ``jfr$views`` and the functions
        macro_sql(name) and view_sql(name) describe them.
        """
        text = text.strip().rstrip(";")
        if not text:
            return self.listing()
        if re.search(r"\s", text):
            self._install(text)
            return self.spark.sql(macros.expand(text))
        if text in self.tables:
            return self.tables[text]
        extra = {MACRO_TABLE: self.macro_table, VIEW_TABLE: self.view_table}.get(text.lower())
        return extra() if extra else self.view(text)

    def _install(self, text: str) -> None:
        """Put the views that a query names into the session's catalog; the others are not even planned."""
        low = text.lower()
        named = {v.name: v for v in VIEWS.values() if re.search(rf"(?<![\w-]){re.escape(v.name.lower())}(?![\w-])", low) and v.name not in self.tables}
        for name, v in named.items():
            if name not in self._installed and (frame := v.frame(self.tables)) is not None:
                frame.createOrReplaceTempView(f"`{name}`")
                self._installed.add(name)
        for name, make in ((MACRO_TABLE, self.macro_table), (VIEW_TABLE, self.view_table)):
            if name in low and name not in self._installed and name not in self.tables:
                make().createOrReplaceTempView(f"`{name}`")
                self._installed.add(name)
        if "macro_sql" in low and "macro_sql" not in self._installed:
            self.spark.sql(macros.lookup_function("macro_sql", {m.name: m.definition() for m in macros.MACROS.values()}))
            self._installed.add("macro_sql")
        if "view_sql" in low and "view_sql" not in self._installed:
            known = [v.name for v in VIEWS.values() if v.choose(self.tables)]
            self.spark.sql(macros.lookup_function("view_sql", {n: self.view_plan(n) for n in known} or {"": ""}))
            self._installed.add("view_sql")

    def listing(self) -> DataFrame:
        """name, kind and label of all tables, and of the views that they suffice for."""
        rows = [(n, "table", None) for n in sorted(self.tables)] + [(v.name, "view", v.title) for v in VIEWS.values() if v.choose(self.tables)]
        return self.spark.createDataFrame(rows, "name string, kind string, label string")

    def _unknown(self, name: str) -> UnknownName:
        names = self.names()
        near = suggestions(name, names["tables"] + names["views"])
        return UnknownName(f"no table or view {name!r} here" + (f"; did you mean {', '.join(near)}?" if near else ""))

    def text(self, query: str, csv: bool = False, width: int = 120, limit: int | None = None, cell_width: int | None = None) -> str:
        """The rows of a query as a text table or CSV; the driver holds them, so give a limit where they are many."""
        labels, numeric, rows = render.cells(self.query(query), limit)
        return render.csv(labels, rows, cell_width) if csv else render.table(labels, numeric, rows, width)

    def save(self, query: str, path: str, csv: bool = False, **options) -> None:
        """Write what :meth:`text` gives to a file of the driver; CSV rows stream there and are not held together."""
        with open(path, "w", encoding="utf-8") as out:
            if not csv:
                out.write(self.text(query, **options))
                return
            df, limit, cell_width = self.query(query), options.get("limit"), options.get("cell_width")
            out.write(render.csv(df.columns, []))
            for row in (df if limit is None else df.limit(limit)).toLocalIterator(prefetchPartitions=True):
                out.write(render.csv_row([render.text_of(v) for v in row], cell_width))

    def macro_table(self) -> DataFrame:
        rows = [(m.name, m.about, m.sample) for m in macros.MACROS.values()]
        return self.spark.createDataFrame(rows, "name string, description string, sampleUsage string")

    def view_table(self) -> DataFrame:
        """All views; ``available`` tells whether the tables suffice. Their definitions are plans: see :meth:`view_plan` and view_sql."""
        rows = [(v.name, v.category, v.title, list(v.requires or v.any_of), v.choose(self.tables) is not None) for v in VIEWS.values()]
        return self.spark.createDataFrame(rows, "name string, category string, label string, requires array<string>, available boolean")

    def view_plan(self, name: str) -> str:
        """The logical plan of a view: what a text definition is elsewhere."""
        return self.view(name)._jdf.queryExecution().analyzed().toString()

    def context(self) -> str:
        """A description of tables, views and macros, as a prompt for a language model."""
        out = ["Answer with one Spark SQL query over these tables; use the views and macros where they fit.", "", "Tables:"]
        for name in sorted(self.tables):
            out.append(f"- {name}")
            for f in self.tables[name].schema.fields:
                target = ingest.DICTIONARIES.get(f.metadata.get("kind", ""))
                note = ", ".join(x for x in (f.metadata.get("comment", ""), f"refers to {target}._id" if target else "") if x)
                out.append(f"    {f.name} {f.dataType.simpleString()}" + (f"  -- {note}" if note else ""))
        out += ["", "Views (query by name):"]
        out += [f"- {v.name}: {v.title}" for v in VIEWS.values() if v.choose(self.tables)]
        out += ["", "Macros:"]
        out += [f"- {m.name}({', '.join(m.args)}): {m.about} For example: {m.sample}" for m in macros.MACROS.values() if self.tables.has(m.requires)]
        return "\n".join(out) + "\n"


def views() -> str:
    """All views by category."""
    out = []
    for category in sorted({v.category for v in VIEWS.values()}):
        out += [category, *(f"  {v.name:32} {v.title}" for v in VIEWS.values() if v.category == category), ""]
    return "\n".join(out)


def list_macros() -> str:
    return "\n".join(f"{m.name}({', '.join(m.args)})\n  {m.about}\n  {m.sample}\n  {m.definition()}\n" for m in macros.MACROS.values())
