"""The macro library: what each is called, what it means, and how SQL text can call it.

Scalar macros become SQL functions of the session. Aggregate and window macros have no such form, so calls of them in a query are
expanded; that is a substitution of balanced calls, and Spark reads the rest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tracelake.plans.spec import Tables


@dataclass(frozen=True)
class Macro:
    name: str
    args: tuple[str, ...]
    about: str
    sample: str
    sql: str  # the body of a SQL function, or the expansion with {0} for the argument
    expanded: bool = False
    requires: tuple[str, ...] = ()
    returns: str = ""

    def definition(self) -> str:
        if self.expanded:
            return f"{self.name}({self.args[0]}) := {self.sql.format(self.args[0])}"
        return f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({', '.join(self.args)}) RETURNS {self.returns} RETURN {self.sql}"


def _decimals(x: str, d: str) -> str:
    return f"CASE WHEN abs({x}) = double('inf') THEN if({x} < 0, '-inf', 'inf') WHEN {d} = 0 THEN string(floor({x})) ELSE format_number({x}, '0.' || repeat('0', {d})) END"


def _memory() -> str:
    steps = " ".join(f"WHEN abs(x) >= {1024**i}D THEN format_decimals(abs(x) / {1024**i}D, decimals) || ' {u}'" for i, u in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")))
    return f"if(x < 0, '-', '') || CASE {steps} ELSE format_decimals(abs(x), decimals) || ' B' END"


def _duration() -> str:
    steps = "WHEN abs(x) >= 1 THEN format_decimals(abs(x), decimals) || 's' " + " ".join(f"WHEN abs(x) >= 1e-{p} THEN format_decimals(abs(x) * 1e{p}, decimals) || '{u}'" for p, u in ((3, "ms"), (6, "us")))
    return f"CASE WHEN abs(x) > 31536000000D THEN NULL WHEN x = 0 THEN '0s' ELSE if(x < 0, '-', '') || CASE {steps} ELSE format_decimals(abs(x) * 1e9, decimals) || 'ns' END END"


def _human() -> str:
    units = [("d", 86400 * 10**9), ("h", 3600 * 10**9), ("m", 60 * 10**9), ("s", 10**9), ("ms", 10**6), ("us", 1000), ("ns", 1)]
    seconds = "try_cast(x AS DECIMAL(32, 9))"
    ns = f"bigint(abs({seconds}) % 86400 * 1000000000)"
    parts = ", ".join(f"named_struct('n', {f'{ns} % {units[i - 1][1]} div {size}' if i else f'abs({seconds}) div 86400'}, 'u', '{u}')" for i, (u, size) in enumerate(units))
    first = "array_position(transform(p, y -> y.n > 0), true)"
    text = f"if({first} = 0, '0s', p[int({first}) - 1].n || p[int({first}) - 1].u || if({first} < 7 AND get(p, int({first})).n > 0, ' ' || get(p, int({first})).n || get(p, int({first})).u, ''))"
    return f"CASE WHEN {seconds} IS NOT NULL THEN if({seconds} < 0, '-', '') || transform(array(array({parts})), p -> {text})[0] END"


def _percentile(name: str, q: str, ordinal: str) -> Macro:
    return Macro(name, ("col",), f"The {ordinal} percentile of a column (discrete).", f"SELECT {name}(duration) FROM GCPhasePause", f"percentile_disc({q}) WITHIN GROUP (ORDER BY {{0}})", True)


def _lookup(table: str, value: str, key: str, arg: str, where: str = "") -> str:
    return f"(SELECT min({value}) FROM {table} WHERE {key} = {arg}{where})"


MACROS: dict[str, Macro] = {
    m.name.lower(): m
    for m in [
        _percentile("P90", "0.9", "90th"), _percentile("P95", "0.95", "95th"), _percentile("P99", "0.99", "99th"), _percentile("P999", "0.999", "99.9th"),
        Macro("normalized", ("x",), "A value as a share of the largest value of the input; null where that is 0.", "SELECT normalized(duration) FROM GCPhasePause", "try_divide({0}, max({0}) OVER ())", True),
        Macro("diff", ("col",), "The gap to the next smaller value.", "SELECT diff(duration) FROM GCPhasePause", "(({0}) - lag({0}) OVER (ORDER BY {0}))", True),
        Macro("COUNT_UNIQUE", ("x",), "The number of distinct values.", "SELECT monitorClass, COUNT_UNIQUE(eventThread) FROM JavaMonitorEnter GROUP BY monitorClass", "count(DISTINCT {0})", True),
        Macro("format_decimals", ("x DOUBLE", "decimals INT"), "A number with a fixed number of decimals; with none, its floor.", "SELECT format_decimals(pi(), 4)", _decimals("x", "decimals"), returns="STRING"),
        Macro("format_percentage", ("x DOUBLE", "decimals INT DEFAULT 2"), "A share as a percentage.", "SELECT format_percentage(0.123456, 2)", "format_decimals(x * 100, decimals) || '%'", returns="STRING"),
        Macro("format_memory", ("x DOUBLE", "decimals INT DEFAULT 2"), "Bytes as B, KB, MB, GB or TB.", "SELECT format_memory(123456789)", _memory(), returns="STRING"),
        Macro("format_human_duration", ("x DOUBLE",), "Seconds by their two largest units.", "SELECT format_human_duration(60.1)", _human(), returns="STRING"),
        Macro("format_duration", ("x DOUBLE", "decimals INT DEFAULT 2"), "Seconds as s, ms, us or ns; null beyond a thousand years.", "SELECT format_duration(0.0004)", _duration(), returns="STRING"),
        Macro("format_hex", ("i BIGINT",), "An integer in hexadecimal, with 0x before it.", "SELECT format_hex(255)", "'0x' || if(i < 0, '-', '') || lower(hex(abs(i)))", returns="STRING"),
        Macro("before_gc", ("ts TIMESTAMP_NTZ",), "The last collection that began at or before a time, or -1. For whole tables use the as-of join.", "SELECT before_gc(startTime) FROM ExecutionSample", "coalesce((SELECT max_by(gcId, struct(startTime, gcId)) FROM GarbageCollection WHERE startTime <= ts), -1)", requires=("GarbageCollection",), returns="BIGINT"),
        Macro("after_gc", ("ts TIMESTAMP_NTZ",), "The first collection that began after a time, or -1. For whole tables use the as-of join.", "SELECT after_gc(startTime) FROM ExecutionSample", "coalesce((SELECT min_by(gcId, struct(startTime, gcId)) FROM GarbageCollection WHERE startTime > ts), -1)", requires=("GarbageCollection",), returns="BIGINT"),
        Macro("duration_since_last_gc", ("ts TIMESTAMP_NTZ",), "Seconds since the last collection that began at or before a time, or -1.", "SELECT duration_since_last_gc(startTime) FROM ExecutionSample", "coalesce(timestampdiff(MICROSECOND, (SELECT max(startTime) FROM GarbageCollection WHERE startTime <= ts), ts) / 1e6, -1.0D)", requires=("GarbageCollection",), returns="DOUBLE"),
        Macro("HEAP_BEFORE_GC", ("gc_id BIGINT",), "The used heap before a collection.", "SELECT gcId, HEAP_BEFORE_GC(gcId) FROM GarbageCollection", _lookup("GCHeapSummary", "heapUsed", "gcId", "gc_id", " AND `when` = 'Before GC'"), requires=("GCHeapSummary",), returns="BIGINT"),
        Macro("HEAP_AFTER_GC", ("gc_id BIGINT",), "The used heap after a collection.", "SELECT gcId, HEAP_AFTER_GC(gcId) FROM GarbageCollection", _lookup("GCHeapSummary", "heapUsed", "gcId", "gc_id", " AND `when` = 'After GC'"), requires=("GCHeapSummary",), returns="BIGINT"),
        Macro("GC_TYPE", ("gc_id BIGINT",), "Young, Old or Unknown for a collection.", "SELECT gcId, GC_TYPE(gcId) FROM GarbageCollection", "coalesce((SELECT if(count(*) > 0, 'Young', NULL) FROM YoungGarbageCollection WHERE gcId = gc_id), (SELECT if(count(*) > 0, 'Old', NULL) FROM OldGarbageCollection WHERE gcId = gc_id), 'Unknown')", requires=("YoungGarbageCollection", "OldGarbageCollection"), returns="STRING"),
        Macro("EVENT_TYPE_LABEL", ("et STRING",), "The label of an event table.", "SELECT EVENT_TYPE_LABEL('GarbageCollection')", _lookup("EventLabels", "label", "name", "et"), requires=("EventLabels",), returns="STRING"),
        Macro("EVENT_NAME_FOR_ID", ("event_id BIGINT",), "The event table of an event id.", "SELECT EVENT_NAME_FOR_ID(1)", _lookup("EventIDs", "name", "id", "event_id"), requires=("EventIDs",), returns="STRING"),
    ]
}


def macro_sql(name: str) -> str | None:
    """The definition of a macro, or None."""
    found = MACROS.get(name.lower())
    return found.definition() if found else None


def install(spark: SparkSession, tables: Tables) -> list[str]:
    """Create the SQL functions whose tables are there; returns their names."""
    done = []
    for m in MACROS.values():
        if not m.expanded and tables.has(m.requires):
            spark.sql(m.definition())
            done.append(m.name)
    return done


def lookup_function(name: str, texts: dict[str, str]) -> str:
    """A SQL function of the session that gives the text for a name, whatever its case, or null."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cases = " ".join(f"WHEN {quoted(k.lower())} THEN {quoted(v)}" for k, v in texts.items())
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(name STRING) RETURNS STRING RETURN CASE lower(name) {cases} END"


_CALL = re.compile(r"\b(" + "|".join(m.name for m in MACROS.values() if m.expanded) + r")\s*\(", re.IGNORECASE)
_QUOTED = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*")


def expand(sql: str) -> str:
    """Replace calls of aggregate and window macros, and ``name := value`` by ``name => value``; quoted text stays."""
    out, at = [], 0
    quoted = [m.span() for m in _QUOTED.finditer(sql)]
    inside = lambda i: any(a <= i < b for a, b in quoted)
    while m := _CALL.search(sql, at):
        if inside(m.start()):
            out.append(sql[at : m.end()])
            at = m.end()
            continue
        depth, end = 1, m.end()
        while end < len(sql) and depth:
            depth += 0 if inside(end) else (sql[end] == "(") - (sql[end] == ")")
            end += 1
        if depth:
            raise ValueError(f"unbalanced call of {m[1]}")
        out += [sql[at : m.start()], MACROS[m[1].lower()].sql.format(expand(sql[m.end() : end - 1]))]
        at = end
    out.append(sql[at:])
    text = "".join(out)
    quoted = [x.span() for x in _QUOTED.finditer(text)]
    return re.sub(r":=", lambda x: ":=" if any(a <= x.start() < b for a, b in quoted) else "=>", text)
