"""Recording-shaped tables derived from generic test tables, for queries and tests without a recording.

A shape is a base table, a filter and one expression for each column. Expressions are plain SQL that Spark and other engines read
alike, so that an oracle can be given the same tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tracelake.plans.spec import Tables


@dataclass(frozen=True)
class Shape:
    base: str
    columns: dict[str, str]
    where: str = "true"
    null_row: str | None = None  # a dictionary's row 0, as a select list over no table

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        base = spark.read.parquet(f"{sf_dir}/{self.base}.parquet").where(self.where)
        out = base.selectExpr(*(f"{e} AS `{c}`" for c, e in self.columns.items()))
        if self.null_row:
            first = spark.range(1).selectExpr(*(f"CAST({e} AS {t}) AS `{c}`" for (c, t), e in zip(out.dtypes, self.null_row.split(", "))))
            out = first.unionByName(out)
        return out

    def sql(self) -> str:
        out = "SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in self.columns.items()) + f" FROM {self.base} WHERE {self.where}"
        if self.null_row:
            first = ", ".join(f'{e} AS "{c}"' for c, e in zip(self.columns, self.null_row.split(", ")))
            out = f"SELECT {first} UNION ALL {out}"
        return out


def label(prefix: str, n: int, by: str = "event_id") -> str:
    return f"concat('{prefix}', CAST({by} % {n} AS STRING))"


def whole(expr: str) -> str:
    return f"CAST(floor({expr}) AS BIGINT)"


def choice(*values: str, by: str = "event_id") -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {by} % {len(values)} {cases} END"


def number(n: int, plus: int = 0) -> str:
    return f"(event_id * 7 + {plus}) % {n}"


def seconds(power: int) -> str:
    """A time of its own size: value is up to a few hundred. The odd divisor keeps averages off the borders of rounding."""
    return f"value / {10**power + 0.37}e0"


def size(power: int) -> str:
    return whole(f"value * 1e{power}")


def flag(n: int) -> str:
    return f"(event_id % {n} = 0)"


#: Method and class ids run over 2000, of which some are unknown; users stand for threads.
METHOD, CLASS, OTHER = "event_id % 1999", "(event_id * 3) % 503", "(event_id * 5) % 61"
APP = "CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 97 END"
TOP, TOP_APP, TOP_NON_INIT = "stackTrace$topMethod", "stackTrace$topApplicationMethod", "stackTrace$topNonInitMethod"


def events(where: str = "true", **columns: str) -> Shape:
    fixed = {"_seq": "event_id", "startTime": "ts"}
    return Shape("events", fixed | {k.replace("__", "$"): v for k, v in columns.items()}, where)


def _shapes() -> dict[str, Shape]:
    dur, ms, us = seconds(2), seconds(4), seconds(7)
    path = {"path": label("/data/file", 37), "bytesRead": size(3), "bytesWritten": size(5), "duration": ms}
    host = {"host": label("host", 11), "bytesRead": size(2), "bytesWritten": size(6), "duration": us}
    thrown = {"thrownClass": CLASS, "message": "nullif(" + label("failure ", 9) + ", 'failure 3')", "stackTrace__topNonInitMethod": METHOD}
    flags = {"name": label("Flag", 23), "value": number(5)}
    phase = {"gcId": "event_id", "name": label("phase ", 6), "duration": us}
    native = {"name": label("lib", 13), "errorMessage": label("no such file ", 4), "success": flag(3)}
    out = {
        "Class": Shape("part", {"_id": "p_partkey", "javaName": "concat(p_type, '.', p_brand)"}, null_row="0, NULL"),
        "Method": Shape("part", {"_id": "p_partkey", "type": "p_partkey % 701", "name": "p_name", "descriptor": "'()'"}, null_row="0, NULL, NULL, NULL"),
        "Thread": Shape("customer", {"_id": "c_custkey", "javaName": "c_name"}, null_row="0, NULL"),
        "ClassLoader": Shape("supplier", {"_id": "s_suppkey", "javaName": "s_name", "name": "s_name"}, null_row="0, NULL, NULL"),
        "Module": Shape("nation", {"_id": "n_nationkey", "name": "n_name"}),
        "OldObject": Shape("part", {"_id": "p_partkey", "type": "p_size"}),
        "ActiveRecording": events(id="user_id % 5", name=label("recording ", 3), destination="CAST(NULL AS STRING)", maxAge=dur, maxSize=size(4), recordingStart="ts", recordingDuration=seconds(1)),
        "ActiveSetting": events(id="user_id % 40", name=choice("enabled", "threshold", "stackTrace", "period", "cutoff", "throttle"), value="CAST(event_id AS STRING)"),
        "CompilerConfiguration": events(threadCount=number(16), dynamicCompilerThreadCount=flag(2), tieredCompilation=flag(3)),
        "CompilerStatistics": events(compileCount=number(999), peakTimeSpent=dur, totalTimeSpent=seconds(0), bailoutCount=number(7), osrCompileCount=number(11), standardCompileCount=number(997), osrBytesCompiled=size(1), standardBytesCompiled=size(4), nmethodsSize=size(6), nmethodCodeSize=size(8)),
        "ContainerConfiguration": events(containerType=label("cgroupv", 3), cpuSlicePeriod=ms, cpuQuota="0.0 - " + us, cpuShares=number(1024), effectiveCpuCount=number(64), memorySoftLimit="0 - " + size(0), memoryLimit=size(5), swapMemoryLimit=size(7), hostTotalMemory=size(9)),
        "ContainerCPUUsage": events(cpuTime=dur, cpuUserTime=ms, cpuSystemTime=us),
        "ContainerMemoryUsage": events(memoryFailCount=number(3), memoryUsage=size(6), swapMemoryUsage=size(3)),
        "ContainerIOUsage": events(serviceRequests=number(500), dataTransferred=size(4)),
        "ContainerCPUThrottling": events(cpuElapsedSlices=number(90), cpuThrottledSlices=number(9), cpuThrottledTime="value * 0.0"),
        "CPUInformation": events(cpu=label("cpu ", 2), description=label("model ", 2), sockets="1", cores="8", hwThreads="16"),
        "CPULoad": events("event_id % 4 = 1", jvmUser="value / 1e3", jvmSystem="value / 3e3", machineTotal="value / 5e2"),
        "CPUTimeStampCounter": events(fastTimeAutoEnabled=flag(2), fastTimeEnabled=flag(5), fastTimeFrequency=size(5), osFrequency="1000000000"),
        "Deoptimization": events(reason="nullif(" + label("reason ", 8) + ", 'reason 5')", method=METHOD, lineNumber=number(40), bci=number(30)),
        "InitialEnvironmentVariable": events(key=label("KEY", 50), value=label("v", 3)),
        "InitialSystemProperty": events(key=label("java.prop", 60), value=label("p", 7)),
        "JVMInformation": events(pid="user_id", jvmStartTime="ts", jvmName=label("VM ", 3), jvmVersion=label("21.0.", 5), jvmArguments="CAST(NULL AS STRING)", javaArguments=label("app ", 4)),
        "NativeLibrary": events(name=label("lib", 40), baseAddress="(event_id % 80) * 4096", topAddress="(event_id % 80) * 4096 + 4095"),
        "NativeLibraryUnload": events("event_id % 3 = 0", **native), "NativeLibraryLoad": events("event_id % 3 = 1", **native),
        "NetworkUtilization": events(networkInterface=label("eth", 4), readRate=size(3), writeRate=size(5)),
        "PhysicalMemory": events(totalSize=size(8)), "OSInformation": events(osVersion=label("Linux ", 3)), "VirtualizationInformation": events(name=label("none", 2)),
        "RecordingInfo": Shape("events", {"eventCount": "1", "firstEvent": "ts", "lastEvent": "ts", "eventDurationSeconds": dur, "dumpReason": "'End of run'"}, "event_id % 1000 = 7"),
        "SystemProcess": events(pid=label("", 30), commandLine=label("run ", 77)),
        "SystemGC": events("event_id % 6 = 2", invokedConcurrent=flag(4), duration=dur, stackTrace__topApplicationMethod=METHOD),
        "RedefineClasses": events("event_id % 9 = 1", classCount=number(6), duration=dur, stackTrace__topApplicationMethod=METHOD),
        "RetransformClasses": events("event_id % 9 = 2", classCount=number(8), duration=ms, stackTrace__topApplicationMethod=METHOD),
        "CompilerPhase": events(phase=label("phase ", 12), phaseLevel=number(4), duration=us),
        "Compilation": events(method=METHOD, compileLevel=number(5), succeded=flag(7), duration=ms),
        "GarbageCollection": events("event_type = 'error'", gcId="event_id", name="nullif(" + label("GC", 3) + ", 'GC1')", longestPause=seconds(3)),
        "GCHeapSummary": events("event_type IN ('error', 'click')", gcId="CASE WHEN event_type = 'error' THEN event_id ELSE event_id - 1 END", when="CASE WHEN event_type = 'error' THEN 'Before GC' ELSE 'After GC' END", heapUsed=size(7)),
        "YoungGarbageCollection": events("event_type = 'error' AND event_id % 3 = 0", gcId="event_id"),
        "OldGarbageCollection": events("event_type = 'error' AND event_id % 3 = 1", gcId="event_id"),
        "GCPhasePause": events("event_id % 7 = 0", **phase), "GCPhaseConcurrent": events("event_id % 7 = 5", **phase), "GCPhaseParallel": events("event_id % 7 = 6", **phase),
        **{f"GCPhasePauseLevel{n}": events(f"event_id % 7 = {n}", **phase) for n in (1, 2, 3, 4)},
        "GCConfiguration": events(youngCollector=label("Young", 2), oldCollector=label("Old", 2), parallelGCThreads=number(16), concurrentGCThreads=number(4), usesDynamicGCThreads=flag(2), isExplicitGCConcurrent=flag(3), isExplicitGCDisabled=flag(5), pauseTarget="value * 1e10", gcTimeRatio=number(20)),
        "GCHeapConfiguration": events(initialSize=size(6), minSize=size(4), maxSize=size(8), usesCompressedOops=flag(2), compressedOopsMode=label("mode ", 3)),
        "GCReferenceStatistics": events("event_id % 16 <> 3", gcId=whole("event_id / 4e0"), type=choice("Soft reference", "Weak reference", "Phantom reference", "Final reference"), count=number(100)),
        "GCCPUTime": events("event_id % 5 = 3", userTime=ms, systemTime=us, realTime=dur),
        "AllocationRequiringGC": events("event_id % 3 = 0", size=size(4), stackTrace__topApplicationMethod=APP),
        "ObjectAllocationSample": events(objectClass=CLASS, weight=size(3), eventThread="user_id", stackTrace__topMethod=METHOD),
        "ObjectAllocationInNewTLAB": events("event_id % 2 = 0", tlabSize=size(3)), "ObjectAllocationOutsideTLAB": events("event_id % 2 = 1", allocationSize=size(6)),
        "ObjectCountAfterGC": events("event_id % 2 = 0", objectClass=OTHER, count=number(50), totalSize=size(4)),
        "ObjectCount": events("event_id % 2 = 1", objectClass=OTHER, count=number(70), totalSize=size(5)),
        "OldObjectSample": events(object=METHOD, allocationTime="ts", objectAge=dur, lastKnownHeapUsage=size(6), stackTrace__topApplicationMethod=APP),
        "NativeMemoryUsage": events(type=label("kind ", 15), committed=size(5), reserved=size(6)),
        "FinalizerStatistics": events(finalizableClass=OTHER, objects=number(12), totalFinalizersRun=number(31)),
        "JavaAgent": events("event_id % 2 = 0", name=label("agent", 6), initializationTime="ts", initializationDuration=ms, options=label("opt", 9)),
        "NativeAgent": events("event_id % 2 = 1", name=label("native", 4), initializationTime="ts", initializationDuration=us, options="CAST(NULL AS STRING)"),
        "ExecutionSample": events(stackTrace__topMethod=METHOD, stackTrace__topApplicationMethod=APP),
        "CPUTimeSample": events("event_id % 3 > 0", stackTrace__topMethod=OTHER, stackTrace__topApplicationMethod=APP, failed=flag(10), biased=flag(4)),
        "CPUTimeSamplesLost": events("event_id % 50 = 0", lostSamples=number(9)),
        "NativeMethodSample": events("event_id % 2 = 1", stackTrace__topMethod=OTHER, stackTrace__topApplicationMethod=APP),
        "JavaMonitorEnter": events("event_id % 3 = 2", duration=ms, monitorClass=CLASS, address="event_id % 300 - 20", eventThread="user_id", stackTrace__topMethod=METHOD),
        "JavaMonitorWait": events("event_id % 4 = 0", duration=dur), "ThreadPark": events("event_id % 4 = 1", duration=ms), "ThreadSleep": events("event_id % 4 = 2", duration=seconds(1)),
        "JavaMonitorInflate": events(duration=us, monitorClass=OTHER, stackTrace__topMethod=METHOD, stackTrace__topApplicationMethod=APP),
        "SocketRead": events("event_id % 5 = 0", **host), "SocketWrite": events("event_id % 5 = 1", **host), "FileRead": events("event_id % 5 = 2", **path), "FileWrite": events("event_id % 5 = 3", **path),
        "JavaErrorThrow": events("event_id % 4 = 0", **thrown), "JavaExceptionThrow": events("event_id % 4 > 1", **thrown),
        "ExceptionStatistics": events(throwables="event_id * 3"),
        "ClassLoad": events(loadedClass=CLASS, duration=ms), "ClassLoaderStatistics": events(classLoader="event_id % 130", classCount=number(300), hiddenClassCount=number(20)),
        "DeprecatedInvocation": events("event_id % 10 = 0", method=OTHER, forRemoval=flag(3), stackTrace__topMethod=METHOD),
        "ExecuteVMOperation": events(operation=label("operation ", 14), duration=us),
        "MethodTiming": events(method=OTHER, invocations=number(900), minimum=us, average=ms, maximum=dur),
        "MethodTrace": events(method=OTHER, stackTrace__topMethod="event_id % 29"),
        "ModuleRequire": events(source="event_id % 30"),
        "SafepointBegin": events("event_id % 4 = 0", safepointId="event_id", jniCriticalThreadCount=number(3), totalThreadCount=number(60)),
        "SafepointEnd": events("event_id % 4 = 1 AND event_id % 20 <> 1", safepointId="event_id - 1"),
        "SafepointStateSynchronization": events("event_id % 4 = 2 AND event_id % 12 <> 2", safepointId="event_id - 2", duration=us),
        "SafepointCleanup": events("event_id % 4 = 3 AND event_id % 28 <> 3", safepointId="event_id - 3", duration=us),
        "JavaThreadStatistics": events("event_id % 8 = 0", activeCount=number(50), daemonCount=number(20), accumulatedCount="event_id", peakCount=number(90)),
        "ThreadAllocationStatistics": events(thread="user_id", allocated=size(5)),
        "ThreadCPULoad": events(eventThread="user_id", system="value / 2e3", user="value / 1e3"),
        "ThreadStart": events("event_type = 'signup' AND user_id % 3 > 0", eventThread="user_id", stackTrace__topMethod=METHOD),
        "ThreadEnd": events("event_type = 'purchase' AND user_id % 5 > 0", eventThread="user_id"),
        "VirtualThreadPinned": events("event_id % 6 = 1", duration=dur, stackTrace__topApplicationMethod=APP),
        **{f"{kind}Flag{changed}": events(f"event_id % 16 = {i + 7 * c}", **(flags | {"value": value})) for c, changed in enumerate(("", "Changed")) for i, (kind, value) in enumerate({"Int": number(5), "UnsignedInt": number(6), "Boolean": flag(2), "Long": size(4), "UnsignedLong": size(6), "Double": "(event_id % 8) * 0.5e0", "String": label("text ", 4)}.items())},
        # kinds of events, for the tables an import derives itself
        "Events": Shape("events", {"name": "event_type", "count": "event_id"}),
        "EventLabels": Shape("events", {"name": "event_type", "label": "event_type"}),
        "EventIDs": events("event_id < 40", name=label("Kind", 1000), id="event_id"),
    }
    return out


SHAPES = _shapes()


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One shaped table; the event registers are aggregates of the events."""
    from pyspark.sql import functions as F

    base = SHAPES[name].frame(spark, sf_dir)
    if name == "Events":
        return base.groupBy("name").agg(F.count("*").alias("count"))
    if name == "EventLabels":
        return base.distinct().withColumn("label", F.concat(F.lit("Label of "), "name"))
    return base


def sql(name: str) -> str:
    """The same table for an oracle."""
    text = SHAPES[name].sql()
    if name == "Events":
        return f"SELECT name, count(*) AS count FROM ({text}) GROUP BY name"
    if name == "EventLabels":
        return f"SELECT DISTINCT name, concat('Label of ', name) AS label FROM ({text})"
    return text


class ShapedTables(Tables):
    """All shapes over a folder, each read when it is asked for; ``without`` hides some."""

    def __init__(self, spark: SparkSession, sf_dir: str, without: tuple[str, ...] = ()):
        self._spark, self._dir = spark, sf_dir
        self._names = {n.lower(): n for n in SHAPES if n not in without}

    def __getitem__(self, name: str) -> DataFrame:
        return frame(self._spark, self._dir, self._names[name.lower()])

    def __iter__(self):
        return iter(self._names.values())

    def __len__(self) -> int:
        return len(self._names)

    def __contains__(self, name: object) -> bool:
        return str(name).lower() in self._names
