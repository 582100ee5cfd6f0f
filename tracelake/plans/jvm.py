"""Views of the virtual machine: compilation, collection, safepoints and native memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.formatting import format_duration, format_memory
from tracelake.functions.stats import first, last, p90, p95, p99, p999
from tracelake.operators.relate import union_present, with_site
from tracelake.plans.environment import labelled, latest
from tracelake.plans.spec import Tables, view

JVM = "jvm"
STACK = "stackTrace$topMethod"
APP_STACK = "stackTrace$topApplicationMethod"


def seconds_between(a: str | Column, b: str | Column) -> Column:
    """Seconds from timestamp a to timestamp b."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return F.timestamp_diff("MICROSECOND", col(a), col(b)) / 1e6


def durations(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Average, P95, longest, count and total duration by the keys."""
    return df.groupBy(*labelled({k: F.col(c) for k, c in keys.items()})).agg(
        format_duration(F.avg("duration")).alias("Average"), format_duration(p95("duration")).alias("P95"), format_duration(F.max("duration")).alias("Longest"),
        F.count("*").alias("Count"), format_duration(F.sum("duration")).alias("Total"), F.sum("duration").alias("_total"),
    )


@view("blocked-by-system-gc", JVM, "Blocked by System.gc()", "SystemGC", "Method", "Class")
def blocked_by_system_gc(t: Tables) -> DataFrame:
    rows = with_site(t["SystemGC"].where(~F.col("invokedConcurrent")), t, APP_STACK, how="left")
    top = rows.orderBy(F.desc_nulls_last("duration"), "_seq").limit(25)
    return top.select(F.col("startTime").alias("Time"), format_duration(F.col("duration")).alias("Duration"), F.col("site").alias("Stack Trace"))


@view("class-modifications", JVM, "Class Modifications", "Method", "Class", any_of=("RedefineClasses", "RetransformClasses"))
def class_modifications(t: Tables) -> DataFrame:
    branch = lambda label: {"Operation": F.lit(label), "duration": F.col("duration"), "at": F.col(APP_STACK), "Classes": F.col("classCount")}
    both = union_present(t, [("RedefineClasses", branch("Redefine Classes")), ("RetransformClasses", branch("Retransform Classes"))])
    rows = with_site(both, t, "at", how="left").orderBy(F.desc_nulls_last("duration"))
    return rows.select(format_duration(F.col("duration")).alias("Time"), F.col("site").alias("Requested By"), "Operation", "Classes")


@view("compiler-configuration", JVM, "Compiler Configuration", "CompilerConfiguration")
def compiler_configuration(t: Tables) -> DataFrame:
    return latest(t["CompilerConfiguration"], {"Compiler Threads": last("threadCount"), "Dynamic Compiler Threads": last("dynamicCompilerThreadCount"), "Tiered Compilation": last("tieredCompilation")})


@view("compiler-statistics", JVM, "Compiler Statistics", "CompilerStatistics")
def compiler_statistics(t: Tables) -> DataFrame:
    plain, time, size = (lambda c: last(c)), (lambda c: format_duration(last(c))), (lambda c: format_memory(last(c)))
    columns = {
        "Compiled Methods": (plain, "compileCount"), "Peak Time": (time, "peakTimeSpent"), "Total Time": (time, "totalTimeSpent"), "Bailouts": (plain, "bailoutCount"),
        "OSR Compilations": (plain, "osrCompileCount"), "Standard Compilations": (plain, "standardCompileCount"), "OSR Bytes Compiled": (size, "osrBytesCompiled"),
        "Standard Bytes Compiled": (size, "standardBytesCompiled"), "Compilation Resulting Size": (size, "nmethodsSize"), "Compilation Resulting Code Size": (size, "nmethodCodeSize"),
    }
    return latest(t["CompilerStatistics"], {k: f(c) for k, (f, c) in columns.items()})


@view("compiler-phases", JVM, "Concurrent Compiler Phases", "CompilerPhase")
def compiler_phases(t: Tables) -> DataFrame:
    return durations(t["CompilerPhase"], {"Level": "phaseLevel", "Phase": "phase"}).orderBy(F.asc_nulls_last("Level"), F.desc_nulls_last("_total")).drop("_total")


@view("deoptimizations-by-reason", JVM, "Deoptimization by Reason", "Deoptimization")
def deoptimizations_by_reason(t: Tables) -> DataFrame:
    return t["Deoptimization"].groupBy(F.col("reason").alias("Reason")).agg(F.count("reason").alias("Count")).orderBy(F.desc("Count"))


@view("deoptimizations-by-site", JVM, "Deoptimization by Site", "Deoptimization", "Method", "Class")
def deoptimizations_by_site(t: Tables) -> DataFrame:
    rows = with_site(t["Deoptimization"].groupBy("method", "lineNumber", "bci").agg(F.count("reason").alias("Count")), t, "method")
    return rows.orderBy(F.desc("Count")).select(F.col("site").alias("Method"), F.col("lineNumber").alias("Line Number"), F.col("bci").alias("BCI"), "Count")


@view("gc", JVM, "Garbage Collections", "GarbageCollection", "GCHeapSummary")
def gc(t: Tables) -> DataFrame:
    heap = lambda when, name: t["GCHeapSummary"].where(F.col("when") == when).select("gcId", F.col("heapUsed").alias(name))
    rows = t["GarbageCollection"].join(heap("Before GC", "before"), "gcId").join(heap("After GC", "after"), "gcId").orderBy(F.asc_nulls_last("gcId"))
    return rows.select(*labelled({
        "Start": F.col("startTime"), "GC ID": F.col("gcId"), "Type": F.coalesce("name", F.lit("Unknown")), "Heap Before GC": format_memory(F.col("before")),
        "Heap After GC": format_memory(F.col("after")), "Longest Pause": format_duration(F.col("longestPause")),
    }))


@view("gc-concurrent-phases", JVM, "Concurrent GC Phases", "GCPhaseConcurrent")
def gc_concurrent_phases(t: Tables) -> DataFrame:
    return durations(t["GCPhaseConcurrent"], {"Name": "name"}).orderBy(F.desc_nulls_last("_total")).drop("_total")


@view("gc-parallel-phases", JVM, "Parallel GC Phases", "GCPhaseParallel")
def gc_parallel_phases(t: Tables) -> DataFrame:
    return durations(t["GCPhaseParallel"], {"Name": "name"}).orderBy(F.desc_nulls_last("_total")).drop("_total")


@view("gc-configuration", JVM, "GC Configuration", "GCConfiguration")
def gc_configuration(t: Tables) -> DataFrame:
    return latest(t["GCConfiguration"], {
        "Young GC": last("youngCollector"), "Old GC": last("oldCollector"), "Parallel GC Threads": last("parallelGCThreads"), "Concurrent GC Threads": last("concurrentGCThreads"),
        "Dynamic GC Threads": last("usesDynamicGCThreads"), "Concurrent Explicit GC": last("isExplicitGCConcurrent"), "Disable Explicit GC": last("isExplicitGCDisabled"),
        "Pause Target": format_duration(last("pauseTarget")), "GC Time Ratio": last("gcTimeRatio"),
    })


@view("gc-references", JVM, "GC References", "GCReferenceStatistics")
def gc_references(t: Tables) -> DataFrame:
    """One pass in place of a self-join for each kind; a collection counts if it has all four kinds (each once)."""
    kinds = {"Soft Ref.": "Soft reference", "Weak Ref.": "Weak reference", "Phantom Ref.": "Phantom reference", "Final Ref.": "Final reference"}
    wide = t["GCReferenceStatistics"].groupBy(F.col("gcId").alias("GC ID")).agg(first("startTime").alias("Time"), *labelled({k: F.max(F.when(F.col("type") == v, F.col("count"))) for k, v in kinds.items()}), *(F.count_if(F.col("type") == v).alias(f"_{k}") for k, v in kinds.items()))
    full = wide.where(" and ".join(f"`_{k}` > 0" for k in kinds))
    total = sum((F.col(f"`{k}`") for k in kinds), F.lit(0))
    return full.orderBy(F.asc_nulls_last("GC ID")).select("Time", "GC ID", *(F.col(f"`{k}`") for k in kinds), total.alias("Total Count"))


PAUSES = {"GCPhasePause": "GC Phase Pause"} | {f"GCPhasePauseLevel{n}": f"GC Phase Pause Level {n}" for n in (1, 2, 3, 4)}


@view("gc-pause-phases", JVM, "GC Pause Phases", any_of=tuple(PAUSES))
def gc_pause_phases(t: Tables) -> DataFrame:
    phases = union_present(t, [(name, {"type": F.lit(label), "name": F.col("name"), "duration": F.col("duration")}) for name, label in PAUSES.items()])
    return durations(phases, {"Type": "type", "Name": "name"}).orderBy("Type", F.desc_nulls_last("_total")).drop("_total")


@view("gc-pauses", JVM, "GC Pauses", "GCPhasePause")
def gc_pauses(t: Tables) -> DataFrame:
    time = {
        "Total": F.sum("duration"), "Minimum": F.min("duration"), "Median": F.median("duration"), "Average": F.avg("duration"), "P90": p90("duration"),
        "P95": p95("duration"), "P99": p99("duration"), "P99.9%": p999("duration"), "Maximum": F.max("duration"),
    }
    one = latest(t["GCPhasePause"], {"Number of Pauses": F.count("duration")} | {f"{k} Pause Time": format_duration(c) for k, c in time.items()})
    return one.select("`Total Pause Time`", "`Number of Pauses`", *(f"`{k} Pause Time`" for k in list(time)[1:]))


@view("gc-allocation-trigger", JVM, "GC Allocation Trigger", "AllocationRequiringGC", "Method", "Class")
def gc_allocation_trigger(t: Tables) -> DataFrame:
    rows = with_site(t["AllocationRequiringGC"].groupBy(APP_STACK).agg(F.count("*").alias("Count"), F.sum("size").alias("size")), t, APP_STACK)
    return rows.orderBy(F.desc("Count"), F.desc_nulls_last("size")).select(F.col("site").alias("Trigger Method (Non-JDK)"), "Count", format_memory(F.col("size")).alias("Total Requested"))


@view("gc-cpu-time", JVM, "GC CPU Time", "GCCPUTime")
def gc_cpu_time(t: Tables) -> DataFrame:
    return latest(t["GCCPUTime"], {
        "GC User Time": format_duration(F.sum("userTime")), "GC System Time": format_duration(F.sum("systemTime")), "GC Wall Clock Time": format_duration(F.sum("realTime")),
        "Total Time": format_duration(seconds_between(F.min("startTime"), F.max("startTime"))), "GC Count": F.count("*"),
    })


@view("heap-configuration", JVM, "Heap Configuration", "GCHeapConfiguration")
def heap_configuration(t: Tables) -> DataFrame:
    size = lambda c: format_memory(last(c))
    return latest(t["GCHeapConfiguration"], {"Initial Size": size("initialSize"), "Minimum Size": size("minSize"), "Maximum Size": size("maxSize"), "If Compressed Oops Are Used": last("usesCompressedOops"), "Compressed Oops Mode": last("compressedOopsMode")})


@view("jdk-agents", JVM, "JDK Agents", any_of=("JavaAgent", "NativeAgent"))
def jdk_agents(t: Tables) -> DataFrame:
    """Each kind is reduced to one row a name before the union, so equal names of both kinds stay apart."""
    one = lambda df: df.groupBy("name").agg(last("initializationTime").alias("Time"), last("initializationDuration").alias("d"), last("options").alias("Options"))
    known = Tables({n: one(t[n]) for n in ("JavaAgent", "NativeAgent") if n in t})
    columns = {"Time": F.col("Time"), "Initialization": format_duration(F.col("d")), "Name": F.col("name"), "Options": F.col("Options")}
    return union_present(known, [(n, columns) for n in ("JavaAgent", "NativeAgent")]).orderBy(F.asc_nulls_last("Time"))


@view("jvm-information", JVM, "JVM Information", "JVMInformation")
def jvm_information(t: Tables) -> DataFrame:
    names = {"PID": "pid", "VM Start": "jvmStartTime", "Name": "jvmName", "Version": "jvmVersion", "VM Arguments": "jvmArguments", "Program Arguments": "javaArguments"}
    return latest(t["JVMInformation"], {k: last(c) for k, c in names.items()})


def _native_memory(t: Tables, column: str) -> DataFrame:
    kinds = t["NativeMemoryUsage"].groupBy(F.col("type").alias("Memory Type")).agg(first(column).alias("First Observed"), format_memory(F.avg(column)).alias("Average"), last(column).alias("Last Observed"), F.max(column).alias("_max"))
    return kinds.orderBy(F.desc_nulls_last("_max")).select("Memory Type", "First Observed", "Average", "Last Observed", format_memory(F.col("_max")).alias("Maximum"))


@view("native-memory-committed", JVM, "Native Memory Committed", "NativeMemoryUsage")
def native_memory_committed(t: Tables) -> DataFrame:
    return _native_memory(t, "committed")


@view("native-memory-reserved", JVM, "Native Memory Reserved", "NativeMemoryUsage")
def native_memory_reserved(t: Tables) -> DataFrame:
    return _native_memory(t, "reserved")


def _safepoints(t: Tables, cleanup: bool) -> DataFrame:
    end = t["SafepointEnd"].select("safepointId", F.col("startTime").alias("ended"))
    rows = t["SafepointBegin"].join(end, "safepointId")
    rows = rows.join(t["SafepointStateSynchronization"].select("safepointId", F.col("duration").alias("sync")), "safepointId", "left")
    if cleanup:
        rows = rows.join(t["SafepointCleanup"].select("safepointId", F.col("duration").alias("cleanup")), "safepointId", "left")
    else:
        rows = rows.withColumn("cleanup", F.lit(None).cast("double"))
    return rows.orderBy(F.asc_nulls_last("startTime")).select(*labelled({
        "Start Time": F.col("startTime"), "Duration": format_duration(seconds_between("startTime", "ended")), "State Synchronization": format_duration(F.col("sync")),
        "Cleanup": format_duration(F.col("cleanup")), "JNI Critical Threads": F.col("jniCriticalThreadCount"), "Total Threads": F.col("totalThreadCount"),
    }))


@view("safepoints", JVM, "Safepoints", "SafepointBegin", "SafepointEnd", "SafepointStateSynchronization", "SafepointCleanup", alternatives=[(("SafepointBegin", "SafepointEnd", "SafepointStateSynchronization"), lambda t: _safepoints(t, False))])
def safepoints(t: Tables) -> DataFrame:
    return _safepoints(t, True)


@view("longest-compilations", JVM, "Longest Compilations", "Compilation", "Method", "Class")
def longest_compilations(t: Tables) -> DataFrame:
    top = with_site(t["Compilation"], t, "method").orderBy(F.desc_nulls_last("duration"), "_seq").limit(25)
    return top.select(F.col("startTime").alias("Start Time"), format_duration(F.col("duration")).alias("Duration"), F.concat("site_class", F.lit("."), "site_method").alias("Method"), F.col("compileLevel").alias("Compile Level"), F.col("succeded").alias("Succeeded"))


@view("tlabs", JVM, "Thread Local Allocation Buffers", "ObjectAllocationInNewTLAB", "ObjectAllocationOutsideTLAB")
def tlabs(t: Tables) -> DataFrame:
    def one(table: str, column: str, label: str) -> DataFrame:
        sizes = {"Minimum Size": F.min, "Average Size": F.avg, "Maximum Size": F.max, "Total Allocation": F.sum}
        return latest(t[table], {f"{label} Count": F.count(column)} | {f"{label} {k}": format_memory(f(column)) for k, f in sizes.items()})

    return one("ObjectAllocationInNewTLAB", "tlabSize", "Inside").crossJoin(one("ObjectAllocationOutsideTLAB", "allocationSize", "Outside"))


@view("vm-operations", JVM, "VM Operations", "ExecuteVMOperation")
def vm_operations(t: Tables) -> DataFrame:
    rows = t["ExecuteVMOperation"].groupBy(F.col("operation").alias("VM Operation")).agg(
        format_duration(F.avg("duration")).alias("Average Duration"), format_duration(F.max("duration")).alias("Longest Duration"),
        F.count("*").alias("Count"), format_duration(F.sum("duration")).alias("Total Duration"), F.sum("duration").alias("_total"),
    )
    return rows.orderBy(F.desc_nulls_last("_total")).drop("_total")
