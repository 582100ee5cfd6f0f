"""Views of the application: allocation, locks, exceptions, input and output, methods and threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.formatting import format_duration, format_hex, format_memory, format_percentage
from tracelake.functions.stats import continuous, count_unique, first, last, p90, p99
from tracelake.operators.relate import share_of_total, union_present, with_name, with_site
from tracelake.plans.environment import labelled
from tracelake.plans.jvm import APP_STACK, STACK, seconds_between
from tracelake.plans.spec import Tables, view

APP = "application"
TOP = 25


def _pressure(t: Tables, key: str) -> DataFrame:
    """The 25 keys with most allocated weight and their share of all weight."""
    rows = t["ObjectAllocationSample"]
    sums = rows.groupBy(key).agg(F.sum("weight").alias("part"))
    shares = share_of_total(sums, rows, "part", F.sum("weight"), "share")
    return shares.orderBy(F.desc_nulls_last("share"), F.asc_nulls_last(key)).limit(TOP)


def _pressure_by(t: Tables, key: str, dictionary: str, label: str) -> DataFrame:
    named = with_name(_pressure(t, key), t[dictionary], key, "named").orderBy(F.desc_nulls_last("share"))
    return named.select(F.col("named").alias(label), format_percentage(F.col("share")).alias("Allocation Pressure"))


@view("allocation-by-class", APP, "Allocation by Class", "ObjectAllocationSample", "Class")
def allocation_by_class(t: Tables) -> DataFrame:
    return _pressure_by(t, "objectClass", "Class", "Object Type")


@view("allocation-by-thread", APP, "Allocation by Thread", "ObjectAllocationSample", "Thread")
def allocation_by_thread(t: Tables) -> DataFrame:
    return _pressure_by(t, "eventThread", "Thread", "Thread")


@view("allocation-by-site", APP, "Allocation by Method (disregarding line number and descriptor)", "ObjectAllocationSample", "Method", "Class")
def allocation_by_site(t: Tables) -> DataFrame:
    """Weights are summed per method before the dictionaries are joined, so the join sees 25 rows."""
    rows = with_site(_pressure(t, STACK), t, STACK, how="left", dot="").orderBy(F.desc_nulls_last("share"))
    return rows.select(F.col("site").alias("Method"), format_percentage(F.col("share")).alias("Allocation Pressure"))


@view("class-loaders", APP, "Class Loaders", "ClassLoaderStatistics", "ClassLoader")
def class_loaders(t: Tables) -> DataFrame:
    sums = t["ClassLoaderStatistics"].groupBy("classLoader").agg(last("hiddenClassCount").alias("Hidden Classes"), last("classCount").alias("Classes"))
    return with_name(sums, t["ClassLoader"], "classLoader", "Class Loader", "left").orderBy(F.desc_nulls_last("Classes")).select("Class Loader", "Hidden Classes", "Classes")


@view("contention-by-thread", APP, "Contention by Thread", "JavaMonitorEnter", "Thread")
def contention_by_thread(t: Tables) -> DataFrame:
    rows = with_name(t["JavaMonitorEnter"], t["Thread"], "eventThread", "Thread").groupBy("eventThread", "Thread")
    stats = rows.agg(F.count("*").alias("Count"), format_duration(F.avg("duration")).alias("Avg"), format_duration(p90("duration")).alias("P90"), F.max("duration").alias("most"))
    return stats.orderBy(F.desc_nulls_last("most")).select("Thread", "Count", "Avg", "P90", format_duration(F.col("most")).alias("Max."))


@view("contention-by-class", APP, "Contention by Lock Class", "JavaMonitorEnter", "Class")
def contention_by_class(t: Tables) -> DataFrame:
    rows = with_name(t["JavaMonitorEnter"], t["Class"], "monitorClass", "Lock Class").groupBy("monitorClass", "Lock Class")
    stats = rows.agg(F.count("*").alias("Count"), format_duration(F.avg("duration")).alias("Avg."), format_duration(continuous("duration", 0.9)).alias("P90"), F.max("duration").alias("most"))
    return stats.orderBy(F.desc_nulls_last("most")).select("Lock Class", "Count", "`Avg.`", "P90", format_duration(F.col("most")).alias("Max."))


@view("contention-by-site", APP, "Contention by Site", "JavaMonitorEnter", "Method", "Class")
def contention_by_site(t: Tables) -> DataFrame:
    rows = with_site(t["JavaMonitorEnter"], t, STACK).groupBy("site_class", "site_method", "site_descriptor", "site")
    stats = rows.agg(F.count("*").alias("Count"), format_duration(F.avg("duration")).alias("Avg."), F.max("duration").alias("most"))
    return stats.orderBy(F.desc_nulls_last("most")).select(F.col("site").alias("StackTrace"), "Count", "`Avg.`", format_duration(F.col("most")).alias("Max."))


@view("contention-by-address", APP, "Contention by Monitor Address", "JavaMonitorEnter", "Class")
def contention_by_address(t: Tables) -> DataFrame:
    rows = with_name(t["JavaMonitorEnter"], t["Class"], "monitorClass", "Class").groupBy("address", "Class")
    stats = rows.agg(count_unique("eventThread").alias("Threads"), F.max("duration").alias("most")).orderBy(F.desc_nulls_last("most"))
    return stats.select(format_hex(F.col("address")).alias("Monitor Address"), "Class", "Threads", format_duration(F.col("most")).alias("Max Duration"))


@view("deprecated-methods-for-removal", APP, "Deprecated Methods for Removal", "DeprecatedInvocation", "Method", "Class")
def deprecated_methods_for_removal(t: Tables) -> DataFrame:
    rows = with_site(with_site(t["DeprecatedInvocation"].where("forRemoval"), t, "method"), t, STACK, "caller_")
    keys = ["site_class", "site_method", "site_descriptor"]
    calls = rows.groupBy("method", "site", *keys).agg(F.array_sort(F.collect_set("caller_site_class")).alias("Called from Class"))
    return calls.orderBy(*(F.asc_nulls_last(k) for k in keys)).select(F.col("site").alias("Deprecated Method"), "Called from Class")


@view("exception-count", APP, "Exception Statistics", "ExceptionStatistics")
def exception_count(t: Tables) -> DataFrame:
    return t["ExceptionStatistics"].agg((last("throwables") - first("throwables")).alias("Exceptions Thrown"))


THROWS = ("JavaErrorThrow", "JavaExceptionThrow")


def _thrown(t: Tables, column: str) -> DataFrame:
    return union_present(t, [(name, {"thrown": F.col(f"`{column}`")}) for name in THROWS]).groupBy("thrown").agg(F.count("*").alias("Count"))


@view("exception-by-type", APP, "Exceptions by Type", "Class", any_of=THROWS)
def exception_by_type(t: Tables) -> DataFrame:
    return with_name(_thrown(t, "thrownClass"), t["Class"], "thrown", "Class").orderBy(F.desc("Count")).select("Class", "Count")


@view("exception-by-message", APP, "Exceptions by Message", any_of=THROWS)
def exception_by_message(t: Tables) -> DataFrame:
    return _thrown(t, "message").orderBy(F.desc("Count")).select(F.col("thrown").alias("Message"), "Count")


@view("exception-by-site", APP, "Exceptions by Site", "Method", "Class", any_of=THROWS)
def exception_by_site(t: Tables) -> DataFrame:
    return with_site(_thrown(t, "stackTrace$topNonInitMethod"), t, "thrown").orderBy(F.desc("Count")).select(F.col("site").alias("Method"), "Count")


def _moved(t: Tables, table: str, key: str, size: str, labels: tuple[str, str, str]) -> DataFrame:
    rows = t[table].groupBy(F.col(key).alias(labels[0])).agg(F.count("*").alias(labels[1]), F.sum(size).alias("moved")).orderBy(F.desc_nulls_last("moved"))
    return rows.select(labels[0], labels[1], format_memory(F.col("moved")).alias(labels[2]))


@view("file-reads-by-path", APP, "File Reads by Path", "FileRead")
def file_reads_by_path(t: Tables) -> DataFrame:
    return _moved(t, "FileRead", "path", "bytesRead", ("Path", "Reads", "Total Read"))


@view("file-writes-by-path", APP, "File Writes by Path", "FileWrite")
def file_writes_by_path(t: Tables) -> DataFrame:
    return _moved(t, "FileWrite", "path", "bytesWritten", ("Path", "Writes", "Total Written"))


@view("socket-writes-by-host", APP, "Socket Writes by Host", "SocketWrite")
def socket_writes_by_host(t: Tables) -> DataFrame:
    return _moved(t, "SocketWrite", "host", "bytesWritten", ("Host", "Writes", "Total Written"))


@view("socket-reads-by-host", APP, "Socket Reads by Host", "SocketRead")
def socket_reads_by_host(t: Tables) -> DataFrame:
    return _moved(t, "SocketRead", "host", "bytesRead", ("Host", "Reads", "Total Read"))


@view("finalizers", APP, "Finalizers", "FinalizerStatistics", "Class")
def finalizers(t: Tables) -> DataFrame:
    rows = t["FinalizerStatistics"].groupBy("finalizableClass").agg(last("objects").alias("Objects"), last("totalFinalizersRun").alias("Total Finalizers Run"))
    return with_name(rows, t["Class"], "finalizableClass", "Finalizable Class").orderBy(F.desc_nulls_last("Objects")).select("Finalizable Class", "Objects", "Total Finalizers Run")


def _samples(t: Tables, table: str, group: str, limit: int | None) -> DataFrame:
    """Sample counts by method and their share of all samples, those of unknown methods included."""
    rows = t[table]
    counts = with_site(rows.groupBy(STACK, *([group] if group != STACK else [])).agg(F.count("*").alias("n")), t, STACK)
    # one label can belong to several methods; rows of one group and label are one
    counts = counts.groupBy(group, "site", "site_class", "site_method", "site_descriptor").agg(F.sum("n").alias("Samples"))
    shares = share_of_total(counts, rows, "Samples", F.count("*"), "share").orderBy(F.desc("Samples"), F.asc_nulls_last("site"), F.asc_nulls_last(group))
    shares = shares.limit(limit) if limit else shares
    return shares.select(F.col("site").alias("Method"), "Samples", format_percentage(F.col("share")).alias("Percent"))


@view("hot-methods", APP, "Java Methods that Execute the Most", "ExecutionSample", "Method", "Class")
def hot_methods(t: Tables) -> DataFrame:
    return _samples(t, "ExecutionSample", APP_STACK, TOP)


@view("cpu-time-hot-methods", APP, "Java Methods that Execute the Most from CPU Time Sampler", "CPUTimeSample", "Method", "Class")
def cpu_time_hot_methods(t: Tables) -> DataFrame:
    return _samples(t, "CPUTimeSample", APP_STACK, TOP)


@view("native-methods", APP, "Waiting or Executing Native Methods", "NativeMethodSample", "Method", "Class")
def native_methods(t: Tables) -> DataFrame:
    return _samples(t, "NativeMethodSample", STACK, None)


@view("cpu-time-statistics", APP, "CPU Time Sample Statistics", "CPUTimeSample", "CPUTimeSamplesLost")
def cpu_time_statistics(t: Tables) -> DataFrame:
    counts = t["CPUTimeSample"].agg(F.count_if(~F.col("failed")).alias("Successful Samples"), F.count_if("failed").alias("Failed Samples"), F.count_if("biased").alias("Biased Samples"), F.count("*").alias("Total Samples"))
    return counts.crossJoin(t["CPUTimeSamplesLost"].agg(F.sum("lostSamples").alias("Lost Samples")))


WAITS = {
    "JavaMonitorWait": "Java Monitor Wait", "JavaMonitorEnter": "Java Monitor Enter", "ThreadPark": "Thread Park", "ThreadSleep": "Thread Sleep",
    "SocketRead": "Socket Read", "SocketWrite": "Socket Write", "FileWrite": "File Write", "FileRead": "File Read",
}


@view("latencies-by-type", APP, "Latencies by Type", any_of=tuple(WAITS))
def latencies_by_type(t: Tables) -> DataFrame:
    waits = union_present(t, [(name, {"Event Type": F.lit(label), "duration": F.col("duration")}) for name, label in WAITS.items()])
    stats = waits.groupBy("Event Type").agg(F.count("*").alias("Count"), format_duration(F.avg("duration")).alias("Average"), format_duration(p99("duration")).alias("P 99"), format_duration(F.max("duration")).alias("Longest"), F.sum("duration").alias("total"))
    return stats.orderBy(F.desc_nulls_last("total")).select("Event Type", "Count", "Average", "P 99", "Longest", format_duration(F.col("total")).alias("Total"))


def _leaks(rows: DataFrame, keys: list[str], name: str, label: str) -> DataFrame:
    found = rows.groupBy(*keys).agg(last("allocationTime").alias("Alloc. Time"), format_duration(last("objectAge")).alias("Object Age"), format_memory(last("lastKnownHeapUsage")).alias("Heap Usage"))
    return found.orderBy(F.col("`Alloc. Time`").asc_nulls_last()).select("`Alloc. Time`", F.col(name).alias(label), "Object Age", "Heap Usage")


@view("memory-leaks-by-class", APP, "Memory Leak Candidates by Class", "OldObjectSample", "OldObject", "Class")
def memory_leaks_by_class(t: Tables) -> DataFrame:
    objects = t["OldObject"].select(F.col("_id").alias("object_id"), F.col("type").alias("object_type"))
    rows = t["OldObjectSample"].join(objects, F.col("object") == F.col("object_id"))
    return _leaks(with_name(rows, t["Class"], "object_type", "class"), ["class"], "class", "Object Class")


@view("memory-leaks-by-site", APP, "Memory Leak Candidates by Site", "OldObjectSample", "Method", "Class")
def memory_leaks_by_site(t: Tables) -> DataFrame:
    return _leaks(with_site(t["OldObjectSample"], t, APP_STACK), ["site_id", "site"], "site", "Application Method")


@view("method-timing", APP, "Method Timing", "MethodTiming", "Method", "Class")
def method_timing(t: Tables) -> DataFrame:
    rows = t["MethodTiming"].groupBy("method").agg(last("invocations").alias("Invocations"), *(last(c).alias(c) for c in ("minimum", "average", "maximum")))
    times = [format_duration(F.col(c)).alias(f"{c.capitalize()} Time") for c in ("minimum", "average", "maximum")]
    return with_site(rows, t, "method").orderBy(F.asc_nulls_last("average")).select(F.col("site").alias("Timed Method"), "Invocations", *times)


@view("method-calls", APP, "Method Calls", "MethodTrace", "Method", "Class")
def method_calls(t: Tables) -> DataFrame:
    rows = t["MethodTrace"].groupBy("method", STACK).agg(F.count("*").alias("Invocations"))
    rows = with_site(with_site(rows, t, "method"), t, STACK, "caller_").orderBy(F.desc("Invocations"))
    return rows.select(F.col("site").alias("Traced Method"), F.col("caller_site").alias("Caller"), "Invocations")


@view("modules", APP, "Modules", "ModuleRequire", "Module")
def modules(t: Tables) -> DataFrame:
    sources = t["ModuleRequire"].select("source").distinct()
    return with_name(sources, t["Module"], "source", "Module Name", column="name").select("Module Name").orderBy(F.asc_nulls_last("Module Name"))


@view("monitor-inflation", APP, "Monitor Inflation", "JavaMonitorInflate", "Method", "Class")
def monitor_inflation(t: Tables) -> DataFrame:
    ids = t["JavaMonitorInflate"].groupBy(STACK, APP_STACK, "monitorClass").agg(F.count("*").alias("n"), F.sum("duration").alias("took"))
    rows = with_name(with_site(ids, t, STACK), t["Class"], "monitorClass", "Monitor Class")
    sums = rows.groupBy(APP_STACK, "Monitor Class", "site", "site_class", "site_method", "site_descriptor").agg(F.sum("n").alias("Count"), F.sum("took").alias("total"))
    return sums.orderBy(F.desc_nulls_last("total")).select(F.col("site").alias("Method"), "Monitor Class", "Count", format_duration(F.col("total")).alias("Total Duration"))


@view("object-statistics", APP, "Objects Occupying More than 1%", "Class", any_of=("ObjectCountAfterGC", "ObjectCount"))
def object_statistics(t: Tables) -> DataFrame:
    columns = {c: F.col(c) for c in ("_seq", "objectClass", "count", "totalSize")}
    rows = with_name(union_present(t, [(n, columns) for n in ("ObjectCountAfterGC", "ObjectCount")]), t["Class"], "objectClass", "Class")
    stats = rows.groupBy("Class").agg(last("count").alias("Count"), last("totalSize").alias("size"), (F.max("totalSize") - F.min("totalSize")).alias("increase"))
    return stats.orderBy(F.desc_nulls_last("size")).select("Class", "Count", format_memory(F.col("size")).alias("Heap Space"), format_memory(F.col("increase")).alias("Increase"))


@view("pinned-threads", APP, "Pinned Virtual Threads", "VirtualThreadPinned", "Method", "Class")
def pinned_threads(t: Tables) -> DataFrame:
    rows = t["VirtualThreadPinned"].groupBy(APP_STACK).agg(F.count("*").alias("Pinned Count"), format_duration(F.max("duration")).alias("Longest Pinning"), F.sum("duration").alias("total"))
    rows = with_site(rows, t, APP_STACK)
    return rows.orderBy(F.desc_nulls_last("total")).select(F.col("site").alias("Method"), "Pinned Count", "Longest Pinning", format_duration(F.col("total")).alias("Total Time Pinned"))


@view("thread-count", APP, "Java Thread Statistics", "JavaThreadStatistics")
def thread_count(t: Tables) -> DataFrame:
    names = {"Start Time": "startTime", "Active Threads": "activeCount", "Daemon Threads": "daemonCount", "Accumulated Threads": "accumulatedCount", "Peak Threads": "peakCount"}
    return t["JavaThreadStatistics"].orderBy(F.asc_nulls_last("startTime")).select(*labelled({k: F.col(c) for k, c in names.items()}))


@view("longest-class-loading", APP, "Longest Class Loading", "ClassLoad", "Class")
def longest_class_loading(t: Tables) -> DataFrame:
    top = with_name(t["ClassLoad"], t["Class"], "loadedClass", "Loaded Class").orderBy(F.desc_nulls_last("duration"), "_seq").limit(TOP)
    return top.select(F.col("startTime").alias("Time"), "Loaded Class", format_duration(F.col("duration")).alias("Load Time"))


@view("thread-allocation", APP, "Thread Allocation Statistics", "ThreadAllocationStatistics")
def thread_allocation(t: Tables) -> DataFrame:
    each = t["ThreadAllocationStatistics"].groupBy(F.col("thread").alias("Thread")).agg(last("allocated").alias("Allocated"))
    shares = share_of_total(each, each, "Allocated", F.sum("Allocated"), "share")
    return shares.orderBy(F.desc_nulls_last("Allocated")).select("Thread", "Allocated", format_percentage(F.col("share")).alias("Percentage"))


@view("thread-cpu-load", APP, "Thread CPU Load", "ThreadCPULoad", "Thread")
def thread_cpu_load(t: Tables) -> DataFrame:
    rows = with_name(t["ThreadCPULoad"], t["Thread"], "eventThread", "Thread").groupBy("Thread").agg(last("system").alias("s"), last("user").alias("u"))
    return rows.orderBy(F.desc_nulls_last("u"), F.desc_nulls_last("s")).select("Thread", format_percentage(F.col("s")).alias("System"), format_percentage(F.col("u")).alias("User"))


@view("thread-start", APP, "Platform Thread Start by Method", "Thread", "ThreadStart", "ThreadEnd", "Method", "Class")
def thread_start(t: Tables) -> DataFrame:
    """One row a thread: its first start with the first end from then on (or else its first end), or an end alone.

    Two aggregates and a join of one row a thread: starts and ends of a thread never meet one by one.
    """
    starts = t["ThreadStart"].groupBy(F.col("eventThread").alias("tid")).agg(F.min(F.struct(F.col("startTime"), F.col(STACK).isNull(), F.col(STACK).alias("at"))).alias("first"))
    starts = starts.select("tid", F.col("first.startTime").alias("started"), F.col("first.at").alias("at"))
    ends = t["ThreadEnd"].select(F.col("eventThread").alias("tid"), F.col("startTime").alias("end")).join(starts, "tid", "left").groupBy("tid")
    ends = ends.agg(F.coalesce(F.min(F.when(F.col("end") >= F.col("started"), F.col("end"))), F.min("end")).alias("ended"))
    one = starts.join(ends, "tid", "full")
    named = with_name(one, t["Thread"], "tid", "Thread").where(F.col("Thread").isNotNull())
    rows = with_site(named, t, "at", how="left")
    took: Column = F.when(F.col("started").isNull(), "unknown").when(F.col("ended").isNull(), "infinity").otherwise(format_duration(seconds_between("started", "ended")))
    rows = rows.orderBy((F.col("ended").isNotNull() | F.col("started").isNull()).cast("int"), (F.col("ended") - F.col("started")).desc_nulls_last(), F.asc_nulls_last("started"))
    place = F.when(F.col("site_class").isNull(), F.concat("site_method", "site_descriptor")).otherwise(F.col("site"))
    return rows.select(F.col("started").alias("Start Time"), place.alias("Stack Trace"), "Thread", took.alias("Duration"))
