"""Views of the machine, the container and the configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.formatting import format_duration, format_hex, format_memory, format_percentage
from tracelake.functions.stats import first, last
from tracelake.operators.relate import union_present
from tracelake.plans.spec import Tables, view

ENV = "environment"
FLAGS = ("Int", "UnsignedInt", "Boolean", "Long", "UnsignedLong", "Double", "String")


def labelled(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in columns.items()]


def latest(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row of aggregates, each under its label."""
    return df.agg(*labelled(columns))


@view("active-recordings", ENV, "Active Recordings", "ActiveRecording")
def active_recordings(t: Tables) -> DataFrame:
    names = {"Start": "recordingStart", "Duration": "recordingDuration", "Name": "name", "Destination": "destination", "Max Age": "maxAge", "Max Size": "maxSize"}
    return t["ActiveRecording"].groupBy("id").agg(*labelled({k: last(c) for k, c in names.items()})).drop("id")


@view("active-settings", ENV, "Active Settings", "ActiveSetting", "EventIDs")
def active_settings(t: Tables) -> DataFrame:
    keys = {"Enabled": "enabled", "Threshold": "threshold", "Stack Trace": "stackTrace", "Period": "period", "Cutoff": "cutoff", "Throttle": "throttle"}
    wide = t["ActiveSetting"].groupBy("id").agg(*labelled({k: F.max(F.when(F.col("name") == v, F.col("value"))) for k, v in keys.items()}))
    names = t["EventIDs"].groupBy(F.col("id").alias("event_id")).agg(F.min("name").alias("Event Type"))
    return wide.join(names, wide["id"] == names["event_id"], "left").select("Event Type", *keys).orderBy(F.asc_nulls_last("Event Type"))


@view("container-configuration", ENV, "Container Configuration", "ContainerConfiguration")
def container_configuration(t: Tables) -> DataFrame:
    return latest(t["ContainerConfiguration"], {
        "Container Type": last("containerType"),
        "CPU Slice Period": format_duration(last("cpuSlicePeriod")),
        "CPU Quota": format_duration(last("cpuQuota")),
        "CPU Shares": last("cpuShares"),
        "Effective CPU Count": last("effectiveCpuCount"),
        "Memory Soft Limit": format_memory(last("memorySoftLimit")),
        "Memory Limit": format_memory(last("memoryLimit")),
        "Swap Memory Limit": format_memory(last("swapMemoryLimit")),
        "Host Total Memory": format_memory(last("hostTotalMemory")),
    })


@view("container-cpu-usage", ENV, "Container CPU Usage", "ContainerCPUUsage")
def container_cpu_usage(t: Tables) -> DataFrame:
    names = {"CPU Time": "cpuTime", "CPU User Time": "cpuUserTime", "CPU System Time": "cpuSystemTime"}
    return latest(t["ContainerCPUUsage"], {k: format_duration(last(c)) for k, c in names.items()})


@view("container-memory-usage", ENV, "Container Memory Usage", "ContainerMemoryUsage")
def container_memory_usage(t: Tables) -> DataFrame:
    return latest(t["ContainerMemoryUsage"], {"Memory Fail Count": last("memoryFailCount"), "Memory Usage": format_memory(last("memoryUsage")), "Swap Memory Usage": format_memory(last("swapMemoryUsage"))})


@view("container-io-usage", ENV, "Container I/O Usage", "ContainerIOUsage")
def container_io_usage(t: Tables) -> DataFrame:
    return latest(t["ContainerIOUsage"], {"Service Requests": last("serviceRequests"), "Data Transferred": format_memory(last("dataTransferred"))})


@view("container-cpu-throttling", ENV, "Container CPU Throttling", "ContainerCPUThrottling")
def container_cpu_throttling(t: Tables) -> DataFrame:
    return latest(t["ContainerCPUThrottling"], {"CPU Elapsed Slices": last("cpuElapsedSlices"), "CPU Throttled Slices": last("cpuThrottledSlices"), "CPU Throttled Time": format_duration(last("cpuThrottledTime"))})


@view("cpu-information", ENV, "CPU Information", "CPUInformation")
def cpu_information(t: Tables) -> DataFrame:
    names = {"CPU": "cpu", "Sockets": "sockets", "Cores": "cores", "Hardware Threads": "hwThreads", "Description": "description"}
    return t["CPUInformation"].select(*labelled({k: F.col(c) for k, c in names.items()})).distinct()


LOADS = {"JVM User": "jvmUser", "JVM System": "jvmSystem", "Machine Total": "machineTotal"}


@view("cpu-load", ENV, "CPU Load Statistics", "CPULoad")
def cpu_load(t: Tables) -> DataFrame:
    kinds = {"Minimum": F.min, "Average": F.avg, "Maximum": F.max}
    return latest(t["CPULoad"], {f"{label} ({kind})": format_percentage(f(c)) for label, c in LOADS.items() for kind, f in kinds.items()})


@view("cpu-load-samples", ENV, "CPU Load", "CPULoad")
def cpu_load_samples(t: Tables) -> DataFrame:
    return t["CPULoad"].orderBy(F.asc_nulls_last("startTime")).select(F.col("startTime").alias("Time"), *labelled({k: format_percentage(F.col(c)) for k, c in LOADS.items()}))


@view("cpu-tsc", ENV, "CPU Time Stamp Counter", "CPUTimeStampCounter")
def cpu_tsc(t: Tables) -> DataFrame:
    hertz = lambda c: F.concat(last(c).cast("string"), F.lit(" Hz"))
    return latest(t["CPUTimeStampCounter"], {"Fast Time Auto Enabled": last("fastTimeAutoEnabled"), "Fast Time Enabled": last("fastTimeEnabled"), "Fast Time Frequency": hertz("fastTimeFrequency"), "OS Frequency": hertz("osFrequency")})


def _events(t: Tables) -> DataFrame:
    return t["Events"].join(t["EventLabels"].select("name", "label"), "name")


@view("events-by-count", ENV, "Event Types by Count", "Events", "EventLabels")
def events_by_count(t: Tables) -> DataFrame:
    return _events(t).orderBy(F.desc_nulls_last("count"), "label").select(F.col("label").alias("Event Label"), F.col("count").alias("Count"))


@view("events-by-name", ENV, "Event Types by Name", "Events", "EventLabels")
def events_by_name(t: Tables) -> DataFrame:
    return _events(t).orderBy(F.asc_nulls_last("name")).select(F.col("label").alias("Event Label"), F.col("count").alias("Count"))


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").alias("Key"), F.col("value").alias("Value")).distinct().orderBy(F.asc_nulls_last("Key"), F.asc_nulls_last("Value"))


@view("environment-variables", ENV, "Environment Variables", "InitialEnvironmentVariable")
def environment_variables(t: Tables) -> DataFrame:
    return _pairs(t["InitialEnvironmentVariable"])


@view("system-properties", ENV, "System Properties at Startup", "InitialSystemProperty")
def system_properties(t: Tables) -> DataFrame:
    return _pairs(t["InitialSystemProperty"])


FLAG_TABLES = tuple(f"{kind}Flag{changed}" for changed in ("", "Changed") for kind in FLAGS)


@view("jvm-flags", ENV, "Command Line Flags", any_of=FLAG_TABLES)
def jvm_flags(t: Tables) -> DataFrame:
    both = union_present(t, [(name, {"Name": F.col("name"), "Value": F.col("value").cast("string")}) for name in FLAG_TABLES])
    return both.distinct().orderBy(F.asc_nulls_last("Name"))


@view("native-libraries", ENV, "Native Libraries", "NativeLibrary")
def native_libraries(t: Tables) -> DataFrame:
    one = t["NativeLibrary"].select("name", "baseAddress", "topAddress").distinct().orderBy(F.asc_nulls_last("name"))
    return one.select(F.col("name").alias("Name"), format_hex(F.col("baseAddress")).alias("Base Address"), format_hex(F.col("topAddress")).alias("Top Address"))


@view("native-library-failures", ENV, "Native Library Load/Unload Failures", any_of=("NativeLibraryUnload", "NativeLibraryLoad"))
def native_library_failures(t: Tables) -> DataFrame:
    branch = lambda label: {"Operation": F.lit(label), "Library": F.col("name"), "Error Message": F.col("errorMessage"), "success": F.col("success")}
    both = union_present(t, [("NativeLibraryUnload", branch("Native Library Unload")), ("NativeLibraryLoad", branch("Native Library Load"))])
    return both.where(~F.col("success")).drop("success").orderBy("Operation", F.asc_nulls_last("Library"))


@view("network-utilization", ENV, "Network Utilization", "NetworkUtilization")
def network_utilization(t: Tables) -> DataFrame:
    rate = lambda x: F.concat(format_memory(x / 8), F.lit("/s"))
    return t["NetworkUtilization"].groupBy(F.col("networkInterface").alias("Network Interface")).agg(
        rate(F.avg("readRate")).alias("Avg. Read Rate"), rate(F.max("readRate")).alias("Max. Read Rate"),
        rate(F.avg("writeRate")).alias("Avg. Write Rate"), rate(F.max("writeRate")).alias("Max. Write Rate"),
    ).orderBy(F.asc_nulls_last("Network Interface"))


@view("recording", ENV, "Recording Information", "RecordingInfo")
def recording(t: Tables) -> DataFrame:
    return t["RecordingInfo"].select(*labelled({
        "Event Count": F.col("eventCount"), "First Recorded Event": F.col("firstEvent"), "Last Recorded Event": F.col("lastEvent"),
        "Length of Recorded Events": format_duration(F.col("eventDurationSeconds")), "Dump Reason": F.col("dumpReason"),
    }))


@view("system-information", ENV, "System Information", "PhysicalMemory", "OSInformation", "CPUInformation", "VirtualizationInformation")
def system_information(t: Tables) -> DataFrame:
    """One row of each table, side by side: none of them is multiplied by the others."""
    cpu = {"CPU Type": "cpu", "Number of Cores": "cores", "Number of Hardware Threads": "hwThreads", "Number of Sockets": "sockets", "CPU Description": "description"}
    memory = latest(t["PhysicalMemory"], {"Total Physical Memory Size": format_memory(last("totalSize"))})
    system = latest(t["OSInformation"], {"OS Version": last("osVersion")})
    virtual = latest(t["VirtualizationInformation"], {"Virtualization": last("name")})
    return memory.crossJoin(system).crossJoin(virtual).crossJoin(latest(t["CPUInformation"], {k: last(c) for k, c in cpu.items()}))


@view("system-processes", ENV, "System Processes", "SystemProcess")
def system_processes(t: Tables) -> DataFrame:
    seen = t["SystemProcess"].groupBy(F.col("pid").alias("PID")).agg(first("startTime").alias("First Observed"), last("startTime").alias("Last Observed"), first("commandLine").alias("Command Line"))
    return seen.orderBy(F.asc_nulls_last("First Observed")).select("First Observed", "Last Observed", "PID", "Command Line")
