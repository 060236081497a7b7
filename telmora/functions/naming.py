"""Exposed metric names: unit suffixes, counter/gauge/histogram families and runtime aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telmora.schema import TYPE_HISTOGRAM, TYPE_SUM

# Unit → suffix, and older names under which runtime metrics stay reachable.
UNIT_SUFFIXES = {"s": "_seconds", "ms": "_seconds", "By": "_bytes", "%": "_ratio"}
LEGACY_ALIASES = {
    "dotnet.process.cpu.time": ["process_cpu_time_seconds_total"],
    "dotnet.process.memory.working_set": ["process_memory_usage_bytes"],
    "dotnet.assembly.count": ["process_runtime_dotnet_assemblies_count"],
    "dotnet.exceptions": ["process_runtime_dotnet_exceptions_count_total"],
    "dotnet.gc.heap.total_allocated": ["process_runtime_dotnet_gc_allocations_size"],
    "dotnet.gc.collections": ["process_runtime_dotnet_gc_collections_count_total"],
    "dotnet.gc.last_collection.memory.committed_size": [
        "process_runtime_dotnet_gc_committed_memory_size_bytes"
    ],
    "dotnet.gc.last_collection.heap.fragmentation.size": [
        "process_runtime_dotnet_gc_heap_fragmentation_size_bytes"
    ],
    "dotnet.gc.last_collection.heap.size": [
        "process_runtime_dotnet_gc_heap_size_bytes",
        "process_runtime_dotnet_gc_objects_size",
    ],
    "dotnet.thread_pool.queue.length": ["process_runtime_dotnet_thread_pool_queue_length"],
    "dotnet.thread_pool.thread.count": ["process_runtime_dotnet_thread_pool_threads_count"],
}
SAMPLE_SUFFIXES = ("_bucket", "_count", "_sum", "_total")
MEASURE_SUFFIXES = ("_seconds", "_bytes", "_ratio")


def unit_suffix(unit: Column) -> Column:
    out = None
    for u, suffix in UNIT_SUFFIXES.items():
        out = F.when(unit == u, suffix) if out is None else out.when(unit == u, suffix)
    return out.otherwise("")


def scale(unit: Column, value: Column) -> Column:
    """Milliseconds are exposed as seconds."""
    return F.when(unit == "ms", value / F.lit(1000.0)).otherwise(value)


def raw_name(name: Column) -> Column:
    return F.replace(name, F.lit("."), F.lit("_"))


def base_name(name: Column, unit: Column) -> Column:
    return F.concat(raw_name(name), unit_suffix(unit))


def _aliases(name: Column) -> Column:
    out = None
    for stored, names in LEGACY_ALIASES.items():
        listed = F.array(*[F.lit(n) for n in names])
        out = F.when(name == stored, listed) if out is None else out.when(name == stored, listed)
    return out.otherwise(F.array().cast("array<string>"))


def counter_names(name: Column, unit: Column) -> Column:
    own = F.array(F.concat(base_name(name, unit), F.lit("_total")), raw_name(name))
    return F.array_distinct(F.concat(own, _aliases(name)))


def gauge_names(name: Column, unit: Column) -> Column:
    return F.array_distinct(F.concat(F.array(base_name(name, unit), raw_name(name)), _aliases(name)))


def histogram_names(name: Column, unit: Column) -> Column:
    base = base_name(name, unit)
    return F.array(*[F.concat(base, F.lit(s)) for s in ("_bucket", "_sum", "_count")])


def exposed_names(name: Column, unit: Column, type_: Column) -> Column:
    """All names under which a stored metric can be queried."""
    return (
        F.when(type_ == TYPE_SUM, counter_names(name, unit))
        .when(type_ == TYPE_HISTOGRAM, histogram_names(name, unit))
        .otherwise(gauge_names(name, unit))
    )


def exposed_type(type_: Column) -> Column:
    return F.when(type_ == TYPE_SUM, "counter").when(type_ == TYPE_HISTOGRAM, "histogram").otherwise("gauge")


def candidate_names(exposed: str) -> list[str]:
    """Underscored stored names an exposed name may stand for, best first."""
    stripped = exposed
    for suffix in SAMPLE_SUFFIXES:
        if exposed.endswith(suffix):
            stripped = exposed.removesuffix(suffix)
            break
    out = [exposed, stripped]
    for name in (exposed, stripped):
        out += [name.removesuffix(s) for s in MEASURE_SUFFIXES if name.endswith(s) and name != s]
    return list(dict.fromkeys(out))


def may_expose(name: Column, exposed: str) -> Column:
    """Filter on stored names, applied before points are expanded into samples."""
    aliased = [stored for stored, names in LEGACY_ALIASES.items() if exposed in names]
    return raw_name(name).isin(candidate_names(exposed)) | name.isin(aliased)


def resolve_stored_name(names: DataFrame, exposed: str) -> DataFrame:
    """The stored name (column ``name``) behind an exposed one: an alias first, else the best candidate."""
    aliased = [stored for stored, listed in LEGACY_ALIASES.items() if exposed in listed]
    rank = F.when(F.col("name").isin(aliased), 0)
    for i, candidate in enumerate(candidate_names(exposed), 1):
        rank = rank.when(raw_name(F.col("name")) == candidate, i)
    ranked = names.select("name").distinct().withColumn("__rank", rank).where(F.col("__rank").isNotNull())
    best = Window.orderBy("__rank", "name")
    # a handful of stored names can carry one exposed name
    return ranked.withColumn("__rn", F.row_number().over(best)).where(F.col("__rn") == 1).select("name")
