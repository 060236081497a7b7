"""Search, summaries and tree order of traces."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telmora.functions import attributes as A
from telmora.functions.integers import int_div
from telmora.operators.ordered import ranked, sliced_join
from telmora.runtime import checkpointed
from telmora.schema import STATUS_ERROR


def in_range(column: str, from_ns: int | None, to_ns: int | None) -> Column:
    """Inclusive time range; an open side does not filter."""
    cond = F.lit(True)
    if from_ns is not None:
        cond = cond & (F.col(column) >= from_ns)
    if to_ns is not None:
        cond = cond & (F.col(column) <= to_ns)
    return cond


def list_spans(
    spans: DataFrame,
    from_ns: int | None = None,
    to_ns: int | None = None,
    kind: int | None = None,
    min_status: int | None = None,
) -> DataFrame:
    """Spans by start time, kind and least status code."""
    out = spans.where(in_range("start_unix_nano", from_ns, to_ns))
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if min_status is not None:
        out = out.where(F.col("status_code") >= min_status)
    return out


def newest_first(df: DataFrame, column: str, *ties: str, limit: int, offset: int = 0) -> DataFrame:
    out = df.orderBy(F.col(column).desc(), *ties)
    return (out.offset(offset) if offset else out).limit(limit)


def trace_spans(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.where(F.col("trace_id") == trace_id).orderBy("start_unix_nano", "span_id")


def logs_of_traces(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Logs that belong to any of the traces in ``spans``."""
    return sliced_join(logs, spans.select("trace_id").distinct(), ["trace_id"], "ts_unix_nano", "left_semi")


def trace_summaries(
    spans: DataFrame,
    from_ns: int | None = None,
    to_ns: int | None = None,
    has_error: bool | None = None,
    service_names: Iterable[str] | None = None,
    service_name: str | None = None,
    service_version: str | None = None,
    name_contains: str | None = None,
) -> DataFrame:
    """One row per trace: first start, last end, duration, span count and error flag.

    The time range applies to spans. Service, version and name keep whole traces in which some span
    matches; service and version must match on the same span, and version only counts together with
    a service. All of it is one aggregation per trace.
    """
    inside = in_range("start_unix_nano", from_ns, to_ns)
    matches = []
    services = A.service_list(service_names, service_name)
    if services is not None:
        cond = A.in_services(services)
        if service_version is not None:
            cond = cond & A.has_version(service_version)
        matches.append(cond)
    if name_contains is not None:
        matches.append(A.contains_phrase(F.col("name"), name_contains))
    failed = F.when(F.col("status_code") == STATUS_ERROR, 1).otherwise(0)
    if matches:
        # matching spans may lie outside the range, so the range becomes a condition of the aggregates
        start, end = F.when(inside, F.col("start_unix_nano")), F.when(inside, F.col("end_unix_nano"))
        counted, failed = F.count(F.when(inside, 1)), F.when(inside, failed)
    else:
        spans = spans.where(inside)
        start, end, counted = F.col("start_unix_nano"), F.col("end_unix_nano"), F.count(F.lit(1))
    grouped = spans.groupBy("trace_id").agg(
        F.min(start).alias("first_start"),
        F.max(end).alias("last_end"),
        counted.alias("span_count"),
        F.max(failed).alias("__err"),
        *[F.max(m.cast("int")).alias(f"__m{i}") for i, m in enumerate(matches)],
    )
    for i in range(len(matches)):
        grouped = grouped.where(F.col(f"__m{i}") == 1)
    if matches:
        grouped = grouped.where(F.col("span_count") > 0)
    if has_error is not None:
        grouped = grouped.where(F.col("__err") == int(has_error))
    return grouped.select(
        "trace_id",
        "first_start",
        "last_end",
        F.greatest(F.lit(0).cast("long"), F.col("last_end") - F.col("first_start")).alias("duration_ns"),
        "span_count",
        (F.col("__err") == 1).alias("has_error"),
    )


# Sort keys of the trace list.
_SORT_COLUMNS = {"start": "first_start", "duration": "__extent", "spans": "span_count", "status": "has_error"}


def trace_page(
    summaries: DataFrame, sort: str = "start", direction: str = "desc", limit: int | None = None, offset: int = 0
) -> DataFrame:
    """A page of the trace list; unknown sort keys mean start, ties go by trace id."""
    column = F.col(_SORT_COLUMNS.get(sort, "first_start"))
    ordered = summaries.withColumn("__extent", F.col("last_end") - F.col("first_start")).orderBy(
        column.asc() if direction.lower() == "asc" else column.desc(), "trace_id"
    )
    page = ordered.offset(offset) if offset else ordered
    return (page if limit is None else page.limit(limit)).drop("__extent")


def trace_roots(spans: DataFrame) -> DataFrame:
    """Name and service of each trace's root: its earliest span without parent, else its earliest span."""
    has_parent = F.coalesce(F.col("parent_id") != "", F.lit(False))
    first = F.min(
        F.struct(
            has_parent.alias("p"),
            F.col("start_unix_nano").alias("s"),
            F.col("span_id").alias("i"),
            F.col("name").alias("name"),
            F.coalesce(A.service(), F.lit("")).alias("service"),
        )
    )
    return (
        spans.groupBy("trace_id")
        .agg(first.alias("__r"))
        .select("trace_id", F.col("__r.name").alias("root_name"), F.col("__r.service").alias("root_service"))
    )


def with_roots(summaries: DataFrame, spans: DataFrame) -> DataFrame:
    """Add root name and service. Roots are looked up among all spans of the listed traces, not only
    those inside the time range; only spans of these traces take part."""
    mine = sliced_join(spans, summaries.select("trace_id"), ["trace_id"], "span_id", "left_semi")
    return summaries.join(trace_roots(mine), "trace_id", "left")


def trace_tree_order(spans: DataFrame, max_depth: int | None = None) -> DataFrame:
    """One row per (trace, span) with ``depth`` and ``position`` (1-based) in pre-order per trace.

    Of spans sent twice the earliest counts. Children go by start, ties by span id. Spans whose parent
    is not in the trace are roots; spans on or below a cycle follow at the end with depth 0.

    Every span keeps a pointer to an ancestor and the path from there. A round replaces the pointer by
    the ancestor's own, so paths double and the rounds grow with the logarithm of the depth; a round in
    which no span reaches its root leaves only cycles. ``max_depth`` makes deeper traces an error.
    """
    earliest = Window.partitionBy("trace_id", "span_id").orderBy("start_unix_nano", "end_unix_nano", "name", "parent_id")
    nodes = spans.withColumn("__n", F.row_number().over(earliest)).where(F.col("__n") == 1).drop("__n")
    nodes = checkpointed(nodes)
    step = F.struct(F.col("start_unix_nano").alias("s"), F.col("span_id").alias("i"))
    parent = F.when(F.col("parent_id").cast("string") != "", F.col("parent_id"))
    named = nodes.select("trace_id", "span_id", parent.alias("__up"), F.array(step).alias("__path"))
    ids = nodes.select("trace_id", F.col("span_id").alias("__up"), F.lit(True).alias("__known"))
    known = sliced_join(named, ids, ["trace_id", "__up"], "span_id", "left")
    pointers = checkpointed(known.withColumn("__up", F.when(F.col("__known"), F.col("__up"))).drop("__known"))
    climbing, before = pointers.where(F.col("__up").isNotNull()).count(), -1
    while climbing not in (0, before):
        above = pointers.select("trace_id", F.col("span_id").alias("__up"), F.col("__up").alias("__next"), F.col("__path").alias("__head"))
        moved = sliced_join(pointers.where(F.col("__up").isNotNull()), above, ["trace_id", "__up"], "span_id").select(
            "trace_id", "span_id", F.col("__next").alias("__up"), F.concat("__head", "__path").alias("__path")
        )
        pointers = checkpointed(pointers.where(F.col("__up").isNull()).unionByName(moved))
        before, climbing = climbing, pointers.where(F.col("__up").isNotNull()).count()
    lost = F.col("__up").isNotNull()
    placed = pointers.select(
        "trace_id",
        "span_id",
        lost.cast("int").alias("__lost"),
        F.when(lost, F.slice("__path", -1, 1)).otherwise(F.col("__path")).alias("__path"),
    )
    if max_depth is not None and (placed.agg(F.max(F.size("__path"))).first()[0] or 0) > max_depth + 1:
        raise ValueError(f"a trace is deeper than {max_depth} levels")
    both = nodes.join(placed, ["trace_id", "span_id"]).withColumn("depth", F.size("__path") - 1)
    return ranked(both, ["trace_id"], ["__lost", "__path"], "position").drop("__lost", "__path")


def trace_ranges(spans: DataFrame) -> DataFrame:
    """Wall-clock range per trace; the end is always after the start."""
    out = spans.groupBy("trace_id").agg(F.min("start_unix_nano").alias("start"), F.max("end_unix_nano").alias("end"))
    return out.withColumn("end", F.greatest(F.col("end"), F.col("start") + 1))


def start_histogram(spans: DataFrame, buckets: int = 20) -> DataFrame:
    """Span starts per trace in equal-width buckets; empty buckets are included."""
    n = max(1, buckets)
    ranges = trace_ranges(spans)
    width = F.col("end") - F.col("start")
    place = F.floor((F.col("start_unix_nano") - F.col("start")) * F.lit(float(n)) / width).cast("int")
    counted = (
        spans.select("trace_id", "start_unix_nano")
        .transform(lambda df: sliced_join(df, ranges, ["trace_id"], "start_unix_nano"))
        .withColumn("bucket", F.least(F.lit(n - 1), F.greatest(F.lit(0), place)))
        .groupBy("trace_id", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    edge = lambda i: F.col("start") + int_div(width * i, n)
    slots = ranges.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        "trace_id",
        "bucket",
        edge(F.col("bucket")).alias("from_unix_nano"),
        F.greatest(edge(F.col("bucket") + 1), edge(F.col("bucket")) + 1).alias("to_unix_nano"),
    )
    return slots.join(counted, ["trace_id", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def latest_error_traces(spans: DataFrame, limit: int = 5) -> DataFrame:
    return trace_page(trace_summaries(spans, has_error=True), limit=limit)


def deduplicate_spans(spans: DataFrame, arrival: str = "ingest_seq") -> DataFrame:
    """First arrival per (trace_id, span_id). Each task first reduces its own copies to one."""
    w = Window.partitionBy("trace_id", "span_id").orderBy(arrival)
    return spans.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")
