"""Log search, attribute filters, line filters and grouping."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telmora.functions import attributes as A
from telmora.operators.traces import in_range
from telmora.schema import SEV_ERROR

Filter = tuple[str, str, str]


def attribute_filter(key: str, op: str, value: str) -> Column:
    """``=  !=  =~  !~`` on an attribute that must exist; dots and underscores in the key are equal.

    With both spellings present, one matching value suffices.
    """
    tests = {
        "=": lambda v: v == value,
        "!=": lambda v: v != value,
        "=~": lambda v: v.rlike(value),
        "!~": lambda v: ~v.rlike(value),
    }
    if op not in tests:
        raise ValueError(f"unknown attribute operator {op!r}")
    return A.any_value(A.both_spellings(key), tests[op])


def search_logs(
    logs: DataFrame,
    text: str | None = None,
    min_severity: int | None = None,
    from_ns: int | None = None,
    to_ns: int | None = None,
    trace_id: str | None = None,
    attributes: Iterable[Filter] = (),
    service_names: Iterable[str] | None = None,
    service_name: str | None = None,
    service_version: str | None = None,
) -> DataFrame:
    """Logs that satisfy all given conditions, with their service as ``service_name``.

    A blank text does not filter. Cheap conditions come before the text search.
    """
    cond = in_range("ts_unix_nano", from_ns, to_ns)
    if min_severity is not None:
        cond = cond & (F.col("severity") >= min_severity)
    if trace_id is not None:
        cond = cond & (F.col("trace_id") == trace_id)
    services = A.service_list(service_names, service_name)
    if services is not None:
        cond = cond & A.in_services(services)
    wanted = list(attributes)
    if service_version is not None:
        wanted.append(("service.version", "=", service_version))
    for key, op, value in wanted:
        cond = cond & attribute_filter(key, op, value)
    if text is not None and text.strip():
        cond = cond & A.contains_phrase(F.col("body"), text)
    return logs.where(cond).withColumn("service_name", A.service())


def log_page(
    logs: DataFrame, sort: str = "time", direction: str = "desc", limit: int | None = None, offset: int = 0, ties=()
) -> DataFrame:
    """Logs sorted by time or severity; a page of them where a limit or offset is given."""
    column = F.col("severity" if sort.lower() == "severity" else "ts_unix_nano")
    out = logs.orderBy(column.asc() if direction.lower() == "asc" else column.desc(), *ties)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def latest_error_logs(logs: DataFrame, limit: int = 5, ties=()) -> DataFrame:
    return log_page(search_logs(logs, min_severity=SEV_ERROR), limit=limit, ties=ties)


def line_filter(op: str, value: str, body: str = "body") -> Column:
    """``|=`` contains, ``!=`` lacks, ``|~`` regex found, ``!~`` regex not found; case-sensitive.

    An empty regular expression is never found; unknown operators accept every line.
    """
    line = F.coalesce(F.col(body), F.lit(""))
    found = line.rlike(value) if value else F.lit(False)
    return {
        "|=": line.contains(value),
        "!=": ~line.contains(value),
        "|~": found,
        "!~": ~found,
    }.get(op, F.lit(True))


def lookup_attribute(key: str, attrs: str = "attrs") -> Column:
    """Value of an attribute: exact key, else any letter case, else the other dot/underscore spelling."""
    entries = F.map_entries(F.col(attrs))

    def any_case(k: str) -> Column:
        hit = F.filter(entries, lambda e: F.lower(e["key"]) == k.lower())
        return F.get(hit, F.lit(0))["value"]

    found = [F.try_element_at(F.col(attrs), F.lit(key)), any_case(key)]
    other = key.replace("_", ".") if "_" in key else key.replace(".", "_")
    if other != key:
        found.append(any_case(other))
    return F.coalesce(*found)


def stream_filter(key: str, op: str, value: str, attrs: str = "attrs") -> Column:
    """Lenient matcher: a line without the label passes."""
    v = lookup_attribute(key, attrs)
    found = v.rlike(value) if value else F.lit(False)
    test = {"=": v == value, "!=": v != value, "=~": found, "!~": ~found}.get(op, F.lit(True))
    return v.isNull() | test


def match_logs(logs: DataFrame, stream: Iterable[Filter] = (), lines: Iterable[tuple[str, str]] = ()) -> DataFrame:
    cond = F.lit(True)
    for op, value in lines:
        cond = cond & line_filter(op, value)
    for key, op, value in stream:
        cond = cond & stream_filter(key, op, value)
    return logs.where(cond)


def group_by_service(logs: DataFrame, placeholder: str = "(none)", ties=()) -> DataFrame:
    """Logs with ``service_group`` and ``group_newest``, the time of the group's newest log.

    Groups come in order of their newest log, logs inside a group newest first.
    """
    named = logs.withColumn("service_group", F.coalesce(F.nullif("service_name", F.lit("")), F.lit(placeholder)))
    newest = named.groupBy("service_group").agg(F.max("ts_unix_nano").alias("group_newest"))
    return named.join(newest, "service_group").orderBy(
        F.col("group_newest").desc(), "service_group", F.col("ts_unix_nano").desc(), *ties
    )
