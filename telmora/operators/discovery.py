"""Distinct names, labels, series, services and versions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telmora.functions import attributes as A
from telmora.functions import labels as L
from telmora.functions import naming as N
from telmora.operators.selectors import Matcher, filter_samples
from telmora.operators.traces import in_range


def stored_metric_names(
    points: DataFrame, rollup: DataFrame | None = None, from_ns: int | None = None, to_ns: int | None = None
) -> DataFrame:
    """Distinct stored names in raw and rolled-up points."""
    names = points.where(in_range("ts_unix_nano", from_ns, to_ns)).select("name")
    if rollup is not None:
        names = names.union(rollup.where(in_range("bucket_start", from_ns, to_ns)).select("name"))
    return names.distinct()


def exposed_metric_names(points: DataFrame) -> DataFrame:
    return metric_metadata(points).select("metric").distinct()


def metric_metadata(points: DataFrame, metric: str | None = None) -> DataFrame:
    """Exposed name and kind (counter, histogram, gauge), derived from the distinct stored metrics."""
    stored = points.select("name", "unit", "type").distinct()
    out = stored.select(
        F.explode(N.exposed_names(F.col("name"), F.col("unit"), F.col("type"))).alias("metric"),
        N.exposed_type(F.col("type")).alias("kind"),
    ).distinct()
    return out if metric is None else out.where(F.col("metric") == metric)


def stored_label_names(points: DataFrame) -> DataFrame:
    return points.select(F.explode(F.map_keys("labels")).alias("label")).distinct()


def label_names(points: DataFrame) -> DataFrame:
    """Exposed label names. The stored keys are reduced to distinct ones before they are mapped."""
    mapped = F.when(F.col("label") == "service.name", F.array(F.lit("job"), F.lit("service_name"))).otherwise(
        F.array(F.replace(F.col("label"), F.lit("."), F.lit("_")))
    )
    return stored_label_names(points).select(F.explode(mapped).alias("label")).distinct()


def matching_points(points: DataFrame, matchers: Iterable[Matcher]) -> DataFrame:
    """Points whose stored labels satisfy matchers; a missing label equals ""."""
    for key, op, value in matchers:
        v = F.try_element_at(F.col("labels"), F.lit(key))
        found = F.coalesce(v.rlike(value), F.lit(False))
        cond = {
            "=": F.coalesce(v, F.lit("")) == value,
            "!=": F.coalesce(v, F.lit("")) != value,
            "=~": found,
            "!~": ~found,
        }[op]
        points = points.where(cond)
    return points


def label_values(points: DataFrame, label: str) -> DataFrame:
    """Distinct values of an exposed label, from every stored key that maps to it; ``__name__`` lists
    the exposed metric names."""
    if label == L.NAME:
        return exposed_metric_names(points).withColumnRenamed("metric", "value")
    entries = F.explode(F.map_entries("labels")).alias("e")
    if label in ("job", "service_name"):
        named = F.col("e.key") == "service.name"
        if label == "service_name":
            named = named | (F.col("e.key") == "service_name")
        else:
            named = named | (F.col("e.key") == "job")
    else:
        named = (F.col("e.key") != "service.name") & (F.replace(F.col("e.key"), F.lit("."), F.lit("_")) == label)
    return points.select(entries).where(named).select(F.col("e.value").alias("value")).distinct()


def series_list(samples: DataFrame, selectors: Sequence[tuple[str | None, Sequence[Matcher]]]) -> DataFrame:
    """Distinct label sets of all selectors (name, matchers)."""
    distinct = samples.select("labels_fp").distinct()
    found = [filter_samples(distinct, name, matchers) for name, matchers in selectors]
    return reduce(DataFrame.union, found).distinct()


def service_names(
    logs: DataFrame,
    spans: DataFrame | None = None,
    from_ns: int | None = None,
    to_ns: int | None = None,
) -> DataFrame:
    """Services of logs, and of spans if given."""
    out = logs.where(in_range("ts_unix_nano", from_ns, to_ns)).select(A.service().alias("service"))
    if spans is not None:
        out = out.union(spans.where(in_range("start_unix_nano", from_ns, to_ns)).select(A.service().alias("service")))
    return out.where(F.col("service") != "").distinct()


def service_versions(
    service: str,
    logs: DataFrame,
    spans: DataFrame | None = None,
    from_ns: int | None = None,
    to_ns: int | None = None,
) -> DataFrame:
    """Versions that occur on the same row as the service."""

    def versions(df: DataFrame, ts: str) -> DataFrame:
        cond = in_range(ts, from_ns, to_ns) & A.in_services([service])
        return df.where(cond).select(A.version().alias("version"))

    out = versions(logs, "ts_unix_nano")
    if spans is not None:
        out = out.union(versions(spans, "start_unix_nano"))
    return out.where(F.col("version") != "").distinct()
