"""Request rate, errors and duration derived from server spans, as metric points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telmora.operators.histogram import DEFAULT_BOUNDS, bucket_counts
from telmora.schema import (
    KIND_SERVER,
    NS_PER_S,
    STATUS_ERROR,
    TEMP_DELTA,
    TYPE_HISTOGRAM,
    TYPE_SUM,
)

# Names of the derived metrics and their labels.
REQUESTS = "http_requests"
DURATION = "http_request_duration"
LABEL_NAMES = ("service.name", "http.route", "http.method", "http.response.status_code")
#: Width of a time bucket unless the caller gives another.
BUCKET_NS = 60 * NS_PER_S


def _attr(column: str, key: str) -> Column:
    return F.try_element_at(F.col(column), F.lit(key))


def request_labels() -> dict[str, Column]:
    """Label columns of a span with their defaults."""
    status = _attr("attrs", "http.response.status_code")
    by_code = F.when(F.col("status_code") >= STATUS_ERROR, "500").otherwise("200")
    return {
        "service.name": F.coalesce(_attr("resource", "service.name"), F.lit("unknown")),
        "http.route": F.coalesce(_attr("attrs", "http.route"), F.lit("")),
        "http.method": F.coalesce(F.nullif(_attr("attrs", "http.method"), F.lit("")), F.lit("GET")),
        "http.response.status_code": F.coalesce(F.nullif(status, F.lit("")), by_code),
    }


def _server_spans(spans: DataFrame, from_ns: int | None, to_ns: int | None) -> DataFrame:
    spans = spans.where(F.col("kind") == KIND_SERVER)
    if from_ns is not None:
        spans = spans.where(F.col("start_unix_nano") >= from_ns)
    if to_ns is not None:
        spans = spans.where(F.col("start_unix_nano") <= to_ns)
    return spans


def red_groups(spans: DataFrame, from_ns: int, to_ns: int, width_ns: int = BUCKET_NS) -> DataFrame:
    """Requests, total seconds and bucket counts per label set and time bucket."""
    start = F.col("start_unix_nano") - F.col("start_unix_nano") % F.lit(width_ns)
    seconds = F.col("duration_ns") / F.lit(float(NS_PER_S))
    keyed = _server_spans(spans, from_ns, to_ns).select(
        *[c.alias(k.replace(".", "_")) for k, c in request_labels().items()],
        start.alias("bucket_start"),
        seconds.alias("__s"),
    )
    return keyed.groupBy(*[k.replace(".", "_") for k in LABEL_NAMES], "bucket_start").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("__s").alias("seconds"),
        bucket_counts(F.col("__s"), DEFAULT_BOUNDS).alias("bucket_counts"),
    )


def red_points(spans: DataFrame, from_ns: int, to_ns: int, width_ns: int = BUCKET_NS) -> DataFrame:
    """Metric points of both derived metrics, delta temporality, with a ``labels`` map."""
    groups = red_groups(spans, from_ns, to_ns, width_ns)
    entries = []
    for k in LABEL_NAMES:
        entries += [F.lit(k), F.col(k.replace(".", "_"))]
    null = F.lit(None)
    common = {
        "temporality": F.lit(TEMP_DELTA),
        "ts_unix_nano": F.col("bucket_start"),
        "labels": F.create_map(*entries),
    }
    point = F.struct(
        F.lit(REQUESTS).alias("name"),
        F.lit("1").alias("unit"),
        F.lit(TYPE_SUM).alias("type"),
        F.col("requests").cast("double").alias("value"),
        null.cast("long").alias("count"),
        null.cast("double").alias("sum"),
        null.cast("array<bigint>").alias("bucket_counts"),
        null.cast("array<double>").alias("explicit_bounds"),
    )
    hist = F.struct(
        F.lit(DURATION).alias("name"),
        F.lit("s").alias("unit"),
        F.lit(TYPE_HISTOGRAM).alias("type"),
        F.col("seconds").alias("value"),
        F.col("requests").alias("count"),
        F.col("seconds").alias("sum"),
        F.col("bucket_counts"),
        F.array(*[F.lit(b) for b in DEFAULT_BOUNDS]).alias("explicit_bounds"),
    )
    return groups.withColumn("__p", F.explode(F.array(point, hist))).select(
        "__p.name",
        "__p.unit",
        "__p.type",
        common["temporality"].alias("temporality"),
        common["ts_unix_nano"].alias("ts_unix_nano"),
        "__p.value",
        "__p.count",
        "__p.sum",
        F.when(F.col("__p.type") == TYPE_HISTOGRAM, F.lit(0.0)).alias("min"),
        F.when(F.col("__p.type") == TYPE_HISTOGRAM, F.lit(0.0)).alias("max"),
        "__p.bucket_counts",
        "__p.explicit_bounds",
        common["labels"].alias("labels"),
    )


def red_label_names() -> list[str]:
    return list(LABEL_NAMES)


def red_label_values(
    spans: DataFrame, key: str, from_ns: int | None = None, to_ns: int | None = None
) -> DataFrame:
    """Distinct non-empty values of one label, with the same defaults as the points."""
    known = request_labels()
    value = known.get(key, _attr("attrs", key))
    if key == "http.route":
        value = _attr("attrs", "http.route")
    return (
        _server_spans(spans, from_ns, to_ns)
        .select(value.alias("value"))
        .where(F.col("value") != "")
        .distinct()
    )


def composite_points(
    stored: DataFrame, spans: DataFrame, from_ns: int, to_ns: int, width_ns: int = BUCKET_NS
) -> DataFrame:
    """Stored points together with the derived ones; a filter on ``name`` reaches both branches."""
    derived = red_points(spans, from_ns, to_ns, width_ns)
    own = stored.where(~F.col("name").isin(REQUESTS, DURATION))
    return own.unionByName(derived, allowMissingColumns=True)

