"""Key figures from counters and histograms: call rate, error ratio, availability, latency."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telmora.operators.endpoints import tone
from telmora.operators.histogram import bucket_quantile
from telmora.operators.ordered import ranked, with_previous
from telmora.schema import NS_PER_S, TYPE_HISTOGRAM


def neighbour_rate(points: DataFrame, keys: Sequence[str], window_ns: int, clamp: bool = True) -> DataFrame:
    """Counter points ``(keys, ts_unix_nano, value)`` → per-second rate at each point but the first.

    Decreases give 0 (``clamp``), points at the same time as their predecessor give none.
    """
    src = points.select(*keys, F.col("ts_unix_nano"), F.col("value").cast("double").alias("value"))
    rows = with_previous(src, keys, "ts_unix_nano", "value", window_ns)
    gain = F.col("value") - F.col("prev_value")
    if clamp:
        gain = F.when(gain < 0, F.lit(0.0)).otherwise(gain)
    elapsed = F.col("ts_unix_nano") - F.col("prev_ts")
    return rows.where(elapsed >= 1).select(
        *keys, "ts_unix_nano", (gain / (elapsed / F.lit(float(NS_PER_S)))).alias("rate")
    )


def error_ratio(requests: DataFrame, errors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Position-wise errors / requests of two rate series (of each key), in [0, 1]; 0 without requests.

    Both are numbered in time order; surplus points of the longer one have no partner. Null keys are
    a key of their own.
    """
    r = _numbered(requests, keys, "ts_unix_nano", "rate").withColumnRenamed("rate", "req")
    e = _numbered(errors, keys, "__ts", "err").withColumnsRenamed({k: f"__e_{k}" for k in keys} | {"position": "__position"})
    same = F.col("position") == F.col("__position")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__e_{k}"))
    ratio = F.when(F.col("req") == 0, F.lit(0.0)).otherwise(F.col("err") / F.when(F.col("req") != 0, F.col("req")))
    return r.join(e, same).select(
        *keys, "ts_unix_nano", "position", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)).alias("ratio")
    )


def _numbered(rates: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    rows = rates.select(
        F.lit(1).alias("__one"), *keys, F.col("ts_unix_nano").alias(ts), F.col("rate").alias(value)
    )
    return ranked(rows, ["__one", *keys], [ts, value], "position").drop("__one")


def last_value(value: str = "value", ts: str = "ts_unix_nano") -> Column:
    """Aggregate: value at the latest time, 0 without rows."""
    return F.coalesce(F.max(F.struct(ts, value)).getField(value), F.lit(0.0))


def reducers(value: str = "value", ts: str = "ts_unix_nano") -> list[Column]:
    """Aggregates max, last, sum and mean of a series, each 0 without rows."""
    zero = F.lit(0.0)
    return [
        F.coalesce(F.max(value), zero).alias("max"),
        last_value(value, ts).alias("last"),
        F.coalesce(F.sum(value), zero).alias("sum"),
        F.coalesce(F.avg(value), zero).alias("mean"),
    ]


def availability(requests: DataFrame, errors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """1 − last errors / last requests (of each key) within [0, 1]; 1 when nothing is known."""
    both = _tagged(requests, keys, "requests").unionByName(_tagged(errors, keys, "errors"))
    return both.groupBy(*keys).agg(_last("requests"), _last("errors")).withColumn("availability", _up())


def _tagged(points: DataFrame, keys: Sequence[str], kind: str, value: str = "value") -> DataFrame:
    return points.select(
        *keys, F.lit(kind).alias("kind"), "ts_unix_nano", F.col(value).cast("double").alias("value")
    )


def _last(kind: str, name: str | None = None) -> Column:
    """Aggregate over tagged points: value at the latest time, 0 without rows."""
    newest = F.max(F.when(F.col("kind") == kind, F.struct("ts_unix_nano", "value")))
    return F.coalesce(newest.getField("value"), F.lit(0.0)).alias(name or kind)


def _up() -> Column:
    share = F.col("errors") / F.when(F.col("requests") > 0, F.col("requests"))
    up = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - share))
    return F.when(share.isNull(), F.lit(1.0)).otherwise(up)


def latency_series(points: DataFrame, quantiles: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles of each histogram point on its own; other points and empty histograms fall out."""
    counts, bounds = F.col("bucket_counts"), F.col("explicit_bounds")
    return points.where((F.col("type") == TYPE_HISTOGRAM) & (F.size(counts) > 0)).select(
        *keys, "ts_unix_nano", *[bucket_quantile(counts, bounds, q).alias(n) for n, q in quantiles.items()]
    )


def latest_histogram(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bucket counts and bounds of the newest point per key."""
    newest = F.max(F.struct("ts_unix_nano", "bucket_counts", "explicit_bounds")).alias("h")
    return (
        points.where(F.col("type") == TYPE_HISTOGRAM)
        .groupBy(*keys)
        .agg(newest)
        .select(*keys, "h.ts_unix_nano", "h.bucket_counts", "h.explicit_bounds")
    )


def split_series(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of points, time range and last value per attribute set of one metric."""
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.min("ts_unix_nano").alias("first_ts"),
        F.max("ts_unix_nano").alias("last_ts"),
        last_value().alias("last_value"),
    )


def dashboard(
    requests: DataFrame,
    errors: DataFrame,
    durations: DataFrame,
    window_ns: int,
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row (for each key) with calls per second (last and peak), error ratio, availability, latest
    p50/p95/p99 and their tones, from counter points of requests and errors and histogram points of
    durations. A key of any of the three has a row."""
    req_rate = neighbour_rate(requests, keys, window_ns)
    err_rate = neighbour_rate(errors, keys, window_ns)
    lat = latency_series(durations, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, keys)
    tagged = [
        _tagged(requests, keys, "requests"),
        _tagged(errors, keys, "errors"),
        _tagged(req_rate, keys, "calls", "rate"),
        _tagged(error_ratio(req_rate, err_rate, keys), keys, "ratio", "ratio"),
        *[_tagged(lat, keys, p, p) for p in ("p50", "p95", "p99")],
    ]
    peak = F.max(F.when(F.col("kind") == "calls", F.col("value")))
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy(*keys)
        .agg(
            _last("calls", "calls_per_s"),
            F.coalesce(peak, F.lit(0.0)).alias("peak_calls_per_s"),
            _last("ratio", "error_ratio"),
            *[_last(kind) for kind in ("requests", "errors", "p50", "p95", "p99")],
        )
        .select(
            *keys, "calls_per_s", "peak_calls_per_s", "error_ratio", "requests", "errors",
            _up().alias("availability"), "p50", "p95", "p99",
        )
        .withColumn("error_tone", tone(F.col("error_ratio"), 0.01, 0.05))
        .withColumn(
            "availability_tone",
            F.when(F.col("availability") < 0.9, "err").when(F.col("availability") < 0.99, "warn").otherwise("ok"),
        )
        .withColumn("p95_tone", tone(F.col("p95"), 0.2, 1.0))
    )


