"""From stored metric points to exposed samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telmora.functions import labels as L
from telmora.functions import naming as N
from telmora.functions.integers import int_div
from telmora.operators.histogram import le_text
from telmora.operators.ordered import DEFAULT_CHUNK_MS, chunk_width, running_total
from telmora.schema import NS_PER_MS, TEMP_DELTA, TYPE_GAUGE, TYPE_HISTOGRAM, TYPE_SUM


def samples_from_columns(
    df: DataFrame,
    labels: Mapping[str, Column | str],
    ts_ms: Column,
    value: Column,
    is_delta: Column | bool = False,
) -> DataFrame:
    """Samples of a table whose labels are plain columns; no map is built per row."""
    flag = is_delta if isinstance(is_delta, Column) else F.lit(is_delta)
    return df.select(
        L.fingerprint_columns(labels).alias("labels_fp"),
        ts_ms.cast("long").alias("ts_ms"),
        value.cast("double").alias("value"),
        flag.alias("is_delta"),
    )


_AROUND = (L.NAME, "le")
_SEGMENTS = ("__p0", "__p1", "__p2")
_HISTOGRAM_SUFFIXES = ("_bucket", "_sum", "_count")


def render_labels(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """Render exposed labels ahead of ``expand_points``: on the series dictionary this is done once per
    series instead of once per point."""
    return L.render_exposed(rows, labels, _AROUND)


def expand_points(points: DataFrame, exposed: str | None = None) -> DataFrame:
    """Metric points (with a ``labels`` map of stored keys, or rendered labels) → samples.

    Counters and gauges appear once per exposed name; histograms as cumulative ``_bucket`` samples per
    bound (+Inf last), ``_sum`` and ``_count``. ``exposed`` restricts the result to one name: the scan to
    the stored names that can carry it, and the plan to the kinds of samples that can have it.
    """
    if exposed is not None:
        points = points.where(N.may_expose(F.col("name"), exposed))
    if _SEGMENTS[0] not in points.columns:
        points = render_labels(points)
    base = points.select(
        "name",
        "unit",
        "type",
        (F.col("temporality") == TEMP_DELTA).alias("is_delta"),
        int_div(F.col("ts_unix_nano"), NS_PER_MS).alias("ts_ms"),
        "value",
        "count",
        "sum",
        "bucket_counts",
        "explicit_bounds",
        *_SEGMENTS,
    )
    scalars = _expand_scalars(base.where(F.col("type").isin(TYPE_SUM, TYPE_GAUGE)), exposed)
    histograms = base.where(F.col("type") == TYPE_HISTOGRAM)
    for suffix in _HISTOGRAM_SUFFIXES:
        if exposed is None or exposed.endswith(suffix):
            scalars = scalars.unionByName(_expand_histograms(histograms, suffix, exposed))
    return scalars


def _fp(name: Column, le: Column | None = None) -> Column:
    return F.concat_ws(",", "__p0", L.named_pair(L.NAME, name), "__p1", *([le] if le is not None else []), "__p2")


def _expand_scalars(rows: DataFrame, exposed: str | None) -> DataFrame:
    name, unit = F.col("name"), F.col("unit")
    is_sum = F.col("type") == TYPE_SUM
    names = F.when(is_sum, N.counter_names(name, unit)).otherwise(N.gauge_names(name, unit))
    if exposed is not None:
        names = F.when(F.array_contains(names, exposed), F.array(F.lit(exposed)))
    # exploding also keeps later label filters from being pushed into the rendering of the labels
    return rows.withColumn("__n", F.explode(names)).select(
        _fp(F.col("__n")).alias("labels_fp"),
        "ts_ms",
        N.scale(unit, F.col("value")).alias("value"),
        (F.col("is_delta") & is_sum).alias("is_delta"),
    )


def _expand_histograms(rows: DataFrame, suffix: str, exposed: str | None) -> DataFrame:
    unit = F.col("unit")
    rows = rows.withColumn("__n", F.concat(N.base_name(F.col("name"), unit), F.lit(suffix)))
    if exposed is not None:
        rows = rows.where(F.col("__n") == exposed)
    if suffix != "_bucket":
        value = (
            N.scale(unit, F.coalesce("sum", F.lit(0.0)))
            if suffix == "_sum"
            else F.coalesce("count", F.lit(0)).cast("double")
        )
        return rows.select(_fp(F.col("__n")).alias("labels_fp"), "ts_ms", value.alias("value"), "is_delta")
    # running counts of one histogram, a few dozen buckets at most
    counts = F.col("bucket_counts")
    running = F.aggregate(
        counts,
        F.array().cast("array<bigint>"),
        lambda acc, c: F.array_append(acc, c + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))),
    )
    exploded = rows.select("__n", "unit", "ts_ms", "is_delta", "explicit_bounds", *_SEGMENTS, F.posexplode(running))
    bound = N.scale(unit, F.get("explicit_bounds", F.col("pos")))
    le = L.named_pair("le", F.coalesce(le_text(bound), F.lit("+Inf")))
    return exploded.select(
        _fp(F.col("__n"), le).alias("labels_fp"), "ts_ms", F.col("col").cast("double").alias("value"), "is_delta"
    )


def cumulate_delta(samples: DataFrame, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """Turn delta series into running totals that start at 0 before ``from_ms``.

    ``from_ms`` is the lower edge of the fetched window: instant ``t − lookback``; range query
    ``start − lookback − range``. A series counts as delta when its first sample is delta.
    """
    if from_ms is not None:
        samples = samples.where(F.col("ts_ms") >= from_ms)
    if to_ms is not None:
        samples = samples.where(F.col("ts_ms") <= to_ms)
    width = DEFAULT_CHUNK_MS if from_ms is None or to_ms is None else chunk_width(to_ms - from_ms)
    total = running_total(samples.where("is_delta"), ["labels_fp"], "ts_ms", "value", "__total", width)
    running = total.select("labels_fp", "ts_ms", F.col("__total").alias("value"), F.lit(False).alias("is_delta"))
    return samples.where(~F.col("is_delta")).unionByName(running)


def series_samples(
    points: DataFrame, exposed: str | None = None, from_ms: int | None = None, to_ms: int | None = None
) -> DataFrame:
    """Points → exposed samples with delta series made cumulative, ready for the selectors."""
    if from_ms is not None:
        points = points.where(F.col("ts_unix_nano") >= from_ms * NS_PER_MS)
    if to_ms is not None:
        points = points.where(F.col("ts_unix_nano") <= to_ms * NS_PER_MS)
    return cumulate_delta(expand_points(points, exposed), from_ms, to_ms)
