"""Quantiles, counts and heat maps of histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telmora.functions import ieee
from telmora.functions import labels as L
from telmora.operators.ordered import exact_quantiles
from telmora.operators.selectors import Grid, forward_fill

# Default bucket bounds of a recorded histogram.
DEFAULT_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def le_value(text: Column) -> Column:
    return text.try_cast("double")


def le_text(bound: Column) -> Column:
    """Shortest text of a number: integral ones without decimals, tiny and huge ones as ``1E-05`` or
    ``1.5E+300``, ``+Inf`` for infinity."""
    plain = F.regexp_replace(bound.cast("string").try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    spread = F.regexp_replace(bound.cast("string"), r"\.0E", "E")
    spread = F.regexp_replace(F.regexp_replace(spread, "E(?=[0-9])", "E+"), r"E([+-])([0-9])$", "E$10$2")
    size = F.abs(bound)
    return (
        F.when(bound == F.lit(ieee.INF), F.lit("+Inf"))
        .when(bound == F.rint(bound), F.format_string("%.0f", bound))
        .when((size >= 1e-4) & (size < 1e15), plain)
        .otherwise(spread)
    )


def _buckets(vector: DataFrame) -> DataFrame:
    """Samples with their bound; ``le`` is null on samples without the label. These are not filtered here:
    a condition on the labels would be pushed below the aggregations and evaluated on every raw sample."""
    fp = F.col("labels_fp")
    return vector.select(
        L.without(fp, ["le", L.NAME]).alias("labels_fp"), "t_ms", le_value(L.label(fp, "le")).alias("le"), "value"
    )


def histogram_quantile(q: float, vector: DataFrame, interpolate_first: bool = False) -> DataFrame:
    """Quantile of cumulative buckets with labels ``le``.

    A rank inside the first bucket gives 0 (``interpolate_first`` interpolates from 0 as published
    PromQL does); inside the +Inf bucket the last finite bound; else linear. q < 0 → −Inf, q > 1 → +Inf,
    no observations → NaN. A group has one row per bucket bound, so its window is small.
    """
    group = Window.partitionBy("labels_fp", "t_ms")
    w = group.orderBy(F.col("le").asc_nulls_last(), "value")
    rows = (
        _buckets(vector)
        .withColumn("__rn", F.row_number().over(w))
        .withColumn("__lle", F.lag("le").over(w))
        .withColumn("__lc", F.lag("value").over(w))
        .withColumn("__total", F.max_by("value", "le").over(group))
    )
    rank = F.col("__total") * F.lit(float(q))
    reached = ieee.compare(">=", F.col("value"), rank) & F.col("le").isNotNull()
    if interpolate_first:
        in_first = F.when(F.col("le") > 0, F.col("le") * ieee.div(rank, F.col("value"))).otherwise(F.col("le"))
    else:
        in_first = F.lit(0.0)
    share = ieee.div(rank - F.col("__lc"), F.col("value") - F.col("__lc"))
    here = (
        F.when(F.col("__rn") == 1, F.when(F.col("le") == ieee.INF, F.lit(ieee.NAN)).otherwise(in_first))
        .when(F.col("le") == ieee.INF, F.col("__lle"))
        .when(F.col("value") == F.col("__lc"), F.col("le"))
        .otherwise(F.col("__lle") + (F.col("le") - F.col("__lle")) * share)
    )
    out = rows.withColumn("__here", here).groupBy("labels_fp", "t_ms").agg(
        F.min_by("__here", F.when(reached, F.col("__rn"))).alias("__v"),
        F.min(F.when(reached, F.col("__rn"))).alias("__hit"),
        F.max("le").alias("__max_le"),
        F.max("__total").alias("__total"),
    )
    value = F.when(F.col("__hit").isNull(), F.col("__max_le")).otherwise(F.col("__v"))
    if math.isnan(q):
        value = F.lit(ieee.NAN)
    elif q < 0:
        value = F.lit(-ieee.INF)
    elif q > 1:
        value = F.lit(ieee.INF)
    value = F.when(F.col("__total") == 0, F.lit(ieee.NAN)).otherwise(value)
    return out.where(F.col("__max_le").isNotNull()).select(
        "labels_fp", "t_ms", F.col("t_ms").alias("sample_ts_ms"), value.alias("value")
    )


def histogram_count(vector: DataFrame) -> DataFrame:
    """Count of the bucket with the greatest bound."""
    return (
        _buckets(vector)
        .groupBy("labels_fp", "t_ms")
        .agg(F.max_by("value", "le").alias("value"), F.max("le").alias("le"))
        .where(F.col("le").isNotNull())
        .select("labels_fp", "t_ms", F.col("t_ms").alias("sample_ts_ms"), "value")
    )


def _undefined(vector: DataFrame) -> DataFrame:
    return histogram_count(vector).withColumn("value", F.lit(ieee.NAN))


def histogram_sum(vector: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Sum of observations. Buckets alone do not hold it: NaN, unless the ``_sum`` samples are given."""
    if sums is None:
        return _undefined(vector)
    return sums.withColumn("labels_fp", L.without_name("labels_fp"))


def histogram_avg(vector: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Mean observation: NaN from buckets alone, ``_sum`` / count where the ``_sum`` samples are given."""
    if sums is None:
        return _undefined(vector)
    s = histogram_sum(vector, sums).select("labels_fp", "t_ms", F.col("value").alias("__s"))
    return (
        histogram_count(vector)
        .join(s, ["labels_fp", "t_ms"])
        .select("labels_fp", "t_ms", "sample_ts_ms", ieee.div(F.col("__s"), F.col("value")).alias("value"))
    )


def bucket_quantile(counts: Column, bounds: Column, q: float) -> Column:
    """Quantile of one histogram from per-bucket counts (N+1) and bounds (N).

    The first bucket starts at 0, the last one ends at the highest bound; an empty histogram gives 0.
    The quantile lies in the first bucket that holds observations and whose running count reaches the
    rank, at the rank's share of the way between the bucket's edges.
    """
    append = lambda done, c: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)) + c))
    running = F.aggregate(counts, F.array().cast("array<double>"), append)
    rank = F.try_element_at(running, F.lit(-1)) * F.lit(float(q))
    reaches = F.zip_with(counts, running, lambda c, upto: (c > 0) & (upto >= rank))
    bucket = F.array_position(reaches, F.lit(True)).cast("int")
    edges = F.concat(F.array(F.lit(0.0)), bounds)
    edge = lambda i: F.try_element_at(edges, F.least(i, F.size(edges)))
    count = F.try_element_at(counts, bucket)
    share = (rank - (F.try_element_at(running, bucket) - count)) / count
    inside = edge(bucket) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (edge(bucket + 1) - edge(bucket))
    filled = F.coalesce(F.try_element_at(running, F.lit(-1)) > 0, F.lit(False)) & bounds.isNotNull()
    return F.when(filled & (bucket > 0), inside).when(filled, F.try_element_at(edges, F.lit(-1))).otherwise(F.lit(0.0))


def raw_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact quantiles of raw values, position q·(n+1), clamped to the extremes."""
    return exact_quantiles(df, keys, value, quantiles, "r6")


def bucket_counts(value: Column, bounds: Sequence[float] = DEFAULT_BOUNDS) -> Column:
    """Aggregate: observations per bucket, each value in the first bucket with value ≤ bound."""
    counts = []
    for i in range(len(bounds) + 1):
        inside = value <= bounds[i] if i < len(bounds) else value > bounds[-1]
        if 0 < i < len(bounds):
            inside = inside & (value > bounds[i - 1])
        counts.append(F.count(F.when(inside, F.lit(1))))
    return F.array(*counts)


def heatmap(vector: DataFrame, grid: Grid) -> DataFrame:
    """Cumulative counts per ``le`` and step → counts per bucket ``(le, t_ms, value)``.

    Gaps are filled forward and decreases become 0.
    """
    per_le = _buckets(vector).groupBy("le", "t_ms").agg(F.max("value").alias("value")).where(F.col("le").isNotNull())
    filled = forward_fill(per_le, grid, ["le"])
    by_bound = Window.partitionBy("t_ms").orderBy("le")
    below = F.coalesce(F.lag("value").over(by_bound), F.lit(0.0))
    return filled.select("le", "t_ms", F.greatest(F.lit(0.0), F.col("value") - below).alias("value"))
