"""Aggregation of instant vectors across series."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telmora.functions import ieee
from telmora.functions import labels as L
from telmora.operators.ordered import exact_quantiles, top_per_group


def group_labels(by: Iterable[str] | None = None, without: Iterable[str] | None = None) -> Column:
    """Labels of the group a sample falls into: ``by`` keeps the listed labels that exist, ``without``
    drops the listed ones and the name, neither puts everything into one unlabelled group."""
    if by is not None and without is not None:
        raise ValueError("give either by or without")
    if by is not None:
        return L.only("labels_fp", by)
    if without is not None:
        return L.without("labels_fp", [*without, L.NAME])
    return F.lit("")


def _aggregate(vector: DataFrame, agg: Column, by, without) -> DataFrame:
    return (
        vector.select(group_labels(by, without).alias("labels_fp"), "t_ms", "value")
        .groupBy("labels_fp", "t_ms")
        .agg(agg.cast("double").alias("value"))
        .select("labels_fp", "t_ms", F.col("t_ms").alias("sample_ts_ms"), "value")
    )


def sum_(vector: DataFrame, by=None, without=None) -> DataFrame:
    return _aggregate(vector, F.sum("value"), by, without)


def avg(vector: DataFrame, by=None, without=None) -> DataFrame:
    return _aggregate(vector, F.avg("value"), by, without)


def max_(vector: DataFrame, by=None, without=None) -> DataFrame:
    return _aggregate(vector, ieee.max_skip_nan(F.col("value")), by, without)


def min_(vector: DataFrame, by=None, without=None) -> DataFrame:
    return _aggregate(vector, ieee.min_skip_nan(F.col("value")), by, without)


def count(vector: DataFrame, by=None, without=None) -> DataFrame:
    return _aggregate(vector, F.count(F.lit(1)), by, without)


def group(vector: DataFrame, by=None, without=None) -> DataFrame:
    return _aggregate(vector, F.max(F.lit(1.0)), by, without)


def stddev(vector: DataFrame, by=None, without=None) -> DataFrame:
    return _aggregate(vector, F.stddev_pop("value"), by, without)


def stdvar(vector: DataFrame, by=None, without=None) -> DataFrame:
    return _aggregate(vector, F.var_pop("value"), by, without)


def quantile(q: float, vector: DataFrame, by=None, without=None) -> DataFrame:
    """Exact quantile, position q·(n−1); q is clamped to [0, 1]."""
    grouped = vector.select(group_labels(by, without).alias("labels_fp"), "t_ms", "value")
    out = exact_quantiles(grouped, ["labels_fp", "t_ms"], "value", {"v": q}, "r7")
    return out.select("labels_fp", "t_ms", F.col("t_ms").alias("sample_ts_ms"), F.col("v").alias("value"))


def count_values(label: str, vector: DataFrame) -> DataFrame:
    """Number of samples per value *of that label*; samples without it do not count.

    (Published PromQL counts sample values instead.)
    """
    return (
        vector.where(L.has_label(F.col("labels_fp"), label))
        .select(L.only("labels_fp", [label]).alias("labels_fp"), "t_ms")
        .groupBy("labels_fp", "t_ms")
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .select("labels_fp", "t_ms", F.col("t_ms").alias("sample_ts_ms"), "value")
    )


def _pick(k: float, vector: DataFrame, order: list[Column], by, without) -> DataFrame:
    k = round(k)
    grouped = vector.withColumn("__group", group_labels(by, without))
    if k <= 0:
        return vector.limit(0)
    return top_per_group(
        grouped, ["t_ms", "__group"], [*order, F.col("labels_fp").asc()], k, "labels_fp"
    ).drop("__group")


def topk(k: float, vector: DataFrame, by=None, without=None) -> DataFrame:
    """The k largest samples per group, with their own labels; ties by labels."""
    return _pick(k, vector, ieee.descending(F.col("value")), by, without)


def bottomk(k: float, vector: DataFrame, by=None, without=None) -> DataFrame:
    return _pick(k, vector, ieee.ascending(F.col("value")), by, without)
