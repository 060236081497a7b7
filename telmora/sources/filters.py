"""Exclusion of telemetry before it is written."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Span attributes that may carry a route.
ROUTE_KEYS = ("http.route", "http.target", "url.path", "aspnetmvc.route")


def _starts_with_any(value: Column, prefixes: Iterable[str]) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        if p:
            cond = cond | value.startswith(p)
    return F.coalesce(cond, F.lit(False))


def _attr(key: str) -> Column:
    return F.try_element_at(F.col("attrs"), F.lit(key))


def exclude_span_routes(spans: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Drop spans with a route attribute under one of the prefixes."""
    cond = F.lit(False)
    for key in ROUTE_KEYS:
        cond = cond | _starts_with_any(_attr(key), prefixes)
    return spans.where(~cond)


def exclude_metric_routes(points: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    return points.where(~_starts_with_any(_attr("http.route"), prefixes))


def exclude_log_categories(logs: DataFrame, prefixes: Sequence[str], category: str = "scope_name") -> DataFrame:
    """Drop logs whose category starts with one of the prefixes (case-sensitive)."""
    return logs.where(~_starts_with_any(F.col(category), prefixes))
