"""Calls, errors and durations of endpoints, rolled up to controllers and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telmora.functions import attributes as A
from telmora.operators.ordered import exact_quantiles
from telmora.schema import STATUS_ERROR

LEVELS = ("overall", "controller", "endpoint")
QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def endpoint_rollup(
    spans: DataFrame,
    controller_attr: str = "aspnetmvc.controller",
    action_attr: str = "aspnetmvc.action",
    route_attr: str = "http.route",
) -> DataFrame:
    """Statistics per level: overall, per controller, per (controller, action, route).

    Durations below 0 count as 0; percentiles are exact with position q·(n+1). Spans are first combined
    per endpoint (and duration), so names are derived and coarser levels built from few rows.
    """

    def attr(key: str) -> Column:
        return F.try_element_at(F.col("attrs"), F.lit(key))

    raw = spans.select(
        attr(controller_attr).alias("__c"),
        attr(action_attr).alias("__a"),
        attr(route_attr).alias("__r"),
        F.col("name").alias("__n"),
        F.greatest(F.col("duration_ns"), F.lit(0)).cast("double").alias("d"),
        F.when(F.col("status_code") == STATUS_ERROR, 1).otherwise(0).alias("e"),
    )
    named = ["__c", "__a", "__r", "__n"]
    keys = ["level", "controller", "action", "route"]
    totals = raw.groupBy(*named).agg(
        F.count(F.lit(1)).alias("w"), F.sum("e").alias("e"), F.sum("d").alias("s"), F.min("d").alias("lo"), F.max("d").alias("hi")
    )
    basics = (
        _levels(totals, "w", "e", "s", "lo", "hi")
        .groupBy(*keys)
        .agg(
            F.sum("w").alias("calls"),
            F.sum("e").alias("errors"),
            F.sum("s").alias("__sum"),
            F.min("lo").alias("min_ns"),
            F.max("hi").alias("max_ns"),
        )
    )
    durations = raw.groupBy(*named, "d").agg(F.count(F.lit(1)).alias("w"))
    percentiles = exact_quantiles(_levels(durations, "d", "w"), keys, "d", QUANTILES, "r6", "w").drop("n")
    renamed = percentiles.select(*[F.col(k).alias(f"__{k}") for k in keys], *QUANTILES)
    on = [basics[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    return basics.join(renamed, on).select(
        *keys, "calls", "errors", (F.col("__sum") / F.col("calls")).alias("avg_ns"), "min_ns", "max_ns", *QUANTILES
    )


def _levels(rows: DataFrame, *columns: str) -> DataFrame:
    """Each row at the three levels, with the names derived from attributes, route and span name."""
    named = rows.select(
        A.controller(F.col("__c"), F.col("__r")).alias("controller"),
        A.action(F.col("__a"), F.col("__r"), F.col("__n")).alias("action"),
        F.col("__r").alias("route"),
        *columns,
    )
    none = F.lit("")
    levels = F.array(
        _level("overall", none, none, none),
        _level("controller", F.col("controller"), none, none),
        _level("endpoint", F.col("controller"), F.col("action"), F.col("route")),
    )
    return named.select(F.explode(levels).alias("l"), *columns).select("l.*", *columns)


def _level(name: str, controller: Column, action: Column, route: Column) -> Column:
    return F.struct(
        F.lit(name).alias("level"), controller.alias("controller"), action.alias("action"), route.alias("route")
    )


def by_calls(rollup: DataFrame) -> DataFrame:
    return rollup.orderBy(F.col("calls").desc(), "level", "controller", "action", "route")


def tone(value: Column, warn: float, err: float) -> Column:
    return F.when(value >= err, "err").when(value >= warn, "warn").otherwise("ok")


def endpoint_kpis(rollup: DataFrame, window_ns: int) -> DataFrame:
    """Calls per second over the window, error percentage and severity tones."""
    share = F.col("errors") / F.col("calls")
    per_second = F.col("calls") / F.lit(window_ns / 1e9) if window_ns > 0 else F.lit(0.0)
    return (
        rollup.withColumn("calls_per_s", per_second)
        .withColumn("error_pct", share * 100)
        .withColumn("error_tone", tone(share, 0.01, 0.05))
        .withColumn("p95_tone", tone(F.col("p95"), 2e8, 1e9))
        .withColumn("max_tone", tone(F.col("max_ns"), 1e9, 2e9))
    )
