"""Dashboard panels as queries: what a panel shows, not how it is drawn."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telmora.functions import ieee
from telmora.functions import labels as L
from telmora.operators import histogram as H
from telmora.operators.logs import Filter, match_logs, search_logs
from telmora.operators.selectors import Grid
from telmora.runtime import checkpointed

Step = tuple[float | None, str]


def threshold_class(value: Column, steps: Sequence[Step]) -> Column:
    """Class of the last step with value ≥ its bound; the first step is the base. Colours count as
    ok (green), warn (yellow, orange), err (red) or accent (others, or no steps)."""
    if not steps:
        return F.lit("accent")
    out = F.lit(_colour_class(steps[0][1]))
    for bound, colour in steps:
        if bound is not None and bound == bound:
            out = F.when(ieee.compare(">=", value, bound), F.lit(_colour_class(colour))).otherwise(out)
    return out


# Colour names and codes behind the three classes.
_COLOURS = {"ok": ("green", "#37872d"), "warn": ("yellow", "orange", "#e0b400"), "err": ("red", "#c4162a")}


def _colour_class(colour: str) -> str:
    c = (colour or "").lower()
    for name, marks in _COLOURS.items():
        if any(m in c for m in marks if not m.startswith("#")) or c in marks:
            return name
    return "accent"


def timeseries(targets: Mapping[str, DataFrame]) -> DataFrame:
    """All targets of a panel in one frame with a ``target`` column."""
    return reduce(
        DataFrame.unionByName, [v.withColumn("target", F.lit(k)) for k, v in targets.items()]
    )


def finite(vector: DataFrame) -> DataFrame:
    return vector.where(ieee.is_finite(F.col("value")))


def single_stat(vector: DataFrame, steps: Sequence[Step] = ()) -> DataFrame:
    """Sum of all samples per evaluation time, with its threshold class (stat and gauge panels)."""
    return (
        vector.groupBy("t_ms")
        .agg(F.sum("value").alias("value"))
        .withColumn("class", threshold_class(F.col("value"), steps))
    )


def stat_grid(vector: DataFrame, steps: Sequence[Step] = ()) -> DataFrame:
    """Last finite value per series, greatest first."""
    return (
        finite(vector)
        .groupBy("labels_fp")
        .agg(F.max_by("value", "t_ms").alias("value"))
        .withColumn("class", threshold_class(F.col("value"), steps))
        .orderBy(F.col("value").desc(), "labels_fp")
    )


def label_keys(vector: DataFrame) -> DataFrame:
    """Distinct label names (``key``) of a vector without the metric name."""
    names = vector.select("labels_fp").distinct().select(F.explode(F.map_keys(L.labels_of("labels_fp"))).alias("key"))
    return names.distinct().where(F.col("key") != L.NAME)


def table(
    vector: DataFrame,
    keys: Sequence[str],
    rename: Mapping[str, str] | None = None,
    exclude: Iterable[str] = (),
) -> DataFrame:
    """One column per label plus ``Value``; columns can be renamed and (in any letter case) excluded.

    The columns are the labels ``keys``, as a query's columns are part of its plan; ``label_keys`` tells
    which there are. Absent labels are empty text.
    """
    rename = rename or {}
    dropped = {e.lower() for e in exclude}
    columns = [
        F.coalesce(L.label("labels_fp", k), F.lit("")).alias(rename.get(k) or k)
        for k in keys
        if k.lower() not in dropped
    ]
    if "value" not in dropped:
        columns.append(F.col("value").alias(rename.get("Value") or "Value"))
    return vector.select(*columns)


def bar_gauge(vector: DataFrame, steps: Sequence[Step] = ()) -> DataFrame:
    """Samples with the common maximum of their evaluation time (at least 0, and 1 if that is 0)."""
    vector = checkpointed(vector)  # read twice
    peak = vector.groupBy("t_ms").agg(ieee.max_skip_nan(F.col("value")).alias("peak"))
    return (
        vector.join(peak, "t_ms")
        .withColumn("max", F.when(F.col("peak") > 0, F.col("peak")).otherwise(F.lit(1.0)))
        .drop("peak")
        .withColumn("class", threshold_class(F.col("value"), steps))
    )


def pie(vector: DataFrame) -> DataFrame:
    """Samples with their share of the sum of their evaluation time."""
    vector = checkpointed(vector)  # read twice
    total = vector.groupBy("t_ms").agg(F.sum("value").alias("total"))
    return vector.join(total, "t_ms").withColumn("share", ieee.div(F.col("value"), F.col("total"))).drop("total")


def heatmap(vector: DataFrame, grid: Grid) -> DataFrame:
    return H.heatmap(vector, grid)


def logs_panel(
    logs: DataFrame,
    from_ns: int,
    to_ns: int,
    stream: Iterable[Filter] = (),
    lines: Sequence[tuple[str, str]] = (),
    ties: Sequence[str] = (),
    shown: int = 100,
) -> DataFrame:
    """The newest ``shown`` logs of the range that pass all filters, each with the number of the others.

    ``shown`` is the panel's page size; the filters see every log of the range.
    """
    matched = match_logs(search_logs(logs, from_ns=from_ns, to_ns=to_ns), stream, lines)
    newest_first = [F.col("ts_unix_nano").desc(), *ties]
    # a page of at most ``shown`` rows reaches this window
    page = matched.orderBy(*newest_first).limit(shown)
    page = page.withColumn("position", F.row_number().over(Window.partitionBy().orderBy(*newest_first)))
    others = matched.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - shown).alias("truncated"))
    return page.crossJoin(F.broadcast(others))  # one row
