"""Selecting samples on a grid of evaluation times.

Both selections are arithmetic: a sample belongs to a contiguous run of grid steps, whose first and
last index follow from its time by integer division. No range join is involved.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telmora.functions import labels as L
from telmora.functions.integers import int_div
from telmora.schema import DEFAULT_LOOKBACK_MS

Matcher = tuple[str, str, str]


@dataclass(frozen=True)
class Grid:
    """Evaluation times start, start+step, … up to end (milliseconds, inclusive)."""

    start_ms: int
    end_ms: int
    step_ms: int

    def __post_init__(self) -> None:
        if self.step_ms <= 0 or self.end_ms < self.start_ms:
            raise ValueError("a grid needs step > 0 and end >= start")

    @staticmethod
    def instant(t_ms: int) -> Grid:
        return Grid(t_ms, t_ms, 1)

    @property
    def steps(self) -> int:
        return (self.end_ms - self.start_ms) // self.step_ms + 1

    @property
    def last_ms(self) -> int:
        return self.start_ms + (self.steps - 1) * self.step_ms

    def time(self, index: Column) -> Column:
        return F.lit(self.start_ms).cast("long") + index.cast("long") * F.lit(self.step_ms)

    def first_index(self, ts: Column) -> Column:
        """Index of the first step at or after ``ts``."""
        ahead = F.greatest(ts - F.lit(self.start_ms), F.lit(0).cast("long"))
        return int_div(ahead + F.lit(self.step_ms - 1), self.step_ms)

    def last_index(self, until: Column) -> Column:
        """Index of the last step at or before ``until`` (which must not lie before the start)."""
        return F.least(int_div(until - F.lit(self.start_ms), self.step_ms), F.lit(self.steps - 1).cast("long"))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.steps).select(self.time(F.col("id")).alias("t_ms"))

    def spread(self, df: DataFrame) -> DataFrame:
        """Repeat every row on all steps (a vector evaluated at one fixed instant)."""
        index = F.explode(F.sequence(F.lit(0), F.lit(self.steps - 1)))
        return df.withColumn("__i", index).withColumn("t_ms", self.time(F.col("__i"))).drop("__i")


def filter_samples(samples: DataFrame, name: str | None = None, matchers: Iterable[Matcher] = ()) -> DataFrame:
    """Keep samples of one exposed metric name that satisfy all label matchers."""
    if name:
        samples = samples.where(L.matches(F.col("labels_fp"), L.NAME, "=", name))
    for key, op, value in matchers:
        samples = samples.where(L.matches(F.col("labels_fp"), key, op, value))
    return samples


def instant_select(
    samples: DataFrame,
    grid: Grid,
    lookback_ms: int = DEFAULT_LOOKBACK_MS,
    offset_ms: int = 0,
    at_ms: int | None = None,
    name: str | None = None,
    matchers: Iterable[Matcher] = (),
) -> DataFrame:
    """Latest sample per series with ``t − lookback ≤ ts ≤ t`` for every step; keeps its time.

    Samples shrink to the latest per (series, first step that sees them) before anything is spread
    over steps; each survivor then stays visible until the next one takes over or it grows too old.
    """
    if at_ms is not None:
        fixed = instant_select(samples, Grid.instant(at_ms), lookback_ms, offset_ms, None, name, matchers)
        return grid.spread(fixed)
    shifted = F.col("ts_ms") + F.lit(offset_ms)
    latest = (
        filter_samples(samples, name, matchers)
        .where(F.col("ts_ms").between(grid.start_ms - lookback_ms - offset_ms, grid.last_ms - offset_ms))
        .withColumn("__first", grid.first_index(shifted))
        .groupBy("labels_fp", "__first")
        .agg(F.max(F.struct("ts_ms", "value")).alias("__s"))
    )
    # at most one row per grid step in each series
    successor = F.lead("__first").over(Window.partitionBy("labels_fp").orderBy("__first"))
    stale = grid.last_index(F.col("__s.ts_ms") + F.lit(offset_ms + lookback_ms))
    return (
        latest.withColumn("__last", F.least(stale, successor - 1))
        .where(F.col("__last") >= F.col("__first"))
        .withColumn("__i", F.explode(F.sequence("__first", "__last")))
        .select(
            "labels_fp",
            grid.time(F.col("__i")).alias("t_ms"),
            F.col("__s.ts_ms").alias("sample_ts_ms"),
            F.col("__s.value").alias("value"),
        )
    )


@dataclass(frozen=True)
class RangeVector:
    """Samples with ``t − range ≤ ts ≤ t`` for every step, kept unexpanded until a function needs them."""

    samples: DataFrame
    grid: Grid
    range_ms: int
    offset_ms: int = 0
    at_ms: int | None = None

    @property
    def eval_grid(self) -> Grid:
        return self.grid if self.at_ms is None else Grid.instant(self.at_ms)

    @property
    def window_ms(self) -> int:
        g = self.eval_grid
        return g.last_ms - g.start_ms + self.range_ms

    def visible(self) -> DataFrame:
        """``labels_fp, ts_ms, value`` of the samples inside the outermost window."""
        g = self.eval_grid
        inside = F.col("ts_ms").between(g.start_ms - self.range_ms - self.offset_ms, g.last_ms - self.offset_ms)
        return self.samples.where(inside).select("labels_fp", "ts_ms", "value")

    def with_steps(self, samples: DataFrame) -> DataFrame:
        """Add the first and last step index that sees each sample; others fall out."""
        g = self.eval_grid
        shifted = F.col("ts_ms") + F.lit(self.offset_ms)
        return (
            samples.withColumn("__a", g.first_index(shifted))
            .withColumn("__b", g.last_index(shifted + F.lit(self.range_ms)))
            .where(F.col("__a") <= F.col("__b"))
        )

    def located(self) -> DataFrame:
        return self.with_steps(self.visible())

    def rows(self) -> DataFrame:
        """One row per step and sample: ``labels_fp, t_ms, ts_ms, value``."""
        out = (
            self.located()
            .withColumn("__i", F.explode(F.sequence("__a", "__b")))
            .select("labels_fp", self.eval_grid.time(F.col("__i")).alias("t_ms"), "ts_ms", "value")
        )
        return self.on_grid(out)

    def on_grid(self, df: DataFrame) -> DataFrame:
        return df if self.at_ms is None else self.grid.spread(df)

    def evaluation_ms(self) -> Column:
        """Effective evaluation time of a row with column ``t_ms`` (before spreading)."""
        return F.col("t_ms") - F.lit(self.offset_ms)


def range_select(
    samples: DataFrame,
    grid: Grid,
    range_ms: int,
    offset_ms: int = 0,
    at_ms: int | None = None,
    name: str | None = None,
    matchers: Iterable[Matcher] = (),
) -> RangeVector:
    return RangeVector(filter_samples(samples, name, matchers), grid, range_ms, offset_ms, at_ms)


def with_offset(rv: RangeVector, offset_ms: int) -> RangeVector:
    return replace(rv, offset_ms=offset_ms)


def with_at(rv: RangeVector, at_ms: int) -> RangeVector:
    return replace(rv, at_ms=at_ms)


def forward_fill(vector: DataFrame, grid: Grid, keys: Iterable[str] = ("labels_fp",)) -> DataFrame:
    """Values of each series at all steps of ``grid`` that occur in ``vector``; 0 before its first value.

    A value is repeated at the steps up to the series' next one, so only neighbours of a series meet.
    """
    keys = list(keys)
    seen = vector.groupBy(*keys, "t_ms").agg(F.max("value").alias("value"))
    by_time = Window.partitionBy(*keys).orderBy("t_ms")
    end = F.lit(grid.last_ms).cast("long")
    step = F.lit(grid.step_ms).cast("long")
    until = F.coalesce(F.lead("t_ms").over(by_time) - step, end)
    since = F.when(F.row_number().over(by_time) == 1, F.lit(grid.start_ms).cast("long")).otherwise(F.col("t_ms"))
    spread = seen.select(*keys, F.col("t_ms").alias("__own"), "value", F.sequence(since, until, step).alias("__steps"))
    filled = spread.select(*keys, "__own", "value", F.explode("__steps").alias("t_ms"))
    value = F.when(F.col("t_ms") < F.col("__own"), F.lit(0.0)).otherwise(F.col("value"))
    return filled.join(vector.select("t_ms").distinct(), "t_ms", "left_semi").select(*keys, "t_ms", value.alias("value"))
