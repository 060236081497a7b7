"""Functions over range vectors.

Samples that are seen by exactly the same steps share one (first step, last step) pair. Mergeable
functions aggregate per such class first and spread the few class rows over the steps. Where a range covers
many steps, time is cut into blocks of one range: the window of a step is then the end of one block and the
beginning of the next, which running aggregates give, so the work follows the number of samples and steps and
not their product. The metric name is dropped from the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telmora.functions import ieee
from telmora.functions import labels as L
from telmora.functions.integers import floor_div
from telmora.operators.ordered import CHUNK_COLUMN, exact_quantiles, with_previous
from telmora.operators.selectors import Grid, RangeVector

# Up to this many steps per sample, samples are spread directly.
_DIRECT_STEPS = 3
# From this many steps per sample on, windows are put together from blocks.
_BLOCK_STEPS = 8
# Length of a chunk of trailing frames, in ranges: one sample in so many is sent twice.
CHUNK_RANGES = 8


def _vector(rv: RangeVector, df: DataFrame, value: Column) -> DataFrame:
    """``df`` has labels_fp and the step index ``__i``."""
    t = rv.eval_grid.time(F.col("__i"))
    out = df.select(
        L.without_name("labels_fp").alias("labels_fp"),
        t.alias("t_ms"),
        t.alias("sample_ts_ms"),
        value.cast("double").alias("value"),
    )
    return rv.on_grid(out)


def _spread(df: DataFrame) -> DataFrame:
    return df.withColumn("__i", F.explode(F.sequence("__a", "__b")))


def _by_class(rv: RangeVector) -> bool:
    return rv.eval_grid.steps > 1 and rv.range_ms // rv.eval_grid.step_ms + 1 > _DIRECT_STEPS


def _steps_per_range(rv: RangeVector) -> int:
    """Steps that see a sample, or one less."""
    return rv.range_ms // rv.eval_grid.step_ms


def _celled(rv: RangeVector) -> DataFrame:
    """Visible samples, shuffled by series and block, with the first step ``__c`` that sees them (negative before
    the grid), their block ``__k`` of as many steps as a range has, and whether one step more sees them."""
    g, width = rv.eval_grid, _steps_per_range(rv)
    since = F.col("ts_ms") + F.lit(rv.offset_ms - g.start_ms)
    cell = floor_div(since + F.lit(g.step_ms - 1), g.step_ms)
    rows = rv.visible().withColumn("__c", cell).withColumn("__k", floor_div(F.col("__c"), width))
    long = since + F.lit(rv.range_ms) >= (F.col("__c") + F.lit(width)) * F.lit(g.step_ms)
    return rows.withColumn("__long", long).repartition("labels_fp", "__k")


def _slide(rv: RangeVector, rows: DataFrame, running: dict[str, Column], longs: DataFrame) -> DataFrame:
    """Up to three parts per (series, step) that together hold the step's window once.

    Step ``i`` sees the cells from ``i - width + 1`` to ``i``: the beginning of its own block and the end of the
    block before. ``longs`` (``labels_fp, __c`` and the columns of ``running``) adds the samples of cell
    ``i - width`` that reach one step further.
    """
    width = _steps_per_range(rv)
    last_step = F.lit(rv.eval_grid.steps - 1).cast("long")
    start = F.col("__k") * F.lit(width)

    def part(order: Column, first: Column, last: Column) -> DataFrame:
        w = Window.partitionBy("labels_fp", "__k").orderBy(order)
        frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = rows.select(
            "labels_fp", "__k", "__c", F.lead("__c").over(w).alias("__next"),
            *[agg.over(frame).alias(name) for name, agg in running.items()],
        )
        whole = seen.where(F.col("__next").isNull() | (F.col("__next") != F.col("__c")))
        return whole.select("labels_fp", "__k", first.alias("__a"), last.alias("__b"), *running)

    begin = part(F.col("__c").asc(), F.col("__c"), F.coalesce(F.col("__next"), start + width) - 1)
    following = F.greatest(F.coalesce(F.col("__next"), start), start) + width
    end = part(F.col("__c").desc(), following, F.col("__c") + (width - 1))
    more = longs.select(
        "labels_fp", F.col("__k"), (F.col("__c") + width).alias("__a"), (F.col("__c") + width).alias("__b"), *running
    )
    parts = begin.unionByName(end).unionByName(more)
    clipped = parts.withColumn("__a", F.greatest("__a", F.lit(0).cast("long"))).withColumn("__b", F.least("__b", last_step))
    return _spread(clipped.where(F.col("__a") <= F.col("__b"))).drop("__a", "__b")


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def _mergeable(rv: RangeVector, partial: dict[str, Column], merge: dict[str, Column], value: Column) -> DataFrame:
    if rv.eval_grid.steps > 1 and _steps_per_range(rv) >= _BLOCK_STEPS:
        cells = _celled(rv).groupBy("labels_fp", "__k", "__c", "__long").agg(*_named(partial))
        whole = cells.groupBy("labels_fp", "__k", "__c").agg(*_named(merge))
        rows = _slide(rv, whole, merge, cells.where("__long")).groupBy("labels_fp", "__i").agg(*_named(merge))
    elif _by_class(rv):
        rows = rv.located().groupBy("labels_fp", "__a", "__b").agg(*_named(partial))
        rows = _spread(rows).groupBy("labels_fp", "__i").agg(*_named(merge))
    else:
        rows = _spread(rv.located()).groupBy("labels_fp", "__i").agg(*_named(partial))
    return _vector(rv, rows, value)


def sum_over_time(rv: RangeVector) -> DataFrame:
    return _mergeable(rv, {"s": F.sum("value")}, {"s": F.sum("s")}, F.col("s"))


def count_over_time(rv: RangeVector) -> DataFrame:
    return _mergeable(rv, {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, F.col("n"))


def present_over_time(rv: RangeVector) -> DataFrame:
    """The number of points, like ``count_over_time`` (published PromQL gives 1)."""
    return count_over_time(rv)


def avg_over_time(rv: RangeVector) -> DataFrame:
    partial = {"s": F.sum("value"), "n": F.count(F.lit(1))}
    return _mergeable(rv, partial, {"s": F.sum("s"), "n": F.sum("n")}, F.col("s") / F.col("n"))


def max_over_time(rv: RangeVector) -> DataFrame:
    return _mergeable(rv, {"m": ieee.max_skip_nan(F.col("value"))}, {"m": F.max("m")}, F.col("m"))


def min_over_time(rv: RangeVector) -> DataFrame:
    return _mergeable(rv, {"m": ieee.min_skip_nan(F.col("value"))}, {"m": F.min("m")}, F.col("m"))


def last_over_time(rv: RangeVector) -> DataFrame:
    newest = F.max(F.struct("ts_ms", "value"))
    return _mergeable(rv, {"l": newest}, {"l": F.max("l")}, F.col("l.value"))


def _moment_aggregates() -> dict[str, Column]:
    """Count, means and centred second moments of time (x, seconds) and value, and the earliest and latest x."""
    return {
        "n": F.count(F.lit(1)), "mx": F.avg("x"), "my": F.avg("value"), "vx": F.var_pop("x"),
        "vxy": F.covar_pop("x", "value"), "vy": F.var_pop("value"), "lo": F.min("x"), "hi": F.max("x"),
    }


def _total(over: Callable[[Column], Column]) -> Column:
    return F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + over(p))


def _moments(rv: RangeVector) -> DataFrame:
    """``n, mx, my, vx, vxy, vy, lo, hi`` per (series, step); x counts from the step, shifted back by the offset.

    Running moments are updated sample by sample around their mean, and the (up to three) parts of a window are
    merged by their means, so no large sums are subtracted from each other.
    """
    g = rv.eval_grid
    shifted = F.col("ts_ms") + F.lit(rv.offset_ms)
    if not _by_class(rv):
        rows = _spread(rv.located()).withColumn("x", (shifted - g.time(F.col("__i"))) / F.lit(1000.0))
        return rows.groupBy("labels_fp", "__i").agg(*_named(_moment_aggregates()))
    # inside a block, time counts from the block's first step
    block_ms = _steps_per_range(rv) * g.step_ms
    origin = F.lit(g.start_ms).cast("long") + F.col("__k") * F.lit(block_ms)
    rows = _celled(rv).withColumn("x", (shifted - origin) / F.lit(1000.0))
    longs = rows.where("__long").groupBy("labels_fp", "__k", "__c").agg(*_named(_moment_aggregates()))
    spread = _slide(rv, rows, _moment_aggregates(), longs)
    move = (origin - g.time(F.col("__i"))) / F.lit(1000.0)
    for name in ("mx", "lo", "hi"):
        spread = spread.withColumn(name, F.col(name) + move)
    merged = spread.groupBy("labels_fp", "__i").agg(F.collect_list(F.struct(*_moment_aggregates())).alias("parts"))
    n = _total(lambda p: p["n"])
    means = merged.select(
        "labels_fp", "__i", "parts", n.alias("n"),
        (_total(lambda p: p["n"] * p["mx"]) / n).alias("mx"), (_total(lambda p: p["n"] * p["my"]) / n).alias("my"),
    )
    dx, dy = (lambda p: p["mx"] - F.col("mx")), (lambda p: p["my"] - F.col("my"))
    return means.select(
        "labels_fp", "__i", "n", "mx", "my",
        (_total(lambda p: p["n"] * (p["vx"] + dx(p) * dx(p))) / F.col("n")).alias("vx"),
        (_total(lambda p: p["n"] * (p["vxy"] + dx(p) * dy(p))) / F.col("n")).alias("vxy"),
        (_total(lambda p: p["n"] * (p["vy"] + dy(p) * dy(p))) / F.col("n")).alias("vy"),
        F.array_min("parts.lo").alias("lo"), F.array_max("parts.hi").alias("hi"),
    )


def _slope() -> Column:
    """Least-squares slope; 0 without spread in time."""
    return F.when(F.col("hi") > F.col("lo"), F.col("vxy") / F.col("vx")).otherwise(F.lit(0.0))


def stddev_over_time(rv: RangeVector) -> DataFrame:
    return _vector(rv, _moments(rv), F.sqrt("vy"))


def stdvar_over_time(rv: RangeVector) -> DataFrame:
    return _vector(rv, _moments(rv), F.col("vy"))


def deriv(rv: RangeVector) -> DataFrame:
    """Least-squares slope per second; 0 with fewer than two points or no spread in time."""
    return _vector(rv, _moments(rv), _slope())


def predict_linear(rv: RangeVector, seconds: float) -> DataFrame:
    """Value of the least-squares line ``seconds`` after the evaluation time; needs two points."""
    # x is relative to the step; the evaluation time is the step itself, shifted back by the offset
    line = F.col("my") + _slope() * (F.lit(float(seconds)) + F.lit(rv.offset_ms / 1000.0) - F.col("mx"))
    return _vector(rv, _moments(rv).where("n >= 2"), line)


def quantile_over_time(q: float, rv: RangeVector) -> DataFrame:
    """Exact quantile, position q·(n−1); q is clamped to [0, 1]."""
    if _by_class(rv):
        counted = rv.located().groupBy("labels_fp", "__a", "__b", "value").agg(F.count(F.lit(1)).alias("w"))
    else:
        counted = rv.located().withColumn("w", F.lit(1))
    out = exact_quantiles(_spread(counted), ["labels_fp", "__i"], "value", {"v": q}, "r7", "w")
    return _vector(rv, out, F.col("v"))


def absent_over_time(rv: RangeVector) -> DataFrame:
    """One unlabelled 1 on each step at which no series has any sample."""
    present = _spread(rv.located().select("__a", "__b").distinct()).select("__i").distinct()
    spark = rv.samples.sparkSession
    steps = spark.range(rv.eval_grid.steps).withColumnRenamed("id", "__i")
    missing = steps.join(present, "__i", "left_anti").withColumn("labels_fp", F.lit(""))
    return _vector(rv, missing, F.lit(1.0))


def _first_index_seeing(grid: Grid, ts: Column, rv: RangeVector) -> Column:
    return grid.last_index(ts + F.lit(rv.offset_ms + rv.range_ms))


def _paired(
    rv: RangeVector,
    point_aggs: Callable[[Column], list[Column]],
    point_merge: list[Column],
    pair_aggs: Callable[[Column], list[Column]],
    pair_merge: list[Column],
) -> DataFrame:
    """Aggregate points and neighbouring pairs per (series, step).

    A pair is inside the window of a step when its later point is visible and its earlier point is
    not older than t − range: it is seen from the first step of the later to the last step of the
    earlier point. ``point_aggs`` and ``pair_aggs`` receive the condition under which a row counts.
    """
    g = rv.eval_grid
    rows = rv.with_steps(
        with_previous(rv.visible(), ["labels_fp"], "ts_ms", "value", rv.window_ms, rv.range_ms)
    )
    oldest = F.col("prev_ts") >= F.lit(g.start_ms - rv.offset_ms - rv.range_ms)
    rows = rows.withColumn(
        "__pb", F.when(oldest, _first_index_seeing(g, F.col("prev_ts"), rv))
    )
    if not _by_class(rv):
        spread = _spread(rows).withColumn(
            "__pair", F.coalesce(F.col("__i") <= F.col("__pb"), F.lit(False))
        )
        always = F.lit(True)
        return spread.groupBy("labels_fp", "__i").agg(*point_aggs(always), *pair_aggs(F.col("__pair")))
    same = F.coalesce(F.col("__pb") == F.col("__b"), F.lit(False))
    own = F.struct(F.col("__b").alias("b"), F.lit(True).alias("point"), same.alias("pair"))
    crossing = F.struct(F.col("__pb").alias("b"), F.lit(False).alias("point"), F.lit(True).alias("pair"))
    partly = F.coalesce((F.col("__pb") < F.col("__b")) & (F.col("__pb") >= F.col("__a")), F.lit(False))
    classed = (
        rows.withColumn("__role", F.explode(F.when(partly, F.array(own, crossing)).otherwise(F.array(own))))
        .withColumn("__b", F.col("__role.b"))
        .groupBy("labels_fp", CHUNK_COLUMN, "__a", "__b")
        .agg(*point_aggs(F.col("__role.point")), *pair_aggs(F.col("__role.pair")))
    )
    return _spread(classed).groupBy("labels_fp", "__i").agg(*point_merge, *pair_merge)


def _reset(pair: Column) -> Column:
    fell = pair & ieee.compare("<", F.col("value"), F.col("prev_value"))
    return F.when(fell, F.col("prev_value"))


def _ends(cond: Column) -> list[Column]:
    """First and last value of a window; the times are unique once ties are reduced to one row."""
    first = cond & ~F.coalesce(F.col("prev_ts") == F.col("ts_ms"), F.lit(False))
    last = cond & F.col("last_of_ts")
    return [
        F.min(F.when(first, F.col("ts_ms"))).alias("ft"),
        F.min_by("value", F.when(first, F.col("ts_ms"))).alias("fv"),
        F.max(F.when(last, F.col("ts_ms"))).alias("lt"),
        F.max_by("value", F.when(last, F.col("ts_ms"))).alias("lv"),
    ]


def _merge_ends() -> list[Column]:
    return [F.min_by("fv", "ft").alias("fv"), F.max_by("lv", "lt").alias("lv")]


def _increase(rv: RangeVector) -> tuple[DataFrame, Column]:
    out = _paired(
        rv,
        _ends,
        _merge_ends(),
        lambda pair: [F.sum(_reset(pair)).alias("resets")],
        [F.sum("resets").alias("resets")],
    )
    return out, F.col("lv") - F.col("fv") + F.coalesce(F.col("resets"), F.lit(0.0))


def increase(rv: RangeVector) -> DataFrame:
    """Last − first, plus the value before each decrease; no extrapolation to the window edges."""
    return _vector(rv, *_increase(rv))


def rate(rv: RangeVector) -> DataFrame:
    """``increase`` divided by the full range in seconds."""
    df, value = _increase(rv)
    per_second = value / F.lit(rv.range_ms / 1000.0) if rv.range_ms > 0 else F.lit(ieee.NAN)
    return _vector(rv, df, per_second)


def delta(rv: RangeVector) -> DataFrame:
    """Same as ``increase``: decreases count as resets (published PromQL gives last − first)."""
    return increase(rv)


def changes(rv: RangeVector) -> DataFrame:
    def count(pair: Column) -> list[Column]:
        differs = pair & ieee.compare("!=", F.col("value"), F.col("prev_value"))
        return [F.sum(F.when(differs, 1).otherwise(0)).alias("c")]

    out = _paired(rv, lambda _: [], [], count, [F.sum("c").alias("c")])
    return _vector(rv, out, F.col("c"))


def resets(rv: RangeVector) -> DataFrame:
    def count(pair: Column) -> list[Column]:
        return [F.count(_reset(pair)).alias("c")]

    out = _paired(rv, lambda _: [], [], count, [F.sum("c").alias("c")])
    return _vector(rv, out, F.col("c"))


def _last_two(rv: RangeVector) -> DataFrame:
    """Last value and time, with the point before it where that lies inside the window."""

    def last(cond: Column) -> list[Column]:
        at = F.when(cond & F.col("last_of_ts"), F.col("ts_ms"))
        return [
            F.max(at).alias("lt"),
            F.max_by("value", at).alias("lv"),
            F.max_by("prev_value", at).alias("pv"),
            F.max_by("prev_ts", at).alias("pt"),
        ]

    merge = [
        F.max("lt").alias("lt"),
        F.max_by("lv", "lt").alias("lv"),
        F.max_by("pv", "lt").alias("pv"),
        F.max_by("pt", "lt").alias("pt"),
    ]
    out = _paired(rv, last, merge, lambda _: [], [])
    edge = rv.eval_grid.time(F.col("__i")) - F.lit(rv.offset_ms + rv.range_ms)
    return out.withColumn("two", F.coalesce(F.col("pt") >= edge, F.lit(False)))


def irate(rv: RangeVector) -> DataFrame:
    """Per-second rate between the last two points; after a reset the last value counts alone.

    NaN with fewer than two points or without time between them.
    """
    out = _last_two(rv)
    step = F.col("lv") - F.col("pv")
    gain = F.when(ieee.compare("<", step, 0.0), F.col("lv")).otherwise(step)
    seconds = (F.col("lt") - F.col("pt")) / F.lit(1000.0)
    value = F.when(F.col("two") & (seconds > 0), gain / seconds).otherwise(F.lit(ieee.NAN))
    return _vector(rv, out, value)


def idelta(rv: RangeVector) -> DataFrame:
    """Last − previous; a single point yields its value."""
    value = F.when(F.col("two"), F.col("lv") - F.col("pv")).otherwise(F.col("lv"))
    return _vector(rv, _last_two(rv), value)


def frame_over_time(samples: DataFrame, range_ms: int, aggregate: Callable[[Column], Column]) -> DataFrame:
    """``aggregate`` of the values in ``[ts − range, ts]`` at every sample's own time, as ``labels_fp, t_ms, value``.

    Equal times of a series see each other, and each of their rows stays. A series is cut into chunks of
    time; a chunk begins with the last range of the one before it, so no series meets in one task and
    rows are shuffled once. Samples without a time fall out.
    """
    width = max(CHUNK_RANGES * range_ms, 1)
    own = floor_div(F.col("ts_ms"), width)
    until = floor_div(F.col("ts_ms") + F.lit(range_ms), width)  # the next chunk, where that sees the sample
    rows = samples.where("ts_ms is not null").select(
        "labels_fp", "ts_ms", "value", own.alias("__own"), F.explode(F.sequence(own, until)).alias("__chunk")
    )
    frame = Window.partitionBy("labels_fp", "__chunk").orderBy("ts_ms").rangeBetween(-range_ms, 0)
    seen = rows.withColumn("__value", aggregate(F.col("value")).over(frame)).where(F.col("__own") == F.col("__chunk"))
    return seen.select("labels_fp", F.col("ts_ms").alias("t_ms"), F.col("__value").alias("value"))
