"""Jobs that keep the tables small: roll-up, retention, eviction, orphan clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telmora.operators.ordered import ranked
from telmora.schema import NS_PER_S, TEMP_DELTA, TYPE_HISTOGRAM, TYPE_SUM

DAY_NS = 86_400 * NS_PER_S
_KEYS = ["series_id", "name", "type", "temporality", "unit"]
ROLLUP_COLUMNS = [
    *_KEYS,
    "bucket_start",
    "resolution_seconds",
    "value",
    "count",
    "sum",
    "min",
    "max",
    "bucket_counts",
    "explicit_bounds",
]


def rollup_boundary(now_ns: int, raw_days: float, resolution_s: int = 60) -> int:
    """Points before this time lie in complete buckets older than ``raw_days``."""
    cutoff = (now_ns // NS_PER_S - int(raw_days * 86_400)) * NS_PER_S
    res = resolution_s * NS_PER_S
    return max(0, cutoff // res * res)


def roll_up(metrics: DataFrame, boundary_ns: int, resolution_s: int = 60) -> DataFrame:
    """One row per series and bucket for points before ``boundary_ns``.

    Gauges and cumulative sums keep the last value, delta sums add up; delta histograms add counts,
    sums and buckets element by element, others keep the last point; min and max always combine.
    Everything but the bucket arrays is an algebraic aggregate, and the arrays are added per position.
    """
    res = resolution_s * NS_PER_S
    ts = F.col("ts_unix_nano")
    rows = metrics.where(ts < boundary_ns).withColumn("bucket_start", ts - ts % F.lit(res))
    return _combine(rows, ts).withColumn("resolution_seconds", F.lit(resolution_s)).select(*ROLLUP_COLUMNS)


def merge_rollups(rollups: DataFrame) -> DataFrame:
    """Combine several roll-up rows of one bucket, as they arise from late points, into one.

    Later rows count as newer; their order is given by ``written_at``.
    """
    merged = _combine(rollups, F.col("written_at"), [*_KEYS, "bucket_start", "resolution_seconds"])
    return merged.select(*ROLLUP_COLUMNS)


def _combine(rows: DataFrame, order: Column, keys: list[str] | None = None) -> DataFrame:
    keys = keys or [*_KEYS, "bucket_start"]
    rows = rows.withColumn("__o", order)
    hist = F.col("type") == TYPE_HISTOGRAM
    delta = F.col("temporality") == TEMP_DELTA
    last = F.max(F.struct("__o", "value", "sum", "count", "bucket_counts"))
    basic = rows.groupBy(*keys).agg(
        last.alias("__last"),
        F.sum("value").alias("__value"),
        F.sum(F.coalesce("sum", F.lit(0.0))).alias("__sum"),
        F.sum(F.coalesce("count", F.lit(0))).alias("__count"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.min_by("explicit_bounds", F.when(F.col("explicit_bounds").isNotNull(), F.col("__o"))).alias(
            "explicit_bounds"
        ),
    )
    added = _added_buckets(rows.where(hist & delta), keys)
    on = [basic[k].eqNullSafe(added[f"__k_{k}"]) for k in keys]
    both = basic.join(added, on, "left")
    return both.select(*keys, *rolled_values())


def rolled_values() -> list[Column]:
    """The values of a roll-up row by its type, from the last point (``__last``), the totals (``__value``,
    ``__sum``, ``__count``), the added ``__buckets`` and the columns that combine alike for all types."""
    hist = F.col("type") == TYPE_HISTOGRAM
    delta = F.col("temporality") == TEMP_DELTA
    return [
        F.when(hist, F.when(delta, F.col("__sum")).otherwise(F.coalesce("__last.sum", F.lit(0.0))))
        .when((F.col("type") == TYPE_SUM) & delta, F.col("__value"))
        .otherwise(F.col("__last.value"))
        .alias("value"),
        F.when(hist, F.when(delta, F.col("__count")).otherwise(F.coalesce("__last.count", F.lit(0)))).alias("count"),
        F.when(hist, F.when(delta, F.col("__sum")).otherwise(F.coalesce("__last.sum", F.lit(0.0)))).alias("sum"),
        "min",
        "max",
        F.when(hist, F.when(delta, F.col("__buckets")).otherwise(F.col("__last.bucket_counts"))).alias(
            "bucket_counts"
        ),
        F.when(hist, F.col("explicit_bounds")).alias("explicit_bounds"),
    ]


def _added_buckets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise sum of ``bucket_counts``; arrays of another length than the earliest are left out."""
    sized = rows.where(F.size("bucket_counts") > 0).withColumn("__len", F.size("bucket_counts"))
    per_position = (
        sized.select(*keys, "__len", "__o", F.posexplode("bucket_counts").alias("pos", "c"))
        .groupBy(*keys, "__len", "pos")
        .agg(F.sum("c").alias("c"), F.min("__o").alias("__o"))
    )
    # one entry per bucket of the histogram
    arrays = per_position.groupBy(*keys, "__len").agg(
        F.min("__o").alias("__o"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda e: e["c"]).alias("__buckets"),
    )
    chosen = arrays.groupBy(*keys).agg(F.min_by("__buckets", F.struct("__o", "__len")).alias("__buckets"))
    return chosen.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__buckets")


def raw_remainder(metrics: DataFrame, boundary_ns: int) -> DataFrame:
    """Raw points that stay after ``roll_up``."""
    return metrics.where(F.col("ts_unix_nano") >= boundary_ns)


def rollup_as_points(rollup: DataFrame) -> DataFrame:
    return rollup.withColumnRenamed("bucket_start", "ts_unix_nano")


def effective_days(signal_days: int | None, default_days: int) -> int:
    """Retention of a signal: its own setting, else the global one; 0 keeps everything."""
    return default_days if signal_days is None else max(0, signal_days)


def retention_cutoff(now_ns: int, days: int) -> int | None:
    if days <= 0:
        return None
    return (now_ns // NS_PER_S - days * 86_400) * NS_PER_S


def retain(df: DataFrame, ts: str, now_ns: int, days: int) -> DataFrame:
    """Rows not older than ``days``. On tables partitioned by day the filter prunes whole partitions."""
    cutoff = retention_cutoff(now_ns, days)
    if cutoff is None:
        return df
    kept = df.where(F.col(ts) >= cutoff)
    if "day" in df.columns:
        first_day = F.date_add(F.lit("1970-01-01").cast("date"), cutoff // DAY_NS)
        kept = kept.where(F.col("day") >= first_day)
    return kept


def retention_counts(now_ns: int, **signals: tuple[DataFrame, str, int]) -> DataFrame:
    """``signal, kept, deleted`` of a retention run; one pass per signal."""
    out = None
    for signal, (df, ts, days) in signals.items():
        cutoff = retention_cutoff(now_ns, days)
        old = F.lit(False) if cutoff is None else F.col(ts) < cutoff
        part = df.agg(
            F.count(F.when(~old, 1)).alias("kept"), F.count(F.when(old, 1)).alias("deleted")
        ).select(F.lit(signal).alias("signal"), "kept", "deleted")
        out = part if out is None else out.union(part)
    return out


def oldest_rows(signals: DataFrame, k: int, ties: tuple[str, ...] = ("signal", "row_key")) -> DataFrame:
    """The ``k`` oldest rows of all signals; ``signals``: ``signal, row_key, ts``."""
    return signals.orderBy("ts", *ties).limit(k)


def evict_to_budget(rows: DataFrame, max_bytes: int, fill: float = 0.9) -> DataFrame:
    """Rows that stay when the oldest are evicted until at most ``fill`` of ``max_bytes`` is used.

    ``rows``: ``signal, row_key, ts`` (ns), ``est_bytes``. Nothing is evicted while the total is within
    ``max_bytes``. Totals per day, then per minute of one day, find the minute in which the budget ends;
    only its rows are put in order. The driver sees one number per day and per minute.
    """
    total = rows.agg(F.sum("est_bytes").alias("b")).first()["b"] or 0
    if total <= max_bytes:
        return rows
    budget = int(max_bytes * fill)
    day, used = _budget_bucket(rows, DAY_NS, budget)
    if day is None:
        return rows
    inside = rows.where((F.col("ts") >= day) & (F.col("ts") < day + DAY_NS))
    minute_ns = 60 * NS_PER_S
    minute, in_day = _budget_bucket(inside, minute_ns, budget - used)
    left = budget - used - in_day
    newer = rows.where(F.col("ts") >= minute + minute_ns)
    edge = inside.where((F.col("ts") >= minute) & (F.col("ts") < minute + minute_ns))
    newest_first = edge.withColumn("__age", -F.col("ts"))
    placed = ranked(newest_first, [], ["__age", "signal", "row_key"], "__used", "est_bytes")
    return newer.unionByName(placed.where(F.col("__used") <= left).drop("__age", "__used"))


def _budget_bucket(rows: DataFrame, width: int, budget: int) -> tuple[int | None, int]:
    """Start of the bucket, counted from the newest, in which the budget runs out, and the bytes used by
    the newer ones."""
    start = F.col("ts") - F.col("ts") % F.lit(width)
    totals = rows.groupBy(start.alias("s")).agg(F.sum("est_bytes").alias("b")).orderBy(F.col("s").desc())
    used = 0
    for r in totals.toLocalIterator():
        if used + r["b"] > budget:
            return r["s"], used
        used += r["b"]
    return None, used


def used_series(series: DataFrame, *facts: DataFrame) -> DataFrame:
    """Series that still have points."""
    ids = None
    for f in facts:
        part = f.select("series_id")
        ids = part if ids is None else ids.union(part)
    return series.join(ids.distinct(), "series_id", "left_semi")


def orphan_series(series: DataFrame, *facts: DataFrame) -> DataFrame:
    """Series without points."""
    ids = None
    for f in facts:
        part = f.select("series_id")
        ids = part if ids is None else ids.union(part)
    return series.join(ids.distinct(), "series_id", "left_anti")

