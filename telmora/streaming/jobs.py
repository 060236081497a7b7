"""Structured Streaming forms of ingest, de-duplication, roll-up and volume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telmora.functions.integers import floor_div
from telmora.plans.maintenance import ROLLUP_COLUMNS, rolled_values
from telmora.schema import TEMP_DELTA, TYPE_GAUGE, TYPE_HISTOGRAM, TYPE_SUM
from telmora.sources.tables import day_of

_SERIES = ["series_id", "name", "type", "temporality", "unit"]


def event_time(ts_ns: Column) -> Column:
    """Timestamp (microseconds) of a nanosecond time, for watermarks and windows."""
    return F.timestamp_micros(floor_div(ts_ns, 1000))


def ingest(
    rows: DataFrame, path: str, checkpoint: str, ts: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append streamed rows to a Parquet table partitioned by day."""
    return (
        rows.withColumn("day", day_of(F.col(ts)))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("day")
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def first_spans(spans: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (trace_id, span_id) once; copies may arrive up to ``delay`` apart."""
    return (
        spans.withColumn("event_time", event_time(F.col("start_unix_nano")))
        .withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(["trace_id", "span_id"])
    )


def rollup(metrics: DataFrame, raw_delay: str = "7 days", resolution: str = "60 seconds") -> DataFrame:
    """Closed buckets of gauges and sums, and the totals of histograms, in append mode. A point later
    than the watermark is dropped and counted by Spark. ``rollup_full`` keeps distributions too."""
    delta = F.col("temporality") == TEMP_DELTA
    newest = F.max_by(F.col("value"), F.col("ts_unix_nano"))
    keep_last = (F.col("type") == TYPE_GAUGE) | ((F.col("type") == TYPE_SUM) & ~delta) | (
        (F.col("type") == TYPE_HISTOGRAM) & ~delta
    )
    return (
        metrics.withColumn("event_time", event_time(F.col("ts_unix_nano")))
        .withWatermark("event_time", raw_delay)
        .groupBy(F.window("event_time", resolution), *_SERIES)
        .agg(
            newest.alias("__last"),
            F.sum("value").alias("__sum"),
            F.sum("count").alias("__count"),
            F.max_by("count", "ts_unix_nano").alias("__last_count"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
        )
        .select(
            *_SERIES,
            (F.unix_micros(F.col("window.start")) * 1000).alias("bucket_start"),
            F.when(keep_last, F.col("__last")).otherwise(F.col("__sum")).alias("value"),
            F.when(keep_last, F.col("__last_count")).otherwise(F.col("__count")).alias("count"),
            "min",
            "max",
        )
    )


def rollup_full(metrics: DataFrame, raw_delay: str = "7 days", resolution_s: int = 60) -> DataFrame:
    """Closed buckets with the columns and values of the batch roll-up, bucket arrays included, in append mode.

    Arrays are added position by position in a first stateful aggregation, so its state is one number for
    each position and not the points of a bucket; a second one puts the positions of a series together.
    Values that belong to a whole point travel with its first position. Arrays of another length than
    the earliest are left out.
    """
    size = f"{resolution_s} seconds"
    o = F.col("ts_unix_nano")
    arrays = (F.col("type") == TYPE_HISTOGRAM) & (F.col("temporality") == TEMP_DELTA)
    points = metrics.withColumns({
        "event_time": event_time(o),
        "__len": F.when(arrays, F.size("bucket_counts")),
        "__entries": F.when(arrays, F.col("bucket_counts")),
    })
    one_each = points.withWatermark("event_time", raw_delay).select(
        "*", F.posexplode_outer("__entries").alias("__pos", "__entry")
    )
    whole = F.coalesce(F.col("__pos"), F.lit(0)) == 0

    def once(c: Column | str) -> Column:
        return F.when(whole, F.col(c) if isinstance(c, str) else c)

    positions = one_each.groupBy(F.window("event_time", size), *_SERIES, "__len", "__pos").agg(
        F.max(once(F.struct(o.alias("o"), "value", "sum", "count", "bucket_counts"))).alias("__last"),
        F.sum(once("value")).alias("__value"),
        F.sum(once(F.coalesce("sum", F.lit(0.0)))).alias("__sum"),
        F.sum(once(F.coalesce("count", F.lit(0)))).alias("__count"),
        F.min(once("min")).alias("min"),
        F.max(once("max")).alias("max"),
        F.min(F.when(whole & F.col("explicit_bounds").isNotNull(), F.struct(o.alias("o"), "explicit_bounds"))).alias("__bounds"),
        F.min(o).alias("__o"),
        F.sum("__entry").alias("__entry"),
    )
    entry = F.when(F.col("__pos").isNotNull(), F.struct("__o", "__len", "__pos", "__entry"))
    series = positions.groupBy(F.window(F.window_time("window"), size), *_SERIES).agg(
        F.max("__last").alias("__last"),
        *[F.sum(c).alias(c) for c in ("__value", "__sum", "__count")],
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.min("__bounds").alias("__bounds"),
        F.array_sort(F.collect_list(entry)).alias("__all"),  # one entry for each length and position
    )
    length = F.get("__all", F.lit(0))["__len"]
    chosen = F.array_sort(F.transform(F.filter("__all", lambda e: e["__len"] == length), lambda e: F.struct(e["__pos"], e["__entry"])))
    return series.select(
        *_SERIES,
        (F.unix_micros(F.col("window.start")) * 1000).alias("bucket_start"),
        F.col("__last"), "__value", "__sum", "__count", "min", "max",
        F.col("__bounds.explicit_bounds").alias("explicit_bounds"),
        F.when(F.size("__all") > 0, F.transform(chosen, lambda e: e["__entry"])).alias("__buckets"),
        F.lit(resolution_s).alias("resolution_seconds"),
    ).select(*_SERIES, "bucket_start", "resolution_seconds", *rolled_values()).select(*ROLLUP_COLUMNS)


def volume(
    spans: DataFrame, logs: DataFrame, metrics: DataFrame, delay: str = "10 minutes", bucket: str = "1 minute"
) -> DataFrame:
    """Rows per bucket and signal, for update mode."""
    signals = {
        "spans": spans.select(F.col("start_unix_nano").alias("ts")),
        "logs": logs.select(F.col("ts_unix_nano").alias("ts")),
        "metrics": metrics.select(F.col("ts_unix_nano").alias("ts")),
    }
    both = None
    for name, df in signals.items():
        part = df.select(event_time(F.col("ts")).alias("event_time"), F.lit(name).alias("signal"))
        both = part if both is None else both.union(part)
    return (
        both.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", bucket))
        .agg(*[F.count(F.when(F.col("signal") == s, 1)).alias(s) for s in signals])
        .select((F.unix_micros(F.col("window.start")) * 1000).alias("bucket"), *signals)
    )


def sliding_over_time(
    samples: DataFrame, range_: str, step: str, aggregate: Callable[[str], Column], delay: str = "10 minutes"
) -> DataFrame:
    """A mergeable ``*_over_time`` on sliding windows. A window is half-open [start, end), unlike the
    inclusive batch selection; ``t_ms`` is its end."""
    return (
        samples.withColumn("event_time", F.timestamp_millis("ts_ms"))
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", range_, step), "labels_fp")
        .agg(aggregate("value").alias("value"))
        .select("labels_fp", (F.unix_micros(F.col("window.end")) / 1000).cast("long").alias("t_ms"), "value")
    )
