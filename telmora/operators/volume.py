"""How many spans, logs and metric points arrive per time bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telmora.operators.traces import in_range

SIGNALS = ("spans", "logs", "metrics")


def bucket_start(ts: Column, width: int) -> Column:
    return ts - ts % F.lit(width)


def _times(spans: DataFrame, logs: DataFrame, metrics: DataFrame) -> list[tuple[str, DataFrame]]:
    return [
        ("spans", spans.select(F.col("start_unix_nano").alias("ts"))),
        ("logs", logs.select(F.col("ts_unix_nano").alias("ts"))),
        ("metrics", metrics.select(F.col("ts_unix_nano").alias("ts"))),
    ]


def signal_volume(
    spans: DataFrame, logs: DataFrame, metrics: DataFrame, from_ns: int, to_ns: int, bucket_ns: int
) -> DataFrame:
    """Counts per bucket and signal; only buckets with any row, inclusive bounds."""
    if bucket_ns <= 0 or from_ns > to_ns:
        empty = spans.sparkSession.range(0).select(F.col("id").alias("bucket"))
        return empty.select("bucket", *[F.lit(0).cast("long").alias(s) for s in SIGNALS])
    parts = [
        df.where(in_range("ts", from_ns, to_ns)).select(
            bucket_start(F.col("ts"), bucket_ns).alias("bucket"),
            *[F.lit(1 if s == signal else 0).cast("long").alias(s) for s in SIGNALS],
        )
        for signal, df in _times(spans, logs, metrics)
    ]
    both = parts[0].union(parts[1]).union(parts[2])
    return both.groupBy("bucket").agg(*[F.sum(s).alias(s) for s in SIGNALS])


def dense_volume(volume: DataFrame, end_ns: int, bucket_ns: int, slots: int = 60) -> DataFrame:
    """The last ``slots`` buckets up to the one of ``end_ns``, missing ones as 0."""
    last = end_ns // bucket_ns
    frame = volume.sparkSession.range(slots).select(
        F.col("id").alias("slot"), ((F.col("id") + F.lit(last - slots + 1)) * F.lit(bucket_ns)).alias("bucket")
    )
    return frame.join(volume, "bucket", "left").select(
        "slot", "bucket", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in SIGNALS]
    )


def volume_lanes(dense: DataFrame, seconds: float = 3600.0) -> DataFrame:
    """Per signal: value of the last slot, peak (at least 1) and mean per second over the window."""
    lanes = F.explode(
        F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("n")) for s in SIGNALS])
    ).alias("lane")
    return (
        dense.select("slot", lanes)
        .groupBy(F.col("lane.signal").alias("signal"))
        .agg(
            F.max_by("lane.n", "slot").alias("last"),
            F.greatest(F.lit(1), F.max("lane.n")).alias("peak"),
            (F.sum("lane.n") / F.lit(float(seconds))).alias("per_second"),
        )
    )


def row_counts(**tables: DataFrame) -> DataFrame:
    """Row count per signal as ``signal, rows``."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("signal"), "rows") for k, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
