"""Telemetry tables as Parquet folders partitioned by day: reading, appending, interning, indexing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telmora.functions import labels as L
from telmora.functions.integers import floor_div
from telmora.operators.traces import deduplicate_spans, in_range
from telmora.schema import NS_PER_S

DAY_NS = 86_400 * NS_PER_S


def day_of(ts_ns: Column) -> Column:
    """UTC day of a nanosecond time."""
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ts_ns, DAY_NS).cast("int"))


def scan(
    spark: SparkSession,
    path: str,
    ts: str,
    from_ns: int | None = None,
    to_ns: int | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Rows of a table inside an inclusive time range; the implied day range prunes partitions."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    epoch = F.lit("1970-01-01").cast("date")
    if from_ns is not None:
        df = df.where(F.col("day") >= F.date_add(epoch, from_ns // DAY_NS))
    if to_ns is not None:
        df = df.where(F.col("day") <= F.date_add(epoch, to_ns // DAY_NS))
    return df.where(in_range(ts, from_ns, to_ns))


def _append(df: DataFrame, path: str, ts: str, sort: Sequence[str]) -> None:
    # rows of a day spread over several tasks, sorted so that row-group statistics can skip
    (
        df.withColumn("day", day_of(F.col(ts)))
        .repartitionByRange("day", *sort)
        .sortWithinPartitions("day", *sort)
        .write.mode("append")
        .partitionBy("day")
        .parquet(path)
    )


def new_spans(spans: DataFrame, existing: DataFrame | None = None, arrival: str = "ingest_seq") -> DataFrame:
    """Spans to append: the first arrival per (trace_id, span_id) that is not stored yet."""
    first = deduplicate_spans(spans, arrival)
    if existing is None:
        return first
    return first.join(existing.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_anti")


def append_spans(spans: DataFrame, path: str, existing: DataFrame | None = None, arrival: str = "ingest_seq") -> None:
    fresh = new_spans(spans, existing, arrival)
    _append(fresh.drop(arrival), path, "start_unix_nano", ["trace_id", "start_unix_nano"])


def append_logs(logs: DataFrame, path: str) -> None:
    _append(logs, path, "ts_unix_nano", ["ts_unix_nano"])


def append_metrics(metrics: DataFrame, path: str) -> None:
    _append(metrics, path, "ts_unix_nano", ["name", "ts_unix_nano"])


def _rendered(points: DataFrame) -> DataFrame:
    """Add both label sets as text and the series key: a digest of name, labels and scope, so that no
    look-up is needed to assign it."""
    empty = F.create_map().cast("map<string,string>")
    scope = [F.coalesce(c, F.lit("")) for c in ("scope_name", "scope_version")]
    return (
        points.withColumn("__attrs", L.fingerprint(F.coalesce("attrs", empty)))
        .withColumn("__resource", L.fingerprint(F.coalesce("resource", empty)))
        .withColumn("series_id", F.md5(F.to_json(F.array("name", "__attrs", "__resource", *scope))))
    )


def intern_series(points: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split points into facts (with ``series_id``) and the series that are not known yet.

    Series are told apart by their text, which combines before the shuffle; the maps are rebuilt from the
    few distinct ones.
    """
    keyed = _rendered(points)
    series = (
        keyed.select("series_id", "name", "__attrs", "__resource", "scope_name", "scope_version")
        .distinct()
        .select(
            "series_id",
            "name",
            L.labels_of("__attrs").alias("attrs"),
            L.labels_of("__resource").alias("resource"),
            "scope_name",
            "scope_version",
        )
    )
    if known is not None:
        series = series.join(known.select("series_id"), "series_id", "left_anti")
    return keyed.drop("attrs", "resource", "scope_name", "scope_version", "__attrs", "__resource"), series


def resolve_series(metrics: DataFrame, series: DataFrame) -> DataFrame:
    """Facts with their ``labels`` map (resource overlaid by attributes); inline attributes, if the facts
    carry any, serve where the dictionary has no entry. Catalyst broadcasts the dictionary only while it
    is below its size threshold."""
    dim = series.select("series_id", L.merge(F.col("resource"), F.col("attrs")).alias("__dim"))
    joined = metrics.join(dim, "series_id", "left")
    inline = F.create_map().cast("map<string,string>")
    if "attrs" in metrics.columns:
        base = F.col("resource") if "resource" in metrics.columns else inline
        inline = L.merge(base, F.col("attrs"))
    return joined.withColumn("labels", F.coalesce("__dim", inline)).drop("__dim")


def fetch_points(
    metrics: DataFrame,
    series: DataFrame,
    names: Iterable[str],
    from_ns: int | None = None,
    to_ns: int | None = None,
    rollup: DataFrame | None = None,
) -> DataFrame:
    """Points of some metrics in a time range, raw and rolled up, with labels."""
    facts = metrics
    if rollup is not None:
        facts = facts.unionByName(
            rollup.withColumnRenamed("bucket_start", "ts_unix_nano").drop("resolution_seconds"),
            allowMissingColumns=True,
        )
    wanted = facts.where(F.col("name").isin(list(names)) & in_range("ts_unix_nano", from_ns, to_ns))
    return resolve_series(wanted, series)


def metric_series(
    metrics: DataFrame, name: str, from_ns: int | None = None, to_ns: int | None = None, limit: int | None = None, ties=()
) -> DataFrame:
    """The points of one metric in time order, or the earliest ``limit``; a blank name has none."""
    if not name or not name.strip():
        return metrics.limit(0)
    found = metrics.where((F.col("name") == name) & in_range("ts_unix_nano", from_ns, to_ns))
    ordered = found.orderBy("ts_unix_nano", *ties)
    return ordered if limit is None else ordered.limit(limit)


def attribute_index(df: DataFrame, row_id: str | Sequence[str]) -> DataFrame:
    """``row id, key, value`` for every non-null attribute of attrs and resource, without repeats.

    Repeats can only come from the two maps of one row, so they are removed inside the row.
    """
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    empty = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.array_union(
        F.coalesce(F.map_entries("attrs"), empty), F.coalesce(F.map_entries("resource"), empty)
    )
    return (
        df.select(*ids, F.explode(entries).alias("e"))
        .where(F.col("e.value").isNotNull())
        .select(*ids, F.col("e.key").alias("key"), F.col("e.value").alias("value"))
    )


def attributes_json(attrs: Column) -> Column:
    """JSON object of the non-empty attributes."""
    return F.to_json(L.drop_empty(attrs))


def numbers_json(values: Column) -> Column:
    """JSON array; non-finite numbers as ``"+Inf"``, ``"-Inf"``, ``"NaN"``."""
    text = F.transform(
        values,
        lambda v: F.when(F.isnan(v.cast("double")), F.lit('"NaN"'))
        .when(v.cast("double") == F.lit(float("inf")), F.lit('"+Inf"'))
        .when(v.cast("double") == F.lit(float("-inf")), F.lit('"-Inf"'))
        .otherwise(v.cast("string")),
    )
    return F.concat(F.lit("["), F.array_join(text, ","), F.lit("]"))


def events_json(events: Column) -> Column:
    return F.to_json(events)


def parse_attributes(text: Column) -> Column:
    """JSON object → map; malformed text → empty map; nulls are skipped."""
    parsed = F.from_json(text, "map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.map_filter(parsed, lambda _, v: v.isNotNull()), empty)


def parse_numbers(text: Column, type_: str = "double") -> Column:
    """JSON array → numbers; malformed text → empty array."""
    values = F.transform(F.from_json(text, "array<string>"), lambda v: v.try_cast(type_))
    return F.coalesce(values, F.array().cast(f"array<{type_}>"))


def add_arrays(a: Column, b: Column) -> Column:
    """Element-wise sum; on different lengths ``a`` stays; an empty or missing ``a`` yields ``b``."""
    return (
        F.when(b.isNull(), a)
        .when(a.isNull() | (F.size(a) == 0), b)
        .when(F.size(a) != F.size(b), a)
        .otherwise(F.zip_with(a, b, lambda x, y: x + y))
    )
