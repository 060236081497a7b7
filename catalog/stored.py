"""Jobs that change stored tables; each query writes its tables to a folder beside the checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import jobs
from catalog import views as V
from catalog.registry import query, rounded
from catalog.views import DAY_MS, sql
from telmora.functions import labels as L
from telmora.plans import table_jobs as J
from telmora.runtime import scratch_folder
from telmora.sources import tables as TB

_RES_S = 6 * 3600
_RAW_DAYS = 10
_BOUNDARY = J.M.rollup_boundary(jobs._NOW, _RAW_DAYS, _RES_S)
_W = f"us * 1000 // {_RES_S * 10**9} * {_RES_S * 10**9}"
_CUTOFF = J.M.retention_cutoff(jobs._NOW, 7)


def _rolled(spark, sf) -> DataFrame:
    """Half of the points come late, after the days of the others were rolled up."""
    facts, series = TB.intern_series(V.metric_points(spark, sf).where("name in ('app.level', 'app.cents')"))
    folder = scratch_folder(spark)
    late = F.col("event_id") % 2 == 1
    for part in (facts.where(~late), facts.where(late)):
        TB.append_metrics(part, f"{folder}/raw")
        J.roll_up_table(spark, f"{folder}/raw", f"{folder}/rollup", jobs._NOW, _RAW_DAYS, _RES_S)
    rolled = TB.resolve_series(spark.read.parquet(f"{folder}/rollup").where("name = 'app.cents'"), series)
    raw = TB.resolve_series(spark.read.parquet(f"{folder}/raw").where("name = 'app.cents'"), series)
    both = rolled.select("labels", "bucket_start", "value").unionByName(raw.select("labels", F.col("ts_unix_nano").alias("bucket_start"), "value"))
    return jobs._labelled(both).select("event_type", "service_name", "bucket_start", rounded(F.col("value")).alias("value"))


query(
    "rollup_stored",
    sql(
        f"select event_type, service_name, {_W} as bucket_start, sum(cents)::double + 0.0 as value from ev where us * 1000 < {_BOUNDARY} group by all "
        f"union all select event_type, service_name, us * 1000, cents::double + 0.0 from ev where us * 1000 >= {_BOUNDARY}",
        "ev",
    ),
)(_rolled)


def _swept(spark, sf) -> DataFrame:
    folder = scratch_folder(spark)
    TB.append_logs(V.logs(spark, sf), f"{folder}/logs")
    TB.append_metrics(TB.intern_series(V.metric_points(spark, sf))[0], f"{folder}/metrics")
    tables = {s: (f"{folder}/{s}", "ts_unix_nano", 7) for s in ("logs", "metrics")}
    deleted = J.sweep(spark, tables, jobs._NOW)
    kept = None
    for signal, (path, _, _) in tables.items():
        part = spark.read.parquet(path).agg(F.lit(signal).alias("signal"), F.count(F.lit(1)).alias("kept"))
        kept = part if kept is None else kept.unionByName(part)
    return deleted.join(kept, "signal").select("signal", "deleted", "kept")


query(
    "retention_stored",
    sql(
        f"select 'logs' as signal, count(*) filter (us * 1000 < {_CUTOFF}) as deleted, count(*) filter (us * 1000 >= {_CUTOFF}) as kept from ev "
        f"union all select 'metrics', 3 * count(*) filter (us * 1000 < {_CUTOFF}), 3 * count(*) filter (us * 1000 >= {_CUTOFF}) from ev",
        "ev",
    ),
)(_swept)


def _eviction_counts(spark, sf) -> DataFrame:
    rows = jobs._rows(spark, sf)
    return J.eviction_counts(rows, rows.agg(F.sum("est_bytes")).first()[0] // 2)


query(
    "eviction_counts",
    sql(
        "select signal, count(*) filter (used <= floor((total // 2) * 0.9)) as kept, count(*) filter (used > floor((total // 2) * 0.9)) as evicted "
        "from (select *, sum(est_bytes) over (order by ts desc, signal, row_key rows unbounded preceding) as used, "
        "(select sum(est_bytes) from rows_) as total from rows_) group by signal",
        "logs",
        jobs._ROWS,
    ),
)(_eviction_counts)


def _dictionary(spark, sf) -> DataFrame:
    """Points of the first and of the second half of the time come as two batches with common series."""
    points = V.metric_points(spark, sf)
    middle = (V.EVENTS_FROM_MS + 15 * DAY_MS) * 10**6
    path = f"{scratch_folder(spark)}/series"
    for batch in (points.where(F.col("ts_unix_nano") < middle), points.where(F.col("ts_unix_nano") >= middle)):
        J.insert_series(TB.intern_series(batch)[1], path)
    stored = spark.read.parquet(path).withColumn("labels", L.merge(F.col("resource"), F.col("attrs")))
    return jobs._labelled(stored).groupBy("name", "event_type", "service_name").agg(F.count("series_id").alias("ids"))


query(
    "series_dictionary",
    sql(
        "select name, event_type, service_name, 1::bigint as ids from (select distinct event_type, service_name from ev) "
        "cross join (select unnest(['app.value', 'app.level', 'app.cents']) as name)",
        "ev",
    ),
)(_dictionary)


def _appended(spark, sf) -> DataFrame:
    """Failed spans are delivered first; the other batch repeats many of their ids, often on another day.

    Only the spans that each batch adds are shown: the data lie on 2,500 days, a folder each, if they are stored.
    """
    spans = V.spans(spark, sf)
    keys = f"{scratch_folder(spark)}/keys"
    failed = F.col("status_code") == 2
    added = []
    for batch in (spans.where(failed), spans.where(~failed)):
        added.append(J.spans_not_stored(batch, keys, buckets=16))
        J.remember_spans(added[-1], keys, 16)
    return added[0].unionByName(added[1]).select("trace_id", "span_id", "status_code", "start_unix_nano")


query(
    "span_append_batches",
    sql(
        "select trace_id, span_id, status_code, start_ns as start_unix_nano from (select *, row_number() over "
        "(partition by trace_id, span_id order by case when status_code = 2 then 0 else 1 end, seq) as rn from spans) where rn = 1",
        "spans",
    ),
)(_appended)
