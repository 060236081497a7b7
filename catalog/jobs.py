"""Roll-up, retention, eviction, interning, indexing, exclusion and exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import views as V
from catalog.metrics import LOOKBACK
from catalog.registry import query, rounded
from catalog.views import DAY_MS, GRID, HOUR_MS, latest, sql
from telmora.functions import labels as L
from telmora.operators.discovery import metric_metadata
from telmora.operators.selectors import Grid, instant_select
from telmora.plans import maintenance as M
from telmora.sources import exposition as E
from telmora.sources import filters as FI
from telmora.sources import tables as TB

_RES_S = 6 * 3600
_BOUNDARY = (V.EVENTS_FROM_MS + 20 * DAY_MS) * 1_000_000
_NOW = V.EVENTS_TO_MS * 1_000_000
_W = f"us * 1000 // {_RES_S * 10**9} * {_RES_S * 10**9}"
_OLD = f"us * 1000 < {_BOUNDARY}"
_S = "event_type, service_name"


def _facts(spark, sf) -> tuple[DataFrame, DataFrame]:
    return TB.intern_series(V.metric_points(spark, sf))


def _rolled(spark, sf, name: str) -> DataFrame:
    """Roll-up of one metric with the labels of its series."""
    facts, series = _facts(spark, sf)
    roll = M.roll_up(facts.where(F.col("name") == name), _BOUNDARY, _RES_S)
    return _labelled(TB.resolve_series(roll, series))


def _labelled(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "event_type": F.try_element_at("labels", F.lit("event.type")),
            "service_name": F.try_element_at("labels", F.lit("service.name")),
        }
    )


def _rollup(query_name: str, metric: str, agg: str) -> None:
    text = sql(f"select {_S}, {_W} as bucket_start, round({agg}, 6) + 0.0 as value from ev where {_OLD} group by all", "ev")
    query(query_name, text)(
        lambda spark, sf: _rolled(spark, sf, metric).select(
            "event_type", "service_name", "bucket_start", rounded(F.col("value")).alias("value")
        )
    )


_rollup("rollup_gauge", "app.level", "arg_max(level, (us, level))")
_rollup("rollup_sum_delta", "app.cents", "sum(cents)::double")
_rollup("rollup_sum_cumulative", "app.value", "arg_max(value, (us, value))")


def _rolled_histogram(spark, sf, temporality: int) -> DataFrame:
    points = V.histogram_points(spark, sf, HOUR_MS, temporality).withColumn(
        "series_id", F.concat_ws("|", "event_type", "service_name")
    )
    roll = M.roll_up(points, _BOUNDARY, _RES_S)
    parts = F.split("series_id", r"\|")
    return roll.select(
        parts[0].alias("event_type"),
        parts[1].alias("service_name"),
        "bucket_start",
        "count",
        rounded(F.col("sum")).alias("sum"),
        "min",
        "max",
        *[F.get("bucket_counts", F.lit(i - 1)).alias(f"b{i}") for i in range(1, 10)],
    )


_HOURLY = V.CTES["hist"].replace("86400000", "3600000")
_HB = f"ts_ms * 1000000 // {_RES_S * 10**9} * {_RES_S * 10**9}"
_HROWS = f"from ({_HOURLY}) where ts_ms * 1000000 < {_BOUNDARY} group by all"
query(
    "rollup_hist_delta",
    sql(
        f"select {_S}, {_HB} as bucket_start, sum(n)::bigint as count, round(sum(s), 6) + 0.0 as sum, min(mn) as min, max(mx) as max, "
        + ", ".join(f"sum(b[{i}])::bigint as b{i}" for i in range(1, 10))
        + f" {_HROWS}",
        "ev",
    ),
)(lambda spark, sf: _rolled_histogram(spark, sf, 1))
query(
    "rollup_hist_cumulative",
    sql(
        f"select {_S}, {_HB} as bucket_start, arg_max(n, ts_ms) as count, round(arg_max(s, ts_ms), 6) + 0.0 as sum, min(mn) as min, max(mx) as max, "
        + ", ".join(f"arg_max(b[{i}], ts_ms) as b{i}" for i in range(1, 10))
        + f" {_HROWS}",
        "ev",
    ),
)(lambda spark, sf: _rolled_histogram(spark, sf, 2))

query(
    "rollup_union_read",
    sql(
        f"select {_S}, {_W} as ts_unix_nano, round(arg_max(level, (us, level)), 6) + 0.0 as value from ev where {_OLD} group by all union all "
        f"select {_S}, us * 1000, round(level, 6) + 0.0 from ev where not ({_OLD})",
        "ev",
    ),
)(lambda spark, sf: _union_read(spark, sf))


def _union_read(spark, sf) -> DataFrame:
    """Old points from the roll-up, younger ones raw."""
    facts, series = _facts(spark, sf)
    raw = M.raw_remainder(facts, _BOUNDARY)
    got = TB.fetch_points(raw, series, ["app.level"], rollup=M.roll_up(facts, _BOUNDARY, _RES_S))
    return _labelled(got).select("event_type", "service_name", "ts_unix_nano", rounded(F.col("value")).alias("value"))


_F = (V.EVENTS_FROM_MS + 3 * DAY_MS) * 1_000_000
query(
    "points_fetch",
    sql(
        f"select {_S}, name, us * 1000 as ts_unix_nano, v as value from (select *, unnest(['app.value', 'app.cents']) as name, unnest([value, cents::double]) as v from ev) "
        f"where us * 1000 >= {_F}",
        "ev",
    ),
)(
    lambda spark, sf: _labelled(TB.fetch_points(*_facts(spark, sf), ["app.value", "app.cents"], from_ns=_F)).select(
        "event_type", "service_name", "name", "ts_unix_nano", "value"
    )
)
query(
    "metric_series_read",
    sql("select us * 1000 as ts_unix_nano, level as value from ev", "ev"),
)(
    lambda spark, sf: TB.metric_series(V.metric_points(spark, sf), "app.level", ties=("event_id",)).select(
        "ts_unix_nano", "value"
    )
)

query(
    "series_interning",
    sql(
        f"select name, {_S}, count(*) as points from (select *, unnest(['app.value', 'app.level', 'app.cents']) as name from ev) group by all",
        "ev",
    ),
)(lambda spark, sf: _interned(spark, sf))


def _interned(spark, sf) -> DataFrame:
    facts, series = _facts(spark, sf)
    counts = facts.groupBy("series_id").agg(F.count(F.lit(1)).alias("points"))
    joined = counts.join(series, "series_id").withColumn("labels", L.merge(F.col("resource"), F.col("attrs")))
    return _labelled(joined).select("name", "event_type", "service_name", "points")


def _after_retention(spark, sf, find) -> DataFrame:
    """Series with or without points once everything but the last hours is gone."""
    facts, series = _facts(spark, sf)
    kept = facts.where(F.col("ts_unix_nano") >= _NOW - 3 * HOUR_MS * 10**6)
    left = find(series, kept).withColumn("labels", L.merge(F.col("resource"), F.col("attrs")))
    return _labelled(left).select("name", "event_type", "service_name")


_NAMES = "(select unnest(['app.value', 'app.level', 'app.cents']) as name)"
_RECENT = f"recent as (select distinct {_S} from ev where us * 1000 >= {_NOW - 3 * HOUR_MS * 10**6})"
query(
    "orphan_series",
    sql(
        f"select name, {_S} from (select distinct {_S} from ev) cross join {_NAMES} where ({_S}) not in (select {_S} from recent)".replace(
            f"({_S}) not in", "(event_type, service_name) not in"
        ),
        "ev",
        _RECENT,
    ),
)(lambda spark, sf: _after_retention(spark, sf, M.orphan_series))
query("used_series", sql(f"select name, {_S} from recent cross join {_NAMES}", "ev", _RECENT))(
    lambda spark, sf: _after_retention(spark, sf, M.used_series)
)

query("retention_keep", sql(f"select event_id, us * 1000 as ts_unix_nano from ev where us * 1000 >= {_NOW - 7 * DAY_MS * 10**6}", "ev"))(
    lambda spark, sf: M.retain(V.logs(spark, sf), "ts_unix_nano", _NOW, M.effective_days(None, 7)).select(
        "event_id", "ts_unix_nano"
    )
)
query(
    "retention_counts",
    sql(
        f"select 'logs' as signal, count(case when us * 1000 >= {_NOW - 7 * DAY_MS * 10**6} then 1 end) as kept, count(case when us * 1000 < {_NOW - 7 * DAY_MS * 10**6} then 1 end) as deleted from ev "
        "union all select 'spans', count(*), 0 from spans",
        "ev",
        "spans",
    ),
)(
    lambda spark, sf: M.retention_counts(
        _NOW, logs=(V.logs(spark, sf), "ts_unix_nano", 7), spans=(V.spans(spark, sf), "start_unix_nano", 0)
    )
)


def _rows(spark, sf) -> DataFrame:
    """Rows of two signals with an estimate of their size."""
    logs = V.logs(spark, sf).select(
        F.lit("logs").alias("signal"), "event_id", F.col("ts_unix_nano").alias("ts"), (F.length("body") + 40).alias("est_bytes")
    )
    points = V.metric_points(spark, sf).where(F.col("name") == "app.value").select(
        F.lit("metrics").alias("signal"), "event_id", F.col("ts_unix_nano").alias("ts"), F.lit(64).alias("est_bytes")
    )
    return logs.unionByName(points).withColumn("row_key", F.lpad(F.col("event_id").cast("string"), 20, "0")).drop("event_id")


_ROWS = (
    "rows_ as (select 'logs' as signal, lpad(event_id::varchar, 20, '0') as row_key, ts_unix_nano as ts, length(body) + 40 as est_bytes from logs union all "
    "select 'metrics', lpad(event_id::varchar, 20, '0'), ts_unix_nano, 64 from logs)"
)


def _evicted(spark, sf) -> DataFrame:
    """Half of the estimated size is the cap."""
    rows = _rows(spark, sf)
    total = rows.agg(F.sum("est_bytes").alias("b")).first()["b"]
    return M.evict_to_budget(rows, total // 2).select("signal", "row_key", "ts")


query(
    "evict_by_budget",
    sql(
        "select signal, row_key, ts from (select *, sum(est_bytes) over (order by ts desc, signal, row_key rows unbounded preceding) as used, "
        "(select sum(est_bytes) from rows_) as total from rows_) where used <= floor((total // 2) * 0.9)",
        "logs",
        _ROWS,
    ),
)(_evicted)
query(
    "oldest_rows",
    sql("select signal, row_key, ts from rows_ order by ts, signal, row_key limit 100", "logs", _ROWS),
)(lambda spark, sf: M.oldest_rows(_rows(spark, sf), 100).select("signal", "row_key", "ts"))

query(
    "attr_index",
    sql(
        "select event_id, unnest(['user.id', 'k', 'kind', 'service.name', 'service.version']) as key, unnest([uid, k, kind, service_name, version]) as value from logs",
        "logs",
    ),
)(lambda spark, sf: TB.attribute_index(V.logs(spark, sf), "event_id"))
query(
    "attr_index_pairs",
    sql("select service_name as service, version, count(*) as rows from logs group by all", "logs"),
)(lambda spark, sf: _pairs(TB.attribute_index(V.logs(spark, sf), "event_id")))


def _pairs(index: DataFrame) -> DataFrame:
    """Service and version of the same row, from the index alone."""
    s = index.where("key = 'service.name'").select("event_id", F.col("value").alias("service"))
    v = index.where("key = 'service.version'").select("event_id", F.col("value").alias("version"))
    return s.join(v, "event_id").groupBy("service", "version").agg(F.count(F.lit(1)).alias("rows"))


query(
    "attrs_json",
    "select event_id, '{\"event_type\":\"' || event_type || '\",\"k\":\"' || (props->>'$.k') || '\"}' as attrs, (props->>'$.k') as k from events",
)(lambda spark, sf: _attrs_json(spark, sf))


def _attrs_json(spark, sf) -> DataFrame:
    parsed = TB.parse_attributes(F.col("props"))
    attrs = F.create_map(
        F.lit("event_type"), F.col("event_type"), F.lit("k"), F.try_element_at(parsed, F.lit("k")), F.lit("empty"), F.lit("")
    )
    return V.table(spark, sf, "events").select(
        "event_id", TB.attributes_json(attrs).alias("attrs"), F.try_element_at(parsed, F.lit("k")).alias("k")
    )


query(
    "arrays_json",
    sql(
        "select event_type, service_name, ts_ms, '[' || array_to_string(b, ',') || ']' as counts, list_sum(b)::bigint as n from hist",
        "hist",
    ),
)(lambda spark, sf: _arrays_json(spark, sf))


def _arrays_json(spark, sf) -> DataFrame:
    text = TB.numbers_json(F.col("bucket_counts"))
    back = F.aggregate(TB.parse_numbers(F.col("counts"), "bigint"), F.lit(0).cast("long"), lambda a, c: a + c)
    return (
        V.histogram_points(spark, sf)
        .select("event_type", "service_name", F.floor(F.col("ts_unix_nano") / 1_000_000).alias("ts_ms"), text.alias("counts"))
        .withColumn("n", back)
    )


query(
    "array_sum",
    sql(
        "select event_type, service_name, ts_ms, " + ", ".join(f"(a.b[{i}] + c.b[{i}])::bigint as b{i}" for i in range(1, 10))
        + " from hist a join (select event_type, ts_ms, b, service_name as other from hist) c using (event_type, ts_ms) where other = 'svc-' || (substr(service_name, 5)::int + 1)",
        "hist",
    ),
)(lambda spark, sf: _array_sum(spark, sf))


def _array_sum(spark, sf) -> DataFrame:
    h = V.histogram_points(spark, sf).select(
        "event_type", "service_name", F.floor(F.col("ts_unix_nano") / 1_000_000).alias("ts_ms"), "bucket_counts"
    )
    # every service meets the one numbered next
    before = F.concat(F.lit("svc-"), (F.substring("service_name", 5, 9).cast("int") - 1).cast("string"))
    a = h.withColumnRenamed("bucket_counts", "a")
    b = h.withColumnRenamed("bucket_counts", "b").withColumn("service_name", before)
    both = a.join(b, ["event_type", "service_name", "ts_ms"]).withColumn("s", TB.add_arrays(F.col("a"), F.col("b")))
    return both.select("event_type", "service_name", "ts_ms", *[F.get("s", F.lit(i - 1)).alias(f"b{i}") for i in range(1, 10)])


query(
    "exclude_routes",
    sql("select trace_id, span_id, route, seq from spans where route not in ('/api/v1/parts/1', '/api/v1/parts/3')", "spans"),
)(lambda spark, sf: _excluded(spark, sf))


def _excluded(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    kept = FI.exclude_span_routes(
        V.spans(spark, sf).withColumn(
            "seq", F.row_number().over(Window.partitionBy("trace_id", "span_id").orderBy("ingest_seq")).cast("long")
        ),
        ["/api/v1/parts/1", "/api/v1/parts/3"],
    )
    return kept.select("trace_id", "span_id", F.try_element_at("attrs", F.lit("http.route")).alias("route"), "seq")


_AT = GRID.start_ms + 12 * DAY_MS
query(
    "exposition_lines",
    sql(
        "select 'app_value_total' as family, 1 as position, 'app_value_total{event_type=\"' || event_type || '\",job=\"' || service_name || '\",service_name=\"' || service_name || '\"} ' || "
        "regexp_replace(value::varchar, '\\.0$', '') || ' ' || sample_ts_ms as line from inst union all select 'app_value_total', 0, '# TYPE app_value_total counter' "
        "union all select 'app_value', 0, '# TYPE app_value counter'",
        "ev",
        "counter",
        f"one as (select {_AT} as t_ms)",
        latest("counter", LOOKBACK, "one"),
    ),
)(lambda spark, sf: _lines(spark, sf))


def _lines(spark, sf) -> DataFrame:
    points = V.metric_points(spark, sf).where(F.col("name") == "app.value")
    vector = instant_select(V.counter(spark, sf), Grid.instant(_AT), LOOKBACK)
    return E.exposition_lines(vector, metric_metadata(points))
