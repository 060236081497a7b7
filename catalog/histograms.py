"""Histogram quantiles, heat maps and the metrics derived from spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import SHIFT, query, rounded, shifted, show
from catalog.views import DAILY, DAY_MS, HIST_BOUNDS, sql
from telmora.functions import labels as L
from telmora.functions.integers import int_div
from telmora.operators import aggregates as A
from telmora.operators import binary as B
from telmora.operators import histogram as H
from telmora.operators import ranges as R
from telmora.operators import red
from telmora.operators.samples import expand_points, series_samples
from telmora.operators.selectors import Grid, instant_select, range_select
from telmora.plans import kpis as K
from telmora.runtime import checkpointed

SERIES = ("event_type", "service_name")
_LE = "list_value(" + ", ".join(f"{b / 1000}::double" for b in HIST_BOUNDS) + ", 'inf'::double)"
# cumulative buckets per point, then cumulative over time
_HB = (
    "hb as (select event_type, service_name, ts_ms, le, sum(c) over (partition by event_type, service_name, le order by ts_ms "
    f"rows unbounded preceding) as value from (select event_type, service_name, ts_ms, {_LE}[i] as le, list_sum(b[1:i])::double as c "
    "from hist, range(1, 10) r(i)))"
)
_DAY_END = "inst as (select event_type, service_name, le, t_ms, value as c from days join hb on hb.ts_ms = t_ms - 43200000)"


def ladder(keys: str, q: float, source: str) -> str:
    """SQL of the quantile rule over rows (keys, t_ms, le, c)."""
    by = f"partition by {keys}t_ms"
    here = (
        "case when rn = 1 then (case when le = 'inf' then 'nan'::double else 0 end) when le = 'inf' then ple "
        f"when c = pc then le else ple + (le - ple) * ({q} * total - pc) / (c - pc) end"
    )
    return (
        f"select {keys}t_ms, round(case when max(total) = 0 then 'nan'::double else arg_min({here}, rn) filter (where c >= {q} * total) end + {SHIFT}, 6) "
        f"+ 0.0 as value from (select *, row_number() over w as rn, lag(le) over w as ple, lag(c) over w as pc, "
        f"max(c) over ({by}) as total from {source} window w as ({by} order by le)) group by all"
    )


def _buckets(spark, sf) -> DataFrame:
    return series_samples(
        V.histogram_points(spark, sf), "app_duration_seconds_bucket", V.EVENTS_FROM_MS, V.EVENTS_TO_MS
    )


def _day_buckets(spark, sf) -> DataFrame:
    return instant_select(_buckets(spark, sf), DAILY, DAY_MS - 1)


def _day_sums(spark, sf) -> DataFrame:
    points = V.histogram_points(spark, sf)
    sums = series_samples(points, "app_duration_seconds_sum", V.EVENTS_FROM_MS, V.EVENTS_TO_MS)
    return instant_select(sums, DAILY, DAY_MS - 1)


query("hist_quantile_p95", sql(ladder("event_type, service_name, ", 0.95, "inst"), "days", "hist", _HB, _DAY_END))(
    lambda spark, sf: show(shifted(H.histogram_quantile(0.95, _day_buckets(spark, sf))), SERIES)
)

_INC = (
    "inc as (select event_type, le, t_ms, sum(v) as c from (select event_type, service_name, le, t_ms, max(value) - min(value) as v "
    "from days join hb on hb.ts_ms between t_ms - 259200000 and t_ms group by all) group by all)"
)
query("hist_quantile_by_type", sql(ladder("event_type, ", 0.5, "inc"), "days", "hist", _HB, _INC))(
    lambda spark, sf: show(
        shifted(
            H.histogram_quantile(
                0.5,
                A.sum_(R.increase(range_select(_buckets(spark, sf), DAILY, 3 * DAY_MS)), by=["event_type", "le"]),
            )
        ),
        ["event_type"],
    )
)

query(
    "hist_count",
    sql("select event_type, service_name, t_ms, max(c) as value from inst group by all", "days", "hist", _HB, _DAY_END),
)(lambda spark, sf: show(H.histogram_count(_day_buckets(spark, sf)), SERIES))

query(
    "hist_avg",
    sql(
        f"select event_type, service_name, t_ms, round(s / n + {SHIFT}, 6) + 0.0 as value from days join (select event_type, service_name, ts_ms, "
        "sum(s / 1000) over w as s, sum(n) over w as n from hist window w as (partition by event_type, service_name order by ts_ms "
        "rows unbounded preceding)) on ts_ms = t_ms - 43200000",
        "days",
        "hist",
    ),
)(
    lambda spark, sf: show(shifted(H.histogram_avg(_day_buckets(spark, sf), _day_sums(spark, sf))), SERIES)
)

_PER_LE = "select le, t_ms, sum(c) as c from inst group by all"
query(
    "hist_heatmap",
    sql(
        f"select le, t_ms, greatest(0, c - coalesce(lag(c) over (partition by t_ms order by le), 0)) as value from ({_PER_LE})",
        "days",
        "hist",
        _HB,
        _DAY_END,
    ),
)(lambda spark, sf: H.heatmap(A.sum_(_day_buckets(spark, sf), by=["le"]), DAILY))


def _point_quantile(q: float) -> str:
    return (
        f"round(arg_min(lo + (hi - lo) * ({q} * n - (run - c)) / c, i) filter (where run >= {q} * n and c > 0), 6) + 0.0"
    )


_PTS = (
    "pts as (select event_type, service_name, ts_ms, n, i, b[i] as c, list_sum(b[1:i]) as run, "
    f"coalesce(list_value({', '.join(str(b) + '::double' for b in HIST_BOUNDS)})[i - 1], case when i = 1 then 0 else 500 end) as lo, "
    f"coalesce(list_value({', '.join(str(b) + '::double' for b in HIST_BOUNDS)})[i], 500) as hi from hist, range(1, 10) r(i))"
)
query(
    "hist_latency_series",
    sql(
        f"select event_type, service_name, ts_ms, {_point_quantile(0.5)} as p50, {_point_quantile(0.95)} as p95, {_point_quantile(0.99)} as p99 "
        "from pts group by all",
        "hist",
        _PTS,
    ),
)(
    lambda spark, sf: K.latency_series(
        V.histogram_points(spark, sf), {"p50": 0.5, "p95": 0.95, "p99": 0.99}, SERIES
    ).select(
        *SERIES,
        int_div(F.col("ts_unix_nano"), 1_000_000).alias("ts_ms"),
        *[rounded(F.col(p)).alias(p) for p in ("p50", "p95", "p99")],
    )
)

query(
    "samples_histogram",
    sql(
        f"select event_type, service_name, ts_ms, 'app_duration_seconds_bucket' as name, {_LE}[i] as le, list_sum(b[1:i])::double as value from hist, range(1, 10) r(i) "
        "union all select event_type, service_name, ts_ms, 'app_duration_seconds_sum', null, round(s / 1000, 6) + 0.0 from hist "
        "union all select event_type, service_name, ts_ms, 'app_duration_seconds_count', null, n::double from hist",
        "hist",
    ),
)(
    lambda spark, sf: expand_points(V.histogram_points(spark, sf)).select(
        *[L.label("labels_fp", k).alias(k) for k in SERIES],
        "ts_ms",
        L.label("labels_fp", "__name__").alias("name"),
        H.le_value(L.label("labels_fp", "le")).alias("le"),
        rounded(F.col("value")).alias("value"),
    )
)

query(
    "raw_quantile_r6",
    sql(
        "select event_type, count(*) as n, "
        + ", ".join(
            f"round(case when floor({q} * (n + 1)) < 1 then min(level) when floor({q} * (n + 1)) >= n then max(level) else "
            f"max(level) filter (where rn = floor({q} * (n + 1))) + ({q} * (n + 1) - floor({q} * (n + 1))) * "
            f"(max(level) filter (where rn = floor({q} * (n + 1)) + 1) - max(level) filter (where rn = floor({q} * (n + 1)))) end, 6) + 0.0 as {p}"
            for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
        )
        + " from (select *, row_number() over (partition by event_type order by level) as rn, count(*) over (partition by event_type) as n from ev) "
        "group by event_type, n",
        "ev",
    ),
)(
    lambda spark, sf: H.raw_quantiles(
        V.table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    ).select("event_type", "n", *[rounded(F.col(p)).alias(p) for p in ("p50", "p95", "p99")])
)

query(
    "hist_record",
    sql("select event_type, service_name, ts_ms, n, " + ", ".join(f"b[{i}] as b{i}" for i in range(1, 10)) + " from hist", "hist"),
)(
    lambda spark, sf: V.histogram_points(spark, sf).select(
        *SERIES,
        int_div(F.col("ts_unix_nano"), 1_000_000).alias("ts_ms"),
        F.col("count").alias("n"),
        *[F.get("bucket_counts", F.lit(i - 1)).alias(f"b{i}") for i in range(1, 10)],
    )
)

# --- metrics derived from spans -----------------------------------------------------------------

_W = 4 * DAY_MS * 1_000_000
_FROM_MS, _TO_MS = V.SPANS_FROM_NS // 10**6, V.SPANS_TO_NS // 10**6
RED_GRID = Grid(_FROM_MS + 180 * DAY_MS, _TO_MS, 90 * DAY_MS)
_REQ = (
    f"req as (select service_name, route, coalesce(method, 'GET') as method, coalesce(http_status, case when status_code >= 2 then '500' "
    f"else '200' end) as status, start_ns // {_W} * {_W} as bucket_start, duration_ns / 1e9 as d from spans where kind = 1)"
)
_RED_KEYS = "service_name, route, method, status, bucket_start"
_RENAMED = (
    "service_name as service_name, route as http_route, method as http_method, status as http_response_status_code, bucket_start"
)
query(
    "red_requests",
    sql(
        f"select {_RENAMED}, count(*) as requests, round(sum(d), 6) + 0.0 as seconds from req group by {_RED_KEYS}",
        "spans",
        _REQ,
    ),
)(
    lambda spark, sf: red.red_groups(V.spans(spark, sf), V.SPANS_FROM_NS, V.SPANS_TO_NS, _W)
    .withColumn("seconds", rounded(F.col("seconds")))
    .drop("bucket_counts")
)

_RB = [*H.DEFAULT_BOUNDS, "inf"]
query(
    "red_duration_buckets",
    sql(
        "select route, le, sum(n)::double as value from (select route, unnest([" + ", ".join(f"'{b}'::double" for b in _RB) + "]) as le, "
        "unnest([" + ", ".join(f"count(case when d <= '{b}'::double then 1 end)" for b in _RB) + "]) as n from req group by route) group by all",
        "spans",
        _REQ,
    ),
)(
    lambda spark, sf: expand_points(
        red.red_points(V.spans(spark, sf), V.SPANS_FROM_NS, V.SPANS_TO_NS, _W), "http_request_duration_seconds_bucket"
    )
    .groupBy(L.label("labels_fp", "http_route").alias("route"), H.le_value(L.label("labels_fp", "le")).alias("le"))
    .agg(F.sum("value").alias("value"))
)


def _red_points(spark, sf) -> DataFrame:
    return red.red_points(V.spans(spark, sf), V.SPANS_FROM_NS, V.SPANS_TO_NS, _W)


def red_error_share(points: DataFrame) -> DataFrame:
    """sum by (route) (increase of 5xx) / sum by (route) (increase)"""
    requests = series_samples(points, "http_requests_total", _FROM_MS, _TO_MS)
    inc = checkpointed(
        A.sum_(
            R.increase(range_select(requests, RED_GRID, 180 * DAY_MS)), by=["http_route", "http_response_status_code"]
        )
    )
    errors = inc.where(L.matches(F.col("labels_fp"), "http_response_status_code", "=~", "^5"))
    return B.arithmetic(A.sum_(errors, by=["http_route"]), "/", A.sum_(inc, by=["http_route"]), on=["http_route"])


def red_p95(points: DataFrame) -> DataFrame:
    """histogram_quantile(0.95, sum by (le, route) (rate of duration buckets))"""
    buckets = series_samples(points, "http_request_duration_seconds_bucket", _FROM_MS, _TO_MS)
    rate = R.rate(range_select(buckets, RED_GRID, 180 * DAY_MS))
    return H.histogram_quantile(0.95, A.sum_(rate, by=["le", "http_route"]))


_RED_STEPS = f"rsteps as (select {RED_GRID.start_ms} + i * {RED_GRID.step_ms} as t_ms from range({RED_GRID.steps}) r(i))"
_CUM = (
    "cum as (select service_name, route, method, status, bucket_start // 1000000 as ts_ms, sum(n) over (partition by service_name, route, "
    "method, status order by bucket_start rows unbounded preceding) as value from (select service_name, route, method, status, bucket_start, "
    "count(*)::double as n from req group by all))"
)
_RINC = (
    "rinc as (select service_name, route, method, status, t_ms, max(value) - min(value) as v from rsteps join cum on ts_ms between "
    f"t_ms - {180 * DAY_MS} and t_ms group by all)"
)
query(
    "red_error_share",
    sql(
        "select route as http_route, t_ms, round(case when sum(v) > 0 then sum(case when status like '5%' then v end) / sum(v) else 'nan'::double end, 6) + 0.0 as value "
        "from rinc group by all having count(case when status like '5%' then 1 end) > 0",
        "spans",
        _REQ,
        _RED_STEPS,
        _CUM,
        _RINC,
    ),
)(lambda spark, sf: show(red_error_share(_red_points(spark, sf)), ["http_route"]))

_RBC = (
    "rb as (select route as http_route, t_ms, le, sum(v) / 15552000 as c from (select service_name, route, method, status, le, t_ms, max(value) - min(value) as v from rsteps "
    "join (select service_name, route, method, status, le, bucket_start // 1000000 as ts_ms, sum(n) over (partition by service_name, route, method, status, le "
    "order by bucket_start rows unbounded preceding) as value from (select service_name, route, method, status, bucket_start, "
    "unnest([" + ", ".join(f"'{b}'::double" for b in _RB) + "]) as le, unnest([" + ", ".join(f"count(case when d <= '{b}'::double then 1 end)::double" for b in _RB)
    + f"]) as n from req group by {_RED_KEYS})) on ts_ms between t_ms - {180 * DAY_MS} and t_ms group by all) group by all)"
)
query("red_p95", sql(ladder("http_route, ", 0.95, "rb"), "spans", _REQ, _RED_STEPS, _RBC))(
    lambda spark, sf: show(shifted(red_p95(_red_points(spark, sf))), ["http_route"])
)


def red_overview(spark, sf) -> DataFrame:
    """p95 duration and error share per route and step."""
    points = checkpointed(_red_points(spark, sf))  # the spans are read once for both figures
    p95 = shifted(red_p95(points)).select("labels_fp", "t_ms", rounded(F.col("value")).alias("p95_seconds"))
    share = red_error_share(points).select("labels_fp", "t_ms", rounded(F.col("value")).alias("error_share"))
    return p95.join(share, ["labels_fp", "t_ms"], "left").select(
        L.label("labels_fp", "http_route").alias("http_route"), "t_ms", "p95_seconds", "error_share"
    )


query(
    "red_overview",
    sql(
        "select p.http_route, p.t_ms, p.value as p95_seconds, e.value as error_share from ("
        + ladder("http_route, ", 0.95, "rb")
        + ") p left join (select route as http_route, t_ms, round(case when sum(v) > 0 then sum(case when status like '5%' then v end) / sum(v) else 'nan'::double end, 6) + 0.0 as value "
        "from rinc group by all having count(case when status like '5%' then 1 end) > 0) e using (http_route, t_ms)",
        "spans",
        _REQ,
        _RED_STEPS,
        _CUM,
        _RINC,
        _RBC,
    ),
)(red_overview)

query(
    "red_label_values",
    sql(
        "select 'http.method' as label, coalesce(method, 'GET') as value from spans where kind = 1 group by all union all "
        "select 'http.route', route from spans where kind = 1 group by all union all "
        "select 'http.response.status_code', status from req group by all union all select 'service.name', service_name from req group by all",
        "spans",
        _REQ,
    ),
)(lambda spark, sf: _red_label_values(spark, sf))


def _red_label_values(spark, sf) -> DataFrame:
    out = None
    for key in red.red_label_names():
        part = red.red_label_values(V.spans(spark, sf), key).select(F.lit(key).alias("label"), "value")
        out = part if out is None else out.unionByName(part)
    return out


query(
    "composite_points",
    sql(
        "select name, count(*) as points, round(sum(value), 6) + 0.0 as total from (select 'app.value' as name, value from ev union all "
        f"select 'http_requests', count(*)::double from req group by {_RED_KEYS} union all select 'http_request_duration', sum(d) from req group by {_RED_KEYS}) group by name",
        "ev",
        "spans",
        _REQ,
    ),
)(
    lambda spark, sf: red.composite_points(
        V.metric_points(spark, sf), V.spans(spark, sf), V.SPANS_FROM_NS, V.SPANS_TO_NS, _W
    )
    .where(F.col("name").isin("app.value", "http_requests", "http_request_duration"))
    .groupBy("name")
    .agg(F.count(F.lit(1)).alias("points"), rounded(F.sum("value")).alias("total"))
)
