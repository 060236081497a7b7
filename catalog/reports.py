"""Volume, endpoints, key figures, panels and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog import views as V
from catalog.histograms import _PTS, _point_quantile
from catalog.metrics import LOOKBACK, SERIES
from catalog.registry import query, rounded, show
from catalog.views import DAY_MS, GRID, HOUR_MS, latest, sql
from telmora.functions import attributes as AT
from telmora.functions import labels as L
from telmora.operators import aggregates as A
from telmora.operators import alerts as AL
from telmora.operators import binary as B
from telmora.operators import endpoints as E
from telmora.operators import volume as VO
from telmora.operators.selectors import Grid, instant_select
from telmora.operators.traces import list_spans
from telmora.plans import kpis as K
from telmora.plans import panels as P

_DAY_NS = 86_400_000_000_000
_FROM, _TO = V.EVENTS_FROM_MS * 1_000_000, V.EVENTS_TO_MS * 1_000_000


def _volume(spark, sf, bucket_ns: int, from_ns: int, to_ns: int) -> DataFrame:
    """Server spans of 1995–2001 next to logs and counter points of 2024."""
    points = V.metric_points(spark, sf)  # three for each event
    return VO.signal_volume(V.spans(spark, sf), V.logs(spark, sf), points, from_ns, to_ns, bucket_ns)


_VOL = (
    "select bucket, sum(s)::bigint as spans, sum(l)::bigint as logs, sum(m)::bigint as metrics from (select start_ns as ts, 1 as s, 0 as l, 0 as m from spans "
    "union all select ts_unix_nano, 0, 1, 0 from logs union all select ts_unix_nano, 0, 0, 3 from logs) t, "
    "lateral (select ts // {w} * {w} as bucket) where ts between {a} and {b} group by bucket"
)
query("signal_volume", sql(_VOL.format(w=_DAY_NS, a=0, b=2 * 10**18), "spans", "logs"))(
    lambda spark, sf: _volume(spark, sf, _DAY_NS, 0, 2 * 10**18)
)
_HOUR_NS = HOUR_MS * 1_000_000
_END = _TO - 1
_DENSE = (
    f"dense as (select i as slot, ({_END} // {_HOUR_NS} - 719 + i) * {_HOUR_NS} as bucket, coalesce(spans, 0) as spans, coalesce(logs, 0) as logs, "
    f"coalesce(metrics, 0) as metrics from range(720) r(i) left join ({_VOL.format(w=_HOUR_NS, a=_FROM, b=_END)}) v on v.bucket = ({_END} // {_HOUR_NS} - 719 + i) * {_HOUR_NS})"
)
query("signal_volume_dense", sql("select * from dense", "spans", "logs", _DENSE))(
    lambda spark, sf: VO.dense_volume(_volume(spark, sf, _HOUR_NS, _FROM, _END), _END, _HOUR_NS, 720)
)
query(
    "signal_volume_lanes",
    sql(
        "select 'spans' as signal, arg_max(spans, slot) as last, greatest(1, max(spans)) as peak, round(sum(spans) / 2592000, 6) + 0.0 as per_second from dense union all "
        "select 'logs', arg_max(logs, slot), greatest(1, max(logs)), round(sum(logs) / 2592000, 6) + 0.0 from dense union all "
        "select 'metrics', arg_max(metrics, slot), greatest(1, max(metrics)), round(sum(metrics) / 2592000, 6) + 0.0 from dense",
        "spans",
        "logs",
        _DENSE,
    ),
)(
    lambda spark, sf: VO.volume_lanes(
        VO.dense_volume(_volume(spark, sf, _HOUR_NS, _FROM, _END), _END, _HOUR_NS, 720), 2_592_000
    ).withColumn("per_second", rounded(F.col("per_second")))
)
query(
    "signal_row_counts",
    "select 'spans' as signal, count(*) as rows from lineitem union all select 'logs', count(*) from events union all select 'metrics', 3 * count(*) from events",
)(
    lambda spark, sf: VO.row_counts(
        spans=V.spans(spark, sf), logs=V.logs(spark, sf), metrics=V.metric_points(spark, sf)
    )
)

# --- endpoints ------------------------------------------------------------------------------------


def _r6(q: float, d: str = "d") -> str:
    pos = f"{q} * (n + 1)"
    at = "max({d}) filter (where rn = floor({pos}){plus})"
    low, high = at.format(d=d, pos=pos, plus=""), at.format(d=d, pos=pos, plus=" + 1")
    return (
        f"round(case when floor({pos}) < 1 then min({d}) when floor({pos}) >= n then max({d}) else {low} + ({pos} - floor({pos})) * ({high} - {low}) end, 3) + 0.0"
    )


_ROLLUP = (
    "select level, controller, action, route, count(*) as calls, sum(e)::bigint as errors, round(avg(d), 3) + 0.0 as avg_ns, min(d) as min_ns, max(d) as max_ns, "
    f"{_r6(0.5)} as p50, {_r6(0.95)} as p95, {_r6(0.99)} as p99 from (select *, row_number() over (partition by level, controller, action, route order by d) as rn, "
    "count(*) over (partition by level, controller, action, route) as n from (select 'overall' as level, '' as controller, '' as action, '' as route, d, e from base union all "
    "select 'controller', controller, '', '', d, e from base union all select 'endpoint', controller, route, route, d, e from base)) group by level, controller, action, route, n"
)


def _rollup(spans: DataFrame) -> DataFrame:
    out = E.endpoint_rollup(spans)
    return out.select(*out.columns[:6], *[rounded(F.col(c), 3).alias(c) for c in out.columns[6:]])


query(
    "endpoint_rollup",
    sql(
        _ROLLUP,
        "spans",
        "base as (select 'parts' as controller, route, duration_ns::double as d, (status_code = 2)::int as e from spans where kind = 1)",
    ),
)(lambda spark, sf: _rollup(list_spans(V.spans(spark, sf), kind=1)))
_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
_PAGES = (
    "base as (select coalesce(nullif(split_part(trim(route, '/'), '/', 1), ''), '(unbekannt)') as controller, route, d, e from "
    f"(select {_PATH} as route, length(html)::double as d, (page_id % 10 = 0)::int as e from pages))"
)
query(
    "endpoint_from_route",
    sql("select controller, count(*) as calls, sum(e)::bigint as errors, max(d) as max_ns from base group by all", _PAGES),
)(
    lambda spark, sf: E.endpoint_rollup(V.page_spans(spark, sf))
    .where("level = 'controller'")
    .select("controller", "calls", "errors", "max_ns")
)
_WINDOW_NS = V.SPANS_TO_NS - V.SPANS_FROM_NS
query(
    "endpoint_kpis",
    sql(
        f"select *, round(calls / ({_WINDOW_NS} / 1e9) * 1000, 6) + 0.0 as calls_per_ks, round(errors / calls * 100, 6) + 0.0 as error_pct, "
        "case when errors / calls >= 0.05 then 'err' when errors / calls >= 0.01 then 'warn' else 'ok' end as error_tone, "
        "case when p95 >= 1e9 then 'err' when p95 >= 2e8 then 'warn' else 'ok' end as p95_tone, "
        f"case when max_ns >= 2e9 then 'err' when max_ns >= 1e9 then 'warn' else 'ok' end as max_tone from ({_ROLLUP}) where level = 'controller'",
        "spans",
        "base as (select 'parts' as controller, route, duration_ns::double as d, (status_code = 2)::int as e from spans where kind = 1)",
    ),
)(
    lambda spark, sf: E.endpoint_kpis(
        _rollup(list_spans(V.spans(spark, sf), kind=1)).where("level = 'controller'"), _WINDOW_NS
    )
    .withColumn("calls_per_ks", rounded(F.col("calls_per_s") * 1000))
    .withColumn("error_pct", rounded(F.col("error_pct")))
    .drop("calls_per_s")
)
query(
    "controller_of_route",
    sql("select distinct route, controller from base", _PAGES),
)(
    lambda spark, sf: V.page_spans(spark, sf)
    .select(F.try_element_at("attrs", F.lit("http.route")).alias("route"))
    .distinct()
    .select("route", AT.controller_of_route(F.col("route")).alias("controller"))
)

# --- key figures ----------------------------------------------------------------------------------


def _counter_points(spark, sf) -> DataFrame:
    """Counter points with service and type as columns."""
    return V.metric_points(spark, sf).where(F.col("name") == "app.value").select(
        F.try_element_at("attrs", F.lit("event.type")).alias("event_type"),
        F.try_element_at("resource", F.lit("service.name")).alias("service_name"),
        "ts_unix_nano",
        "value",
    )


_SPAN_NS = _TO - _FROM
_RATES = (
    "rates as (select event_type, service_name, ts, greatest(0, value - pv) / ((ts - pts) / 1e9) as rate from (select event_type, service_name, us * 1000 as ts, value, "
    "lag(value) over w as pv, lag(us * 1000) over w as pts from ev window w as (partition by event_type, service_name order by us, value)) where ts - pts >= 1)"
)
query(
    "kpi_rates",
    sql("select event_type, service_name, ts as ts_unix_nano, round(rate, 6) + 0.0 as rate from rates", "ev", _RATES),
)(
    lambda spark, sf: K.neighbour_rate(_counter_points(spark, sf), list(SERIES), _SPAN_NS).withColumn(
        "rate", rounded(F.col("rate"))
    )
)


# Key figures of every service: requests are the events of one kind or all events, errors the error events.
_BY = ["service_name"]


def _service_rates(requests: str) -> str:
    return (
        f"points as (select 'requests' as kind, service_name, us, value from ev where {requests} union all select 'errors', service_name, us, value from ev where event_type = 'error'), "
        "srates as (select kind, service_name, ts, greatest(0, value - pv) / ((ts - pts) / 1e9) as rate from (select kind, service_name, us * 1000 as ts, value, "
        "lag(value) over w as pv, lag(us * 1000) over w as pts from points window w as (partition by kind, service_name order by us, value)) where ts - pts >= 1), "
        "numbered as (select *, row_number() over (partition by kind, service_name order by ts) as rn from srates), "
        "sratio as (select r.service_name, r.ts, r.rn as position, case when r.rate = 0 then 0 else least(1, greatest(0, e.rate / r.rate)) end as ratio "
        "from numbered r join numbered e using (service_name, rn) where r.kind = 'requests' and e.kind = 'errors'), "
        "sup as (select *, case when requests > 0 then least(1, greatest(0, 1 - errors / requests)) else 1 end as availability from "
        "(select service_name, coalesce(arg_max(value, (us, value)) filter (where kind = 'requests'), 0) as requests, "
        "coalesce(arg_max(value, (us, value)) filter (where kind = 'errors'), 0) as errors from points group by all))"
    )


_SERVICE_RATES = _service_rates("true")
_PURCHASES = _service_rates("event_type = 'purchase'")


def _purchases_and_errors(spark, sf) -> tuple[DataFrame, DataFrame]:
    points = _counter_points(spark, sf)
    return points.where("event_type = 'purchase'"), points.where("event_type = 'error'")


query(
    "kpi_error_ratio",
    sql("select service_name, ts as ts_unix_nano, position, round(ratio, 6) + 0.0 as ratio from sratio", "ev", _PURCHASES),
)(
    lambda spark, sf: K.error_ratio(
        *[K.neighbour_rate(p, _BY, _SPAN_NS) for p in _purchases_and_errors(spark, sf)], _BY
    ).select("service_name", "ts_unix_nano", F.col("position").cast("long").alias("position"), rounded(F.col("ratio")).alias("ratio"))
)
query(
    "kpi_availability",
    sql("select * replace (round(availability, 6) + 0.0 as availability) from sup", "ev", _PURCHASES),
)(
    lambda spark, sf: K.availability(*_purchases_and_errors(spark, sf), _BY).withColumn(
        "availability", rounded(F.col("availability"))
    )
)
query(
    "kpi_reducers",
    sql(
        "select event_type, max(value) as max, arg_max(value, (us, value)) as last, sum(value) as sum, round(avg(value), 6) + 0.0 as mean from ev group by all",
        "ev",
    ),
)(
    lambda spark, sf: _counter_points(spark, sf)
    .groupBy("event_type")
    .agg(*K.reducers())
    .withColumn("mean", rounded(F.col("mean")))
)
query(
    "kpi_dashboard",
    sql(
        "select service_name, round(coalesce(calls, 0), 6) + 0.0 as calls_per_s, round(coalesce(peak, 0), 6) + 0.0 as peak_calls_per_s, "
        "round(coalesce(ratio, 0), 6) + 0.0 as error_ratio, round(availability, 6) + 0.0 as availability, "
        "case when availability < 0.9 then 'err' when availability < 0.99 then 'warn' else 'ok' end as availability_tone from sup "
        "left join (select service_name, arg_max(rate, ts) as calls, max(rate) as peak from srates where kind = 'requests' group by all) using (service_name) "
        "left join (select service_name, arg_max(ratio, ts) as ratio from sratio group by all) using (service_name)",
        "ev",
        _PURCHASES,
    ),
)(
    lambda spark, sf: K.dashboard(
        *_purchases_and_errors(spark, sf), V.histogram_points(spark, sf).where("event_type = 'purchase'"), _SPAN_NS, _BY
    ).select(
        "service_name",
        *[rounded(F.col(c)).alias(c) for c in ("calls_per_s", "peak_calls_per_s", "error_ratio", "availability")],
        "availability_tone",
    )
)


def _requests_and_errors(spark, sf) -> tuple[DataFrame, DataFrame]:
    points = _counter_points(spark, sf)
    return points, points.where("event_type = 'error'")


query(
    "kpi_error_ratio_by_service",
    sql("select service_name, ts as ts_unix_nano, position, round(ratio, 6) + 0.0 as ratio from sratio", "ev", _SERVICE_RATES),
)(
    lambda spark, sf: K.error_ratio(
        *[K.neighbour_rate(p, _BY, _SPAN_NS) for p in _requests_and_errors(spark, sf)], _BY
    ).select("service_name", "ts_unix_nano", F.col("position").cast("long").alias("position"), rounded(F.col("ratio")).alias("ratio"))
)
query(
    "kpi_availability_by_service",
    sql("select * replace (round(availability, 6) + 0.0 as availability) from sup", "ev", _SERVICE_RATES),
)(
    lambda spark, sf: K.availability(*_requests_and_errors(spark, sf), _BY).withColumn(
        "availability", rounded(F.col("availability"))
    )
)
query(
    "kpi_dashboard_by_service",
    sql(
        "select service_name, round(coalesce(calls, 0), 6) + 0.0 as calls_per_s, round(coalesce(peak, 0), 6) + 0.0 as peak_calls_per_s, "
        "round(coalesce(ratio, 0), 6) + 0.0 as error_ratio, requests, errors, round(availability, 6) + 0.0 as availability, "
        "case when coalesce(ratio, 0) >= 0.05 then 'err' when coalesce(ratio, 0) >= 0.01 then 'warn' else 'ok' end as error_tone, "
        "case when availability < 0.9 then 'err' when availability < 0.99 then 'warn' else 'ok' end as availability_tone, p50, p95, p99, "
        "case when p95 >= 1 then 'err' when p95 >= 0.2 then 'warn' else 'ok' end as p95_tone from sup "
        "left join (select service_name, arg_max(p50, (ts_ms, p50)) as p50, arg_max(p95, (ts_ms, p95)) as p95, arg_max(p99, (ts_ms, p99)) as p99 from "
        f"(select event_type, service_name, ts_ms, {', '.join(f'{_point_quantile(q)} as p{q * 100:.0f}' for q in (0.5, 0.95, 0.99))} from pts group by all) group by all) using (service_name) "
        "left join (select service_name, arg_max(rate, ts) as calls, max(rate) as peak from srates where kind = 'requests' group by all) using (service_name) "
        "left join (select service_name, arg_max(ratio, ts) as ratio from sratio group by all) using (service_name)",
        "ev",
        "hist",
        _PTS,
        _SERVICE_RATES,
    ),
)(
    lambda spark, sf: K.dashboard(*_requests_and_errors(spark, sf), V.histogram_points(spark, sf), _SPAN_NS, _BY)
    .withColumns({c: rounded(F.col(c)) for c in ("calls_per_s", "peak_calls_per_s", "error_ratio", "availability", "p50", "p95", "p99")})
)
query(
    "series_split",
    sql(
        "select event_type, service_name, count(*) as points, min(us) * 1000 as first_ts, max(us) * 1000 as last_ts, arg_max(value, (us, value)) as last_value from ev group by all",
        "ev",
    ),
)(lambda spark, sf: K.split_series(_counter_points(spark, sf), SERIES))
query(
    "latest_histogram",
    sql(
        "select event_type, service_name, max(ts_ms) * 1000000 as ts_unix_nano, "
        + ", ".join(f"arg_max(b[{i}], ts_ms) as b{i}" for i in range(1, 10))
        + " from hist group by all",
        "hist",
    ),
)(
    lambda spark, sf: K.latest_histogram(V.histogram_points(spark, sf), SERIES).select(
        *SERIES, "ts_unix_nano", *[F.get("bucket_counts", F.lit(i - 1)).alias(f"b{i}") for i in range(1, 10)]
    )
)

# --- panels ---------------------------------------------------------------------------------------

_STEPS = [(None, "green"), (50.0, "orange"), (150.0, "red")]
_CLASS = "case when value >= 150 then 'err' when value >= 50 then 'warn' else 'ok' end"
_AT = GRID.start_ms + 10 * DAY_MS
_ONE = f"one as (select {_AT} as t_ms)"


def _now(spark, sf) -> DataFrame:
    return instant_select(V.gauge(spark, sf), Grid.instant(_AT), DAY_MS)


def _steps(spark, sf) -> DataFrame:
    return instant_select(V.gauge(spark, sf), GRID, LOOKBACK)


query(
    "panel_timeseries",
    sql(
        "select 'avg' as target, event_type, t_ms, round(avg(value), 6) + 0.0 as value from inst group by all union all "
        "select 'max', event_type, t_ms, round(max(value), 6) + 0.0 from inst group by all",
        "steps",
        "gauge",
        latest("gauge", LOOKBACK),
    ),
)(
    lambda spark, sf: show(
        P.timeseries({"avg": A.avg(_steps(spark, sf), by=["event_type"]), "max": A.max_(_steps(spark, sf), by=["event_type"])}),
        ["event_type"],
        "target",
    )
)
query(
    "panel_table",
    sql("select event_type as Kind, service_name, value as Amount from inst", "ev", "gauge", _ONE, latest("gauge", DAY_MS, "one")),
)(
    lambda spark, sf: P.table(
        _now(spark, sf), ["event_type", "job", "service_name"], {"event_type": "Kind", "Value": "Amount"}, ["JOB"]
    )
)
query(
    "panel_stat_grid",
    sql(
        f"select event_type, service_name, arg_max(value, t_ms) as value, {_CLASS.replace('value', 'arg_max(value, t_ms)')} as class from inst group by all",
        "steps",
        "gauge",
        latest("gauge", LOOKBACK),
    ),
)(
    lambda spark, sf: P.stat_grid(_steps(spark, sf), _STEPS).select(
        *[L.label("labels_fp", k).alias(k) for k in SERIES], "value", "class"
    )
)
query(
    "stat_single",
    sql(
        f"select t_ms, round(sum(value), 6) + 0.0 as value, {_CLASS.replace('value', 'sum(value)')} as class from inst group by all",
        "steps",
        "gauge",
        latest("gauge", LOOKBACK),
    ),
)(lambda spark, sf: P.single_stat(_steps(spark, sf), _STEPS).withColumn("value", rounded(F.col("value"))))
query(
    "panel_bar_gauge",
    sql(
        f"select event_type, service_name, value, max(value) over () as max, {_CLASS} as class from inst",
        "ev",
        "gauge",
        _ONE,
        latest("gauge", DAY_MS, "one"),
    ),
)(
    lambda spark, sf: P.bar_gauge(_now(spark, sf), _STEPS).select(
        *[L.label("labels_fp", k).alias(k) for k in SERIES], "value", "max", "class"
    )
)
query(
    "panel_pie",
    sql(
        "select event_type, service_name, value, round(value / sum(value) over (), 6) + 0.0 as share from inst",
        "ev",
        "gauge",
        _ONE,
        latest("gauge", DAY_MS, "one"),
    ),
)(
    lambda spark, sf: P.pie(_now(spark, sf)).select(
        *[L.label("labels_fp", k).alias(k) for k in SERIES], "value", rounded(F.col("share")).alias("share")
    )
)
query(
    "finite_filter",
    sql(
        "select event_type, service_name, t_ms, round(10 / (value - 5), 6) + 0.0 as value from inst where value <> 5",
        "steps",
        "gauge",
        "floored as (select event_type, service_name, ts_ms, floor(value / 5) * 5 as value from gauge)",
        latest("floored", LOOKBACK),
    ),
)(
    lambda spark, sf: show(
        P.finite(
            B.arithmetic(
                10,
                "/",
                B.arithmetic(
                    _steps(spark, sf).withColumn("value", F.floor(F.col("value") / 5).cast("double") * 5), "-", 5
                ),
            )
        ),
        SERIES,
    )
)

# --- alerts ---------------------------------------------------------------------------------------

_RULE = "select event_type as rule_id, t_ms, sum(value) as v from inst group by all"


def _ticks(spark, sf) -> DataFrame:
    """Per event type and step: condition ``sum of values > 250``."""
    v = A.sum_(_steps(spark, sf), by=["event_type"])
    return v.select(
        L.label("labels_fp", "event_type").alias("rule_id"),
        "t_ms",
        (F.col("value") > 250).alias("firing"),
        F.round("value", 6).alias("value"),
    )


def _rules(spark, sf) -> DataFrame:
    """One enabled rule per event type, firing after twelve hours."""
    kinds = V.table(spark, sf, "events").select(F.col("event_type").alias("rule_id")).distinct()
    return kinds.select("rule_id", F.lit(True).alias("enabled"), F.lit(43_200).alias("for_s"), F.lit(0).alias("every_s"))


# runs of equal conditions give every state: a run's first firing tick is Pending, later ones Firing once
# twelve hours have passed; the first quiet tick after Firing is Resolved
_HISTORY = (
    f"ticks as (select rule_id, t_ms, v > 250 as firing, round(v, 6) as value from ({_RULE})), "
    "edges as (select *, coalesce(firing <> lag(firing) over w, true) as edge from ticks window w as (partition by rule_id order by t_ms)), "
    "runs as (select *, max(case when edge then t_ms end) over (partition by rule_id order by t_ms) as run_start from edges), "
    "fires as (select *, firing and t_ms > run_start and t_ms - run_start >= 43200000 as up from runs), "
    "history as (select rule_id, t_ms, value, case when up then 'Firing' when firing then 'Pending' "
    "when edge and lag(up) over w then 'Resolved' else 'Ok' end as state, "
    "case when up and not coalesce(lag(up) over w, false) then 'Firing' when not firing and edge and lag(up) over w then 'Resolved' end as notify "
    "from fires window w as (partition by rule_id order by t_ms))"
)
query(
    "alert_state_machine",
    sql("select rule_id, t_ms, state, notify, value from history", "steps", "gauge", latest("gauge", LOOKBACK), _HISTORY),
)(
    lambda spark, sf: AL.state_history(_ticks(spark, sf), _rules(spark, sf)).select(
        "rule_id", "t_ms", "state", "notify", "value"
    )
)
query(
    "alert_transitions",
    sql(
        "select rule_id, t_ms, notify from history where notify is not null",
        "steps",
        "gauge",
        latest("gauge", LOOKBACK),
        _HISTORY,
    ),
)(
    lambda spark, sf: AL.transitions(AL.state_history(_ticks(spark, sf), _rules(spark, sf))).select(
        "rule_id", "t_ms", "notify"
    )
)
_EVERY_S = 50_000


def _paced_rules(spark, sf) -> DataFrame:
    """Evaluated every 50,000 seconds at most, firing after twelve hours; those of clicks are disabled."""
    return _rules(spark, sf).withColumn("every_s", F.lit(_EVERY_S)).withColumn("enabled", F.col("rule_id") != "click")


query(
    "alert_paced_rules",
    sql(
        "select rule_id, t_ms, state, notify, value, max(case when edge_down then t_ms end) over w as resolved_ms from (select *, notify = 'Resolved' as edge_down from history) "
        "window w as (partition by rule_id order by t_ms)",
        "steps",
        "gauge",
        latest("gauge", LOOKBACK),
        f"every_tick as (select rule_id, t_ms, v > 250 as firing, round(v, 6) as value from ({_RULE}) where rule_id <> 'click')",
        "walk(rule_id, t_ms) as (select rule_id, min(t_ms) from every_tick group by rule_id union all "
        f"select w.rule_id, min(k.t_ms) from walk w join every_tick k on k.rule_id = w.rule_id and k.t_ms >= w.t_ms + {_EVERY_S * 1000} group by w.rule_id, w.t_ms)",
        _HISTORY.replace(_HISTORY[: _HISTORY.index("edges as")], "ticks as (select * from every_tick join walk using (rule_id, t_ms)), "),
    ),
)(
    lambda spark, sf: AL.state_history(_ticks(spark, sf), _paced_rules(spark, sf)).select(
        "rule_id", "t_ms", "state", "notify", "value",
        F.max(F.when(F.col("notify") == AL.RESOLVED, F.col("t_ms")))
        .over(Window.partitionBy("rule_id").orderBy("t_ms")).alias("resolved_ms"),
    )
)
_LATEST = "latest as (select rule_id, arg_max(state, t_ms) as state from history group by all)"
query(
    "alert_overview",
    sql(
        "select state, count(*) as rules from latest where state <> 'Ok' group by all",
        "steps",
        "gauge",
        latest("gauge", LOOKBACK),
        _HISTORY,
        _LATEST,
    ),
)(
    lambda spark, sf: AL.state_overview(
        _rules(spark, sf), AL.latest_states(AL.state_history(_ticks(spark, sf), _rules(spark, sf)))
    )
)
query(
    "alert_state_filter",
    sql("select rule_id, state from latest where state = 'Ok'", "steps", "gauge", latest("gauge", LOOKBACK), _HISTORY, _LATEST),
)(
    lambda spark, sf: AL.rules_in_state(
        _rules(spark, sf), AL.latest_states(AL.state_history(_ticks(spark, sf), _rules(spark, sf))), "ok"
    ).select("rule_id", "state")
)
query(
    "alert_metric",
    sql(
        "select t_ms, count(case when value > 300 then 1 end) > 0 as firing, max(case when value > 300 then 1 else 0 end)::double as value, "
        "count(case when value > 300 then 1 end) as hits, count(*) as total from inst group by all",
        "steps",
        "gauge",
        latest("gauge", LOOKBACK),
    ),
)(
    lambda spark, sf: AL.metric_condition(B.comparison(_steps(spark, sf), ">", 300, bool_=True)).select(
        "t_ms", "firing", "value", "hits", "total"
    )
)
