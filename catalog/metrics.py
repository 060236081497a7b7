"""Selectors, range functions, aggregations, operators and scalar functions over the event series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import SHIFT, query, rounded, shifted, show
from catalog.views import DAY_MS, GRID, HOUR_MS, latest, sql, window
from telmora.functions import labels as L
from telmora.operators import aggregates as A
from telmora.operators import binary as B
from telmora.operators import ranges as R
from telmora.operators import scalar as S
from telmora.operators.samples import cumulate_delta
from telmora.operators.selectors import Grid, RangeVector, forward_fill, instant_select, range_select

SERIES = ("event_type", "service_name")
LOOKBACK = 6 * HOUR_MS
_S = "event_type, service_name, t_ms"


def _range(spark, sf, source=V.gauge, range_ms=DAY_MS, **kw) -> RangeVector:
    return range_select(source(spark, sf), GRID, range_ms, **kw)


def _instant(spark, sf, source=V.gauge, **kw) -> DataFrame:
    return instant_select(source(spark, sf), kw.pop("grid", GRID), LOOKBACK, **kw)


def _over_time(name: str, fn: Callable, source, table: str, agg: str, range_ms: int = DAY_MS, **kw) -> None:
    def run(spark, sf):
        return show(fn(_range(spark, sf, source, range_ms, **kw)), SERIES)

    offset = kw.get("offset_ms", 0)
    text = sql(f"select {_S}, round({agg}, 6) + 0.0 as value from win group by all", "steps", table, window(table, range_ms, offset))
    query(name, text)(run)


_INC = "(arg_max(value, ts_ms) - arg_min(value, ts_ms) + coalesce(sum(case when value < pv then pv end), 0))::double"
_over_time("range_increase", R.increase, V.counter, "counter", _INC)
_over_time("range_increase_short", R.increase, V.counter, "counter", _INC, 6 * HOUR_MS)
_over_time("range_rate", R.rate, V.counter, "counter", f"{_INC} / 86400")
_over_time("range_delta", R.delta, V.gauge, "gauge", _INC)
_over_time("range_changes", R.changes, V.gauge, "gauge", "count(case when value <> pv then 1 end)::double")
_over_time("range_resets", R.resets, V.counter, "counter", "count(case when value < pv then 1 end)::double")
_LAST2 = "arg_max({}, ts_ms)"
_over_time(
    "range_idelta", R.idelta, V.gauge, "gauge", "arg_max(value - coalesce(pv, 0), ts_ms)"
)
_over_time(
    "range_irate",
    R.irate,
    V.counter,
    "counter",
    "arg_max(case when pt is null then 'nan'::double when value < pv then value / ((ts_ms - pt) / 1000.0) "
    "else (value - pv) / ((ts_ms - pt) / 1000.0) end, ts_ms)",
)
_over_time(
    "range_deriv",
    R.deriv,
    V.gauge,
    "gauge",
    "case when count(*) < 2 then 0 else regr_slope(value, (ts_ms - t_ms) / 1000.0) end",
)
_over_time("avg_over_time", lambda rv: shifted(R.avg_over_time(rv)), V.gauge, "gauge", f"avg(value) + {SHIFT}")
_over_time("sum_over_time", R.sum_over_time, V.gauge, "gauge", "sum(value)")
_over_time("min_over_time", R.min_over_time, V.gauge, "gauge", "min(value)")
_over_time("max_over_time", R.max_over_time, V.gauge, "gauge", "max(value)")
_over_time("count_over_time", R.count_over_time, V.gauge, "gauge", "count(*)::double")
_over_time("present_over_time", R.present_over_time, V.gauge, "gauge", "count(*)::double")
_over_time("last_over_time", R.last_over_time, V.gauge, "gauge", "arg_max(value, (ts_ms, value))")
_over_time("stddev_over_time", R.stddev_over_time, V.gauge, "gauge", "stddev_pop(value)")
_over_time("stdvar_over_time", lambda rv: shifted(R.stdvar_over_time(rv)), V.gauge, "gauge", f"var_pop(value) + {SHIFT}")
_over_time(
    "quantile_over_time", lambda rv: R.quantile_over_time(0.9, rv), V.gauge, "gauge", "quantile_cont(value, 0.9)"
)
_over_time("offset_selector", R.avg_over_time, V.gauge, "gauge", "avg(value)", 12 * HOUR_MS, offset_ms=DAY_MS)

query(
    "range_predict_linear",
    sql(
        f"select {_S}, round(avg(value) + regr_slope(value, x) * (3600 - avg(x)), 6) + 0.0 as value from "
        "(select *, (ts_ms - t_ms) / 1000.0 as x from win) group by all having count(*) >= 2",
        "steps",
        "gauge",
        window("gauge", DAY_MS),
    ),
)(lambda spark, sf: show(R.predict_linear(_range(spark, sf), 3600), SERIES))

query(
    "range_select",
    sql(f"select {_S}, ts_ms, round(value, 6) + 0.0 as value from win", "steps", "gauge", window("gauge", 8 * HOUR_MS)),
)(lambda spark, sf: show(_range(spark, sf, range_ms=8 * HOUR_MS).rows(), SERIES, "ts_ms"))

_RARE_MS = 2 * 60_000
query(
    "absent_over_time",
    sql(
        f"select '' as labels, t_ms, 1.0::double as value from steps where not exists (select 1 from gauge p where p.ts_ms between t_ms - {_RARE_MS} and t_ms)",
        "steps",
        "gauge",
    ),
)(
    lambda spark, sf: R.absent_over_time(_range(spark, sf, range_ms=_RARE_MS)).select(
        F.col("labels_fp").alias("labels"), "t_ms", "value"
    )
)

_AT = GRID.start_ms + 10 * DAY_MS
query(
    "at_selector",
    sql(
        f"select event_type, service_name, steps.t_ms, round(sum(p.value), 6) + 0.0 as value from gauge p, steps where p.ts_ms between {_AT - DAY_MS} and {_AT} group by all",
        "steps",
        "gauge",
    ),
)(lambda spark, sf: show(R.sum_over_time(_range(spark, sf, at_ms=_AT)), SERIES))

query(
    "instant_last_value",
    sql(f"select {_S}, sample_ts_ms, round(value, 6) + 0.0 as value from inst", "steps", "gauge", latest("gauge", LOOKBACK)),
)(lambda spark, sf: show(_instant(spark, sf), SERIES, "sample_ts_ms"))

query(
    "instant_query",
    sql(
        f"select {_S}, round(value, 6) + 0.0 as value from inst",
        "ev",
        "gauge",
        f"one as (select {_AT} as t_ms)",
        latest("gauge", DAY_MS, "one"),
    ),
)(lambda spark, sf: show(instant_select(V.gauge(spark, sf), Grid.instant(_AT), DAY_MS), SERIES))

query(
    "instant_offset_matchers",
    sql(
        f"select {_S}, round(value, 6) + 0.0 as value from inst where service_name <> 'svc-0' and regexp_matches(event_type, '^(c|v)')",
        "steps",
        "gauge",
        latest("gauge", LOOKBACK, offset_ms=HOUR_MS),
    ),
)(
    lambda spark, sf: show(
        _instant(
            spark, sf, offset_ms=HOUR_MS, name="app_level", matchers=[("job", "!=", "svc-0"), ("event_type", "=~", "^(c|v)")]
        ),
        SERIES,
    )
)

query(
    "range_query_grid",
    sql(
        f"select service_name, t_ms, round(sum(value) + {SHIFT}, 6) + 0.0 as value from (select {_S}, {_INC} / 86400 as value from win group by all) group by all",
        "steps",
        "counter",
        window("counter", DAY_MS),
    ),
)(lambda spark, sf: show(shifted(A.sum_(R.rate(_range(spark, sf, V.counter)), by=["service_name"])), ["service_name"]))

_FILL_GAP = 3 * HOUR_MS
query(
    "forward_fill",
    sql(
        "select event_type, service_name, t_ms, round(coalesce(last_value(value ignore nulls) over (partition by event_type, service_name "
        "order by t_ms rows unbounded preceding), 0), 6) + 0.0 as value from (select distinct event_type, service_name from inst) "
        "cross join (select distinct t_ms from inst) left join inst using (event_type, service_name, t_ms)",
        "steps",
        "gauge",
        latest("gauge", _FILL_GAP),
    ),
)(lambda spark, sf: show(forward_fill(instant_select(V.gauge(spark, sf), GRID, _FILL_GAP), GRID), SERIES))

query(
    "delta_cumulate",
    sql(
        "select event_type, service_name, ts_ms, (sum(cents) over (partition by event_type, service_name order by ts_ms, cents "
        "rows unbounded preceding))::double as value from ev",
        "ev",
    ),
)(
    lambda spark, sf: cumulate_delta(V.delta(spark, sf), V.EVENTS_FROM_MS, V.EVENTS_TO_MS).select(
        *[L.label("labels_fp", k).alias(k) for k in SERIES], "ts_ms", "value"
    )
)

query(
    "delta_rate",
    sql(
        f"select {_S}, round({_INC} / 86400, 6) + 0.0 as value from win group by all",
        "steps",
        "ev",
        "total as (select event_type, service_name, ts_ms, (sum(cents) over (partition by event_type, service_name order by ts_ms, cents "
        "rows unbounded preceding))::double as value from ev)",
        window("total", DAY_MS),
    ),
)(
    lambda spark, sf: show(
        R.rate(range_select(cumulate_delta(V.delta(spark, sf), V.EVENTS_FROM_MS, V.EVENTS_TO_MS), GRID, DAY_MS)), SERIES
    )
)

for _name, _aggregate in [("sum", F.sum), ("max", F.max), ("count", F.count)]:
    query(
        f"frame_{_name}_at_samples",
        sql(
            f"select event_type, service_name, ts_ms as t_ms, ({_name}(cents) over (partition by event_type, service_name "
            f"order by ts_ms range between {HOUR_MS} preceding and current row))::double as value from ev",
            "ev",
        ),
    )(
        lambda spark, sf, aggregate=_aggregate: show(R.frame_over_time(V.delta(spark, sf), HOUR_MS, aggregate), SERIES)
        .withColumn("value", F.col("value").cast("double"))
    )


# --- aggregation --------------------------------------------------------------------------------


def _agg(name: str, labels: tuple[str, ...], agg: str, fn: Callable, extra: str = "") -> None:
    cols = "".join(f"{k}, " for k in labels)
    text = sql(f"select {cols}t_ms, round({agg}, 6) + 0.0 as value from inst {extra} group by all", "steps", "gauge", latest("gauge", LOOKBACK))
    query(name, text)(lambda spark, sf: show(fn(_instant(spark, sf)), labels))


_agg("agg_sum_by", ("event_type",), "sum(value)", lambda v: A.sum_(v, by=["event_type"]))
_agg("agg_sum_all", (), "sum(value)", A.sum_)
_agg(
    "agg_avg_without",
    ("event_type",),
    f"avg(value) + {SHIFT}",
    lambda v: shifted(A.avg(v, without=["job", "service_name"])),
)
_agg("agg_stddev", ("service_name",), "stddev_pop(value)", lambda v: A.stddev(v, by=["service_name"]))
_agg(
    "agg_stdvar",
    ("service_name",),
    f"var_pop(value) + {SHIFT}",
    lambda v: shifted(A.stdvar(v, by=["service_name"])),
)
_agg("agg_quantile", ("event_type",), "quantile_cont(value, 0.75)", lambda v: A.quantile(0.75, v, by=["event_type"]))
_agg("agg_count_values", ("service_name",), "count(*)::double", lambda v: A.count_values("service_name", v))

query(
    "agg_min_max",
    sql(
        "select event_type, t_ms, min(value) as low, max(value) as high from inst group by all",
        "steps",
        "gauge",
        latest("gauge", LOOKBACK),
    ),
)(
    lambda spark, sf: _min_max(_instant(spark, sf))
)


def _min_max(v: DataFrame) -> DataFrame:
    low = A.min_(v, by=["event_type"]).select("labels_fp", "t_ms", F.col("value").alias("low"))
    high = A.max_(v, by=["event_type"]).select("labels_fp", "t_ms", F.col("value").alias("high"))
    return low.join(high, ["labels_fp", "t_ms"]).select(
        L.label("labels_fp", "event_type").alias("event_type"), "t_ms", "low", "high"
    )


query(
    "agg_count_group",
    sql(
        "select 'count' as kind, event_type, t_ms, count(*)::double as value from inst group by all union all "
        "select 'group', event_type, t_ms, 1.0::double from inst group by all",
        "steps",
        "gauge",
        latest("gauge", LOOKBACK),
    ),
)(
    lambda spark, sf: show(A.count(_instant(spark, sf), by=["event_type"]), ["event_type"])
    .withColumn("kind", F.lit("count"))
    .unionByName(show(A.group(_instant(spark, sf), by=["event_type"]), ["event_type"]).withColumn("kind", F.lit("group")))
)


def _topk(name: str, direction: str, fn: Callable) -> None:
    text = sql(
        f"select {_S}, sample_ts_ms, round(value, 6) + 0.0 as value from inst qualify row_number() over "
        f"(partition by event_type, t_ms order by value {direction}, service_name) <= 2",
        "steps",
        "gauge",
        latest("gauge", LOOKBACK),
    )
    query(name, text)(lambda spark, sf: show(fn(2, _instant(spark, sf), by=["event_type"]), SERIES, "sample_ts_ms"))


_topk("topk_by", "desc", A.topk)
_topk("bottomk_by", "asc", A.bottomk)


# --- operators ----------------------------------------------------------------------------------

# right-hand vectors: the delta counter's cents as a gauge, and sums per service
_TWO = (
    "gauge",
    "cents as (select event_type, service_name, ts_ms, cents::double as value from ev)",
    latest("gauge", LOOKBACK),
    latest("cents", 2 * HOUR_MS).replace("inst as", "other as"),
)


def _other(spark, sf) -> DataFrame:
    return instant_select(V.delta(spark, sf), GRID, 2 * HOUR_MS)


def _binary(name: str, select: str, fn: Callable, labels=SERIES) -> None:
    query(name, sql(select, "steps", *_TWO))(lambda spark, sf: show(fn(_instant(spark, sf), _other(spark, sf)), labels))


_JOIN = "inst l join other r using (event_type, service_name, t_ms)"
_binary("bin_arith_default", f"select {_S}, round(l.value / r.value, 6) + 0.0 as value from {_JOIN}", lambda l, r: B.arithmetic(l, "/", r))
_binary(
    "bin_arith_on",
    "select event_type, t_ms, round(a.value - b.value, 6) + 0.0 as value from (select event_type, t_ms, sum(value) as value from inst group by all) a "
    "join (select event_type, t_ms, max(value) as value from other group by all) b using (event_type, t_ms)",
    lambda l, r: B.arithmetic(A.sum_(l, by=["event_type"]), "-", A.max_(r, by=["event_type"]), on=["event_type"]),
    ["event_type"],
)
_binary("bin_cmp_filter", f"select {_S}, round(l.value, 6) + 0.0 as value from {_JOIN} where l.value * 100 >= r.value", lambda l, r: B.comparison(B.arithmetic(l, "*", 100), ">=", r).withColumn("value", F.col("value") / 100))
_binary(
    "bin_cmp_bool",
    f"select {_S}, (l.value > r.value)::int::double as value from {_JOIN}",
    lambda l, r: B.comparison(l, ">", r, bool_=True),
)
_PER_SERVICE = "(select service_name, t_ms, sum(value) as value from other group by all) r"
_binary(
    "bin_group_left",
    f"select {_S}, round(l.value / r.value, 6) + 0.0 as value from inst l join {_PER_SERVICE} using (service_name, t_ms)",
    lambda l, r: B.arithmetic(l, "/", A.sum_(r, by=["service_name"]), on=["service_name"], group_left=["event_type"]),
)
_binary(
    "bin_group_right",
    f"select service_name, t_ms, round(r.value / l.value, 6) + 0.0 as value from inst l join {_PER_SERVICE} using (service_name, t_ms)",
    lambda l, r: B.arithmetic(A.sum_(r, by=["service_name"]), "/", l, on=["service_name"], group_right=[]),
    ["service_name"],
)
_binary(
    "bin_ignoring",
    f"select {_S}, round(l.value % r.value, 6) + 0.0 as value from inst l join {_PER_SERVICE} using (service_name, t_ms)",
    lambda l, r: B.arithmetic(l, "%", A.sum_(r, by=["service_name", "job"]), ignoring=["event_type"], group_left=[]),
)
_EXISTS = "exists (select 1 from other r where (r.event_type, r.service_name, r.t_ms) = (l.event_type, l.service_name, l.t_ms))"
_binary("set_and", f"select {_S}, round(value, 6) + 0.0 as value from inst l where {_EXISTS}", B.and_)
_binary("set_unless", f"select {_S}, round(value, 6) + 0.0 as value from inst l where not {_EXISTS}", B.unless)
_binary(
    "set_or",
    f"select {_S}, round(value, 6) + 0.0 as value from other union all select {_S}, round(value, 6) + 0.0 from inst l where not {_EXISTS}",
    lambda l, r: B.or_(r, l),
)
_binary(
    "set_unless_on",
    f"select {_S}, round(value, 6) + 0.0 as value from inst l where not exists (select 1 from other r where r.service_name = l.service_name and r.t_ms = l.t_ms)",
    lambda l, r: B.unless(l, r, on=["service_name"]),
)


def _unary(name: str, value: str, fn: Callable, where: str = "", labels=SERIES, source=V.gauge, cte="gauge") -> None:
    text = sql(f"select {_S}, round({value}, 6) + 0.0 as value from inst {where}", "steps", cte, latest(cte, LOOKBACK))
    query(name, text)(lambda spark, sf: show(fn(_instant(spark, sf, source)), labels))


_unary("scalar_vector", "1000 - value", lambda v: B.arithmetic(1000, "-", v))
_unary("vector_scalar_cmp", "value", lambda v: B.comparison(v, ">", 50), "where value > 50")
_unary("vector_scalar_bool", "(value > 50)::int::double", lambda v: B.comparison(v, ">", 50, bool_=True))
_unary("vector_div_zero", "'inf'::double", lambda v: B.arithmetic(v, "/", 0))
_unary("vector_mod_pow", "(value % 7) ** 2", lambda v: B.arithmetic(B.arithmetic(v, "%", 7), "^", 2))
_unary("unary_minus", "-value", B.negate)
_unary("vector_time_scalar", "value + t_ms / 1000.0", lambda v: B.arithmetic(v, "+", S.time_()))


# --- functions of values and labels ---------------------------------------------------------------

_MATH = {
    "abs": "abs(value - 100)",
    "ceil": "ceil(value - 100)",
    "floor": "floor(value - 100)",
    "sqrt": "case when value < 100 then 'nan'::double else sqrt(abs(value - 100)) end",
    "exp": "exp((value - 100) / 100)",
    "ln": "case when value > 100 then ln(abs(value - 100)) when value = 100 then '-inf'::double else 'nan'::double end",
    "log2": "case when value > 100 then log2(abs(value - 100)) when value = 100 then '-inf'::double else 'nan'::double end",
    "log10": "case when value > 100 then log10(abs(value - 100)) when value = 100 then '-inf'::double else 'nan'::double end",
    "sgn": "sign(value - 100)::double",
    "deg": "degrees(value - 100)",
    "rad": "radians(value - 100)",
}
_TRIG = {
    "sin": "sin(x)",
    "cos": "cos(x)",
    "tan": "tan(x)",
    "asin": "case when abs(x) > 1 then 'nan'::double else asin(greatest(-1, least(1, x))) end",
    "acos": "case when abs(x) > 1 then 'nan'::double else acos(greatest(-1, least(1, x))) end",
    "atan": "atan(x)",
    "sinh": "(exp(x) - exp(-x)) / 2",
    "cosh": "(exp(x) + exp(-x)) / 2",
    "tanh": "(exp(x) - exp(-x)) / (exp(x) + exp(-x))",
}


def _functions(v: DataFrame, names, prepare) -> DataFrame:
    base = prepare(F.col("value"))
    return v.select(
        *[L.label("labels_fp", k).alias(k) for k in SERIES],
        "t_ms",
        *[
            rounded(S.apply(n, base / 100 if n == "exp" else base), 6).alias(f"v_{n}")
            for n in names
        ],
    )


query(
    "fn_math",
    sql(
        f"select {_S}, " + ", ".join(f"round({e}, 6) + 0.0 as v_{n}" for n, e in _MATH.items()) + " from inst",
        "steps",
        "gauge",
        latest("gauge", LOOKBACK),
    ),
)(lambda spark, sf: _functions(_instant(spark, sf), _MATH, lambda c: c - 100))
query(
    "fn_trig",
    sql(
        f"select {_S}, " + ", ".join(f"round({e}, 6) + 0.0 as v_{n}" for n, e in _TRIG.items()) + " from (select *, value / 100 as x from inst)",
        "steps",
        "gauge",
        latest("gauge", LOOKBACK),
    ),
)(lambda spark, sf: _functions(_instant(spark, sf), _TRIG, lambda c: c / 100))

query(
    "fn_round_clamp",
    sql(
        f"select {_S}, round(value) + 0.0 as whole, round(floor(value / 2.5 + 0.5) * 2.5, 6) + 0.0 as fives, greatest(value, 50.0) as low, least(value, 50.0) as high from inst",
        "steps",
        "gauge",
        latest("gauge", LOOKBACK),
    ),
)(lambda spark, sf: _round_clamp(_instant(spark, sf)))


def _round_clamp(v: DataFrame) -> DataFrame:
    from telmora.functions import ieee

    x = F.col("value")
    return v.select(
        *[L.label("labels_fp", k).alias(k) for k in SERIES],
        "t_ms",
        (ieee.round_half_away(x) + 0.0).alias("whole"),
        rounded(ieee.round_half_away(x, 2.5)).alias("fives"),
        ieee.at_least(x, 50).alias("low"),
        ieee.at_most(x, 50).alias("high"),
    )


def _labelled(name: str, select: str, fn: Callable, labels) -> None:
    query(name, sql(select, "steps", "gauge", latest("gauge", LOOKBACK)))(
        lambda spark, sf: show(fn(_instant(spark, sf)), labels)
    )


_labelled(
    "fn_label_replace",
    f"select {_S}, case when service_name <> 'svc-0' then 'n' || service_name[5:] end as num, round(value, 6) + 0.0 as value from inst",
    lambda v: S.label_replace(v, "num", "n$1", "service_name", r"svc-([1-9])"),
    [*SERIES, "num"],
)
_labelled(
    "fn_label_join",
    f"select {_S}, event_type || '/' || service_name as both, round(value, 6) + 0.0 as value from inst",
    lambda v: S.label_join(v, "both", "/", "event_type", "nothing", "service_name"),
    [*SERIES, "both"],
)
_labelled(
    "fn_timestamp",
    f"select {_S}, round(sample_ts_ms / 1000.0, 6) + 0.0 as value from inst",
    S.timestamp,
    SERIES,
)
_labelled(
    "fn_sort",
    f"select {_S}, round(value, 6) + 0.0 as value from inst order by t_ms, value desc",
    S.sort_desc,
    SERIES,
)
query(
    "fn_absent",
    sql(
        "select '' as labels, t_ms, 1.0::double as value from steps where t_ms not in (select t_ms from inst)",
        "steps",
        "gauge",
        latest("gauge", _RARE_MS),
    ),
)(
    lambda spark, sf: S.absent(instant_select(V.gauge(spark, sf), GRID, _RARE_MS), GRID).select(
        F.col("labels_fp").alias("labels"), "t_ms", "value"
    )
)
query(
    "fn_vector_scalar",
    sql(
        "select t_ms, round(sum(value) + any_value(t_ms / 1000.0), 6) + 0.0 as value from inst group by t_ms",
        "steps",
        "gauge",
        latest("gauge", LOOKBACK),
    ),
)(lambda spark, sf: _vector_plus_scalar(spark, _instant(spark, sf)))


def _vector_plus_scalar(spark, v: DataFrame) -> DataFrame:
    """scalar(sum(v)) + vector(time())"""
    one = S.scalar(A.sum_(v)).withColumnRenamed("value", "s")
    base = S.vector(GRID, spark, S.time_())
    return base.join(one, "t_ms").select("t_ms", rounded(F.col("value") + F.col("s")).alias("value"))
