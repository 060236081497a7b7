"""Telemetry views of the test tables, for Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telmora.functions.integers import int_div
from telmora.operators.histogram import bucket_counts
from telmora.operators.samples import samples_from_columns
from telmora.operators.selectors import Grid

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
WEEK_MS = 7 * DAY_MS
# All events lie in January 2024; the grids and ranges below cover every one of them.
GRID = Grid(1_704_067_200_000 + 6 * HOUR_MS, 1_704_067_200_000 + 30 * DAY_MS, 6 * HOUR_MS)
DAILY = Grid(1_704_067_200_000 + 12 * HOUR_MS, 1_704_067_200_000 + 29 * DAY_MS + 12 * HOUR_MS, DAY_MS)
EVENTS_FROM_MS = 1_704_067_200_000
EVENTS_TO_MS = 1_704_067_200_000 + 30 * DAY_MS
HIST_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)
SPANS_FROM_NS = 788_918_400_000_000_000  # 1995-01-01
SPANS_TO_NS = 1_009_843_200_000_000_000  # 2002-01-01


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp_ltz"))


def _text(c: Column) -> Column:
    return c.cast("string")


def _idiv(c: Column, n: int) -> Column:
    return int_div(c, n)


# --- events -----------------------------------------------------------------------------------


def _service() -> Column:
    return F.concat(F.lit("svc-"), _text(F.col("user_id") % 5))


def _ts_ms() -> Column:
    return _idiv(micros(F.col("ts")), 1000)


def counter_value() -> Column:
    """A counter per series that grows with time and starts again every week."""
    return _idiv(_ts_ms() % F.lit(WEEK_MS), 1000) * (1 + F.col("user_id") % 5) / F.lit(4.0)


def _samples(events: DataFrame, name: str, value: Column, delta: bool = False) -> DataFrame:
    labels = {"__name__": name, "event_type": F.col("event_type"), "job": _service(), "service_name": _service()}
    return samples_from_columns(events, labels, _ts_ms(), value, delta)


def counter(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(table(spark, sf, "events"), "app_value_total", counter_value())


def gauge(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(table(spark, sf, "events"), "app_level", F.col("value"))


def delta(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long").cast("double")
    return _samples(table(spark, sf, "events"), "app_cents_total", cents, True)


def metric_points(spark: SparkSession, sf: str) -> DataFrame:
    """Counter ``app.value``, gauge ``app.level`` (%) and delta counter ``app.cents`` as stored points."""
    e = table(spark, sf, "events")
    kinds = F.explode(
        F.array(
            _kind("app.value", "1", 1, 2, counter_value()),
            _kind("app.level", "%", 0, 0, F.col("value")),
            _kind("app.cents", None, 1, 1, F.round(F.col("value") * 100)),
        )
    )
    none = F.lit(None)
    return e.select(
        "event_id",
        kinds.alias("k"),
        (micros(F.col("ts")) * 1000).alias("ts_unix_nano"),
        F.create_map(F.lit("event.type"), F.col("event_type")).alias("attrs"),
        F.create_map(F.lit("service.name"), _service()).alias("resource"),
    ).select(
        "event_id",
        "k.name",
        "k.unit",
        "k.type",
        "k.temporality",
        "ts_unix_nano",
        "k.value",
        none.cast("long").alias("count"),
        none.cast("double").alias("sum"),
        none.cast("double").alias("min"),
        none.cast("double").alias("max"),
        none.cast("array<bigint>").alias("bucket_counts"),
        none.cast("array<double>").alias("explicit_bounds"),
        "attrs",
        "resource",
        none.cast("string").alias("scope_name"),
        none.cast("string").alias("scope_version"),
    )


def _kind(name: str, unit: str | None, type_: int, temp: int, value: Column) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(unit).cast("string").alias("unit"),
        F.lit(type_).alias("type"),
        F.lit(temp).alias("temporality"),
        value.cast("double").alias("value"),
    )


def histogram_points(spark: SparkSession, sf: str, width_ms: int = DAY_MS, temporality: int = 1) -> DataFrame:
    """One histogram point ``app.duration`` (ms) per series and time bucket."""
    ts = _ts_ms()
    return (
        table(spark, sf, "events")
        .groupBy("event_type", _service().alias("service_name"), (ts - ts % F.lit(width_ms)).alias("ts_ms"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum("value").alias("sum"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            bucket_counts(F.col("value"), HIST_BOUNDS).alias("bucket_counts"),
        )
        .select(
            "event_type",
            "service_name",
            F.lit("app.duration").alias("name"),
            F.lit("ms").alias("unit"),
            F.lit(2).alias("type"),
            F.lit(temporality).alias("temporality"),
            (F.col("ts_ms") * 1_000_000).alias("ts_unix_nano"),
            F.col("sum").alias("value"),
            "count",
            "sum",
            "min",
            "max",
            "bucket_counts",
            F.array(*[F.lit(b) for b in HIST_BOUNDS]).alias("explicit_bounds"),
            F.create_map(
                F.lit("event.type"), F.col("event_type"), F.lit("service.name"), F.col("service_name")
            ).alias("labels"),
        )
    )


def logs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    severity = (
        F.when(kind == "error", 17).when(kind == "purchase", 13).when(kind == "signup", 9).when(kind == "click", 5).otherwise(1)
    )
    user = _text(F.col("user_id"))
    return table(spark, sf, "events").select(
        "event_id",
        (micros(F.col("ts")) * 1000).alias("ts_unix_nano"),
        F.concat(F.lit("trace-"), user).alias("trace_id"),
        F.lit(None).cast("string").alias("span_id"),
        severity.alias("severity"),
        F.concat(kind, F.lit(" by user "), user).alias("body"),
        F.create_map(
            F.lit("user.id"), user, F.lit("k"), F.get_json_object("props", "$.k"), F.lit("kind"), kind
        ).alias("attrs"),
        F.create_map(
            F.lit("service.name"), _service(), F.lit("service.version"), F.concat(F.lit("v"), _text(F.col("user_id") % 3))
        ).alias("resource"),
    )


def document_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as multilingual log bodies."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("event_id"),
        F.col("doc_id").alias("ts_unix_nano"),
        F.lit(None).cast("string").alias("trace_id"),
        F.lit(9).alias("severity"),
        F.col("text").alias("body"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("attrs"),
        F.create_map(F.lit("service.name"), F.col("source")).alias("resource"),
    )


# --- lineitem, conversations ------------------------------------------------------------------


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """One span per order line; the order is the trace."""
    line = F.col("l_linenumber")

    def padded(c: Column, n: int) -> Column:
        return F.lpad(_text(c), n, "0")

    start = micros(F.col("l_shipdate")) * 1000 + line.cast("long") * 1_000_000_000
    duration = (F.col("l_quantity") * 100_000_000).cast("long")
    method = F.when(line % 2 == 0, "GET").when(line % 5 == 0, F.lit(None)).otherwise("POST")
    status = F.when(F.col("l_tax") > 0.06, F.lit(None)).when(F.col("l_returnflag") == "R", "500").otherwise("200")
    attrs = F.create_map(
        F.lit("http.route"),
        F.concat(F.lit("/api/v1/parts/"), _text(F.col("l_partkey") % 5)),
        F.lit("http.method"),
        method,
        F.lit("http.response.status_code"),
        status,
    )
    resource = F.create_map(
        F.lit("service.name"),
        F.concat(F.lit("svc-"), F.lower("l_linestatus")),
        F.lit("service.version"),
        F.concat(F.lit("1."), F.lower("l_returnflag")),
    )
    return table(spark, sf, "lineitem").select(
        padded(F.col("l_orderkey"), 32).alias("trace_id"),
        padded(line, 16).alias("span_id"),
        F.when(line != 1, padded(_idiv(line, 2), 16)).alias("parent_id"),
        F.when(line % 2 == 0, "GET part").otherwise("POST order line").alias("name"),
        F.when(line % 3 == 0, 2).otherwise(1).alias("kind"),
        start.alias("start_unix_nano"),
        (start + duration).alias("end_unix_nano"),
        duration.alias("duration_ns"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("status_code"),
        attrs.alias("attrs"),
        resource.alias("resource"),
        F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate").alias(
            "ingest_seq"
        ),
    )


def tree_spans(spark: SparkSession, sf: str) -> DataFrame:
    """A binary tree per conversation."""
    turn = F.col("turn")
    start = F.col("conv_id") * 1_000_000_000 + turn * 1000
    return table(spark, sf, "conversations").select(
        _text(F.col("conv_id")).alias("trace_id"),
        turn.alias("span_id"),
        F.when(turn != 0, _idiv(turn - 1, 2)).alias("parent_id"),
        F.col("role").alias("name"),
        start.alias("start_unix_nano"),
        (start + F.length("text")).alias("end_unix_nano"),
    )


def page_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as spans: path of the URL = route, length of the HTML = duration."""
    route = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    return table(spark, sf, "pages").select(
        _text(F.col("page_id")).alias("trace_id"),
        F.lit("GET").alias("name"),
        F.lit(1).alias("kind"),
        F.length("html").cast("long").alias("duration_ns"),
        F.when(F.col("page_id") % 10 == 0, 2).otherwise(1).alias("status_code"),
        F.create_map(F.lit("http.route"), route).alias("attrs"),
    )


# --- the same as SQL --------------------------------------------------------------------------

_BUCKETS = ", ".join(
    f"count(case when {f'value > {int(HIST_BOUNDS[i - 1])}' if i else 'true'} and "
    f"{f'value <= {int(b)}' if b else 'true'} then 1 end)"
    for i, b in enumerate([*HIST_BOUNDS, None])
)

CTES = {
    "steps": f"select {GRID.start_ms} + i * {GRID.step_ms} as t_ms from range({GRID.steps}) r(i)",
    "days": f"select {DAILY.start_ms} + i * {DAY_MS} as t_ms from range({DAILY.steps}) r(i)",
    "ev": (
        "select event_id, event_type, user_id, 'svc-' || (user_id % 5) as service_name, epoch_us(ts) as us, "
        "epoch_us(ts) // 1000 as ts_ms, value as level, cast(round(value * 100) as bigint) as cents, "
        f"((epoch_us(ts) // 1000) % {WEEK_MS}) // 1000 * (1 + user_id % 5) / 4.0::double as value, props from events"
    ),
    "gauge": "select event_type, service_name, ts_ms, event_id, level as value from ev",
    "counter": "select event_type, service_name, ts_ms, event_id, value from ev",
    "hist": (
        "select event_type, service_name, ts_ms // 86400000 * 86400000 as ts_ms, count(*) as n, sum(level) as s, "
        f"min(level) as mn, max(level) as mx, list_value({_BUCKETS.replace('value', 'level')}) as b "
        "from ev group by all"
    ),
    "logs": (
        "select event_id, us * 1000 as ts_unix_nano, 'trace-' || user_id as trace_id, case event_type when 'error' then 17 "
        "when 'purchase' then 13 when 'signup' then 9 when 'click' then 5 else 1 end as severity, "
        "event_type || ' by user ' || user_id as body, service_name, 'v' || (user_id % 3) as version, "
        "cast(user_id as varchar) as uid, props->>'$.k' as k, event_type as kind from ev"
    ),
    "spans": (
        "select lpad(cast(l_orderkey as varchar), 32, '0') as trace_id, lpad(cast(l_linenumber as varchar), 16, '0') as span_id, "
        "case when l_linenumber = 1 then null else lpad(cast(l_linenumber // 2 as varchar), 16, '0') end as parent_id, "
        "case when l_linenumber % 2 = 0 then 'GET part' else 'POST order line' end as name, "
        "case when l_linenumber % 3 = 0 then 2 else 1 end as kind, "
        "epoch_us(l_shipdate) * 1000 + cast(l_linenumber as bigint) * 1000000000 as start_ns, "
        "cast(l_quantity * 100000000 as bigint) as duration_ns, start_ns + duration_ns as end_ns, "
        "case when l_returnflag = 'R' then 2 else 1 end as status_code, 'svc-' || lower(l_linestatus) as service_name, "
        "'1.' || lower(l_returnflag) as version, '/api/v1/parts/' || (l_partkey % 5) as route, "
        "case when l_linenumber % 2 = 0 then 'GET' when l_linenumber % 5 = 0 then null else 'POST' end as method, "
        "case when l_tax > 0.06 then null when l_returnflag = 'R' then '500' else '200' end as http_status, "
        "row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, "
        "l_extendedprice, l_discount, l_tax, l_shipdate) as seq, l_extendedprice from lineitem"
    ),
    "tree": (
        "select cast(conv_id as varchar) as trace_id, turn as span_id, case when turn = 0 then null else (turn - 1) // 2 end "
        "as parent_id, role as name, conv_id * 1000000000 + turn * 1000 as start_ns, "
        "conv_id * 1000000000 + turn * 1000 + length(text) as end_ns from conversations"
    ),
}
_NEEDS = {"gauge": ["ev"], "counter": ["ev"], "hist": ["ev"], "logs": ["ev"]}


def window(source: str, range_ms: int, offset_ms: int = 0) -> str:
    """CTE ``win``: the points of ``source`` that each step sees, with predecessor inside the window."""
    return (
        f"win as (select w.*, lag(value) over s as pv, lag(ts_ms) over s as pt from (select t_ms, p.* from steps join {source} p "
        f"on p.ts_ms between t_ms - {offset_ms + range_ms} and t_ms - {offset_ms}) w "
        "window s as (partition by event_type, service_name, t_ms order by ts_ms, value))"
    )


def latest(source: str, lookback_ms: int, steps: str = "steps", offset_ms: int = 0) -> str:
    """CTE ``inst``: the newest point per series that each step sees."""
    return (
        "inst as (select event_type, service_name, t_ms, arg_max(value, (ts_ms, value)) as value, max(ts_ms) as sample_ts_ms "
        f"from {steps} join {source} p on p.ts_ms between t_ms - {offset_ms + lookback_ms} and t_ms - {offset_ms} group by all)"
    )


def sql(select: str, *ctes: str) -> str:
    """``select`` with the named views, and with ``name as (…)`` expressions given in full."""
    names: list[str] = []
    own: list[str] = []
    for c in ctes:
        if c in CTES:
            for n in [*_NEEDS.get(c, []), c]:
                if n not in names:
                    names.append(n)
        else:
            own.append(c)
    parts = [f"{n} as ({CTES[n]})" for n in names] + own
    recursive = "recursive " if any("union all" in o and "walk" in o for o in own) else ""
    return (f"with {recursive}" + ",\n".join(parts) + "\n" if parts else "") + select
