"""Log queries over events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query
from catalog.views import sql
from telmora.operators import logs as G
from telmora.operators.alerts import log_condition
from telmora.operators.traces import logs_of_traces
from telmora.plans import panels as P

_COLS = ["event_id", "ts_unix_nano", "severity", "body", "service_name"]
_SQL_COLS = ", ".join(_COLS)
_DAY = 86_400_000_000_000
_FROM, _TO = V.EVENTS_FROM_MS * 1_000_000 + 5 * _DAY, V.EVENTS_FROM_MS * 1_000_000 + 25 * _DAY


def _search(name: str, where: str, **kw) -> None:
    query(name, sql(f"select {_SQL_COLS} from logs where {where}", "logs"))(
        lambda spark, sf: G.search_logs(V.logs(spark, sf), **kw).select(*_COLS)
    )


_search("log_search_severity", f"severity >= 13 and ts_unix_nano between {_FROM} and {_TO}", min_severity=13, from_ns=_FROM, to_ns=_TO)
_search("log_attr_eq", "uid = '7'", attributes=[("user_id", "=", "7")])
_search("log_attr_ne", "kind <> 'click' and k is not null", attributes=[("kind", "!=", "click"), ("k", "!=", "none")])
_search("log_attr_re", "regexp_matches(k, '^1.$') and regexp_matches(uid, '[05]$')", attributes=[("k", "=~", "^1.$"), ("user.id", "=~", "[05]$")])
_search("log_attr_nre", "not regexp_matches(uid, '^1')", attributes=[("user.id", "!~", "^1")])
_search("log_service_version", "service_name in ('svc-1', 'svc-3') and version = 'v2'", service_names=["svc-1", "svc-3"], service_version="v2")
_search("log_text_search", "body like '% by user 7' and severity >= 5", text="BY  user 7", min_severity=5)
_search("log_trace_equality", "trace_id = 'trace-12'", trace_id="trace-12")

_NORMAL = "' ' || trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' '"
query(
    "log_text_phrase",
    f"select doc_id as event_id, source as service_name from documents where {_NORMAL} like '% que des %' or {_NORMAL} like '% the of %'",
)(
    lambda spark, sf: G.search_logs(V.document_logs(spark, sf), text="QUÉ (des)")
    .unionByName(G.search_logs(V.document_logs(spark, sf), text="the: of"))
    .select("event_id", "service_name")
    .distinct()
)


def _match(name: str, where: str, **kw) -> None:
    query(name, sql(f"select {_SQL_COLS} from logs where {where}", "logs"))(
        lambda spark, sf: G.match_logs(G.search_logs(V.logs(spark, sf)), **kw).select(*_COLS)
    )


_match(
    "log_line_filters",
    "contains(body, 'user 1') and not contains(body, 'click') and regexp_matches(body, 'r 1[0-4]') and not regexp_matches(body, '^view')",
    lines=[("|=", "user 1"), ("!=", "click"), ("|~", "r 1[0-4]"), ("!~", "^view")],
)
_match("log_stream_lenient", "uid <> '3' and regexp_matches(k, '^2')", stream=[("USER_ID", "!=", "3"), ("absent", "=", "x"), ("K", "=~", "^2")])

query(
    "log_sorted_page",
    sql(f"select {_SQL_COLS} from logs order by severity desc, ts_unix_nano, event_id limit 40 offset 15", "logs"),
)(
    lambda spark, sf: G.log_page(
        G.search_logs(V.logs(spark, sf)), "severity", "desc", 40, 15, ("ts_unix_nano", "event_id")
    ).select(*_COLS)
)
query(
    "latest_errors",
    sql(f"select {_SQL_COLS} from logs where severity >= 17 order by ts_unix_nano desc, event_id limit 5", "logs"),
)(lambda spark, sf: G.latest_error_logs(V.logs(spark, sf), 5, ("event_id",)).select(*_COLS))
query(
    "log_group_by_service",
    sql(
        "select service_name as service_group, event_id, max(ts_unix_nano) over (partition by service_name) as group_newest from logs",
        "logs",
    ),
)(
    lambda spark, sf: G.group_by_service(G.search_logs(V.logs(spark, sf)), ties=("event_id",)).select(
        "service_group", "event_id", "group_newest"
    )
)

query(
    "trace_logs",
    "select conv_id, turn, length(text)::int as len from conversations where conv_id in (select conv_id from conversations where turn >= 6)",
)(lambda spark, sf: _trace_logs(spark, sf))


def _trace_logs(spark, sf) -> DataFrame:
    """Turns as logs of the conversations that have a span number 6 or higher."""
    turns = V.table(spark, sf, "conversations").withColumns(
        {"trace_id": F.col("conv_id").cast("string"), "ts_unix_nano": F.col("turn")}
    )
    long = V.tree_spans(spark, sf).where(F.col("span_id") >= 6)
    return logs_of_traces(turns, long).select("conv_id", "turn", F.length("text").alias("len"))


query(
    "panel_logs",
    sql(
        f"select {_SQL_COLS}, row_number() over (order by ts_unix_nano desc, event_id) as position, greatest(0, count(*) over () - 100) as truncated from ("
        f"select * from logs where body like '%user%' and ts_unix_nano between {_FROM} and {_TO}) "
        "where regexp_matches(body, '[0-7]$') and uid <> '11' qualify position <= 100",
        "logs",
    ),
)(
    lambda spark, sf: P.logs_panel(
        V.logs(spark, sf), _FROM, _TO, [("user_id", "!=", "11")], [("|=", "user"), ("|~", "[0-7]$")], ("event_id",)
    ).select(*_COLS, F.col("position").cast("long").alias("position"), "truncated")
)

query(
    "alert_log",
    sql(
        f"select count(*) > 1000 as firing, count(*)::double as value from (select 1 from logs where severity >= 13 and body like '% by user %' and ts_unix_nano between {_TO - 15 * _DAY} and {_TO})",
        "logs",
    ),
)(lambda spark, sf: log_condition(V.logs(spark, sf), _TO, 15 * 86_400, 1000, text="by user", min_severity=13))
