"""Trace and span queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query
from catalog.views import sql
from telmora.operators import traces as T
from telmora.operators.alerts import trace_condition

_SUMMARY = (
    "select trace_id, min(start_ns) as first_start, max(end_ns) as last_end, max(end_ns) - min(start_ns) as duration_ns, "
    "count(*) as span_count, max((status_code = 2)::int) = 1 as has_error from spans {where} group by trace_id"
)
_MID = 898_000_000_000_000_000


def _summary(name: str, where: str = "", having: str = "", **kw) -> None:
    query(name, sql(_SUMMARY.format(where=where) + having, "spans"))(
        lambda spark, sf: T.trace_summaries(V.spans(spark, sf), **kw)
    )


_summary("trace_summary")
_summary("trace_summary_range", f"where start_ns between {_MID} and {_MID + 10**16}", from_ns=_MID, to_ns=_MID + 10**16)
_summary("trace_error_filter", having=" having max((status_code = 2)::int) = 0", has_error=False)
_summary(
    "trace_service_filter",
    "where trace_id in (select trace_id from spans where service_name in ('svc-o', 'svc-x'))",
    service_names=["svc-o", "", "svc-x"],
)
_summary(
    "trace_service_version_pair",
    "where trace_id in (select trace_id from spans where service_name = 'svc-f' and version = '1.r')",
    service_name="svc-f",
    service_version="1.r",
)
_summary(
    "trace_name_search",
    "where trace_id in (select trace_id from spans where name = 'POST order line')",
    name_contains="order: LINE",
)

query(
    "trace_summary_sorted_page",
    sql(_SUMMARY.format(where="") + " order by duration_ns desc, trace_id limit 50 offset 20", "spans"),
)(lambda spark, sf: T.trace_page(T.trace_summaries(V.spans(spark, sf)), "duration", "desc", 50, 20))

_ROOT = (
    "root as (select trace_id, arg_min(name, (parent_id is not null, start_ns, span_id, name, service_name)) as root_name, "
    "arg_min(service_name, (parent_id is not null, start_ns, span_id, name, service_name)) as root_service from spans group by trace_id)"
)
query("trace_roots", sql("select * from root", "spans", _ROOT))(lambda spark, sf: T.trace_roots(V.spans(spark, sf)))
query(
    "trace_page_with_roots",
    sql(
        f"select p.*, root_name, root_service from ({_SUMMARY.format(where='')} order by span_count asc, trace_id limit 30) p join root using (trace_id)",
        "spans",
        _ROOT,
    ),
)(lambda spark, sf: T.with_roots(T.trace_page(T.trace_summaries(V.spans(spark, sf)), "spans", "asc", 30), V.spans(spark, sf)))

query(
    "trace_tree_order",
    sql(
        "select trace_id, span_id, depth, row_number() over (partition by trace_id order by path) as position from walk",
        "tree",
        "walk as (select trace_id, span_id, 0 as depth, [(start_ns, span_id)] as path from tree where parent_id is null union all "
        "select c.trace_id, c.span_id, w.depth + 1, list_append(w.path, (c.start_ns, c.span_id)) from walk w join tree c on c.trace_id = w.trace_id and c.parent_id = w.span_id)",
    ),
)(
    lambda spark, sf: T.trace_tree_order(V.tree_spans(spark, sf)).select(
        "trace_id", "span_id", "depth", F.col("position").cast("long").alias("position")
    )
)

query(
    "trace_start_histogram",
    sql(
        "select r.trace_id, i::int as bucket, s + (e - s) * i // 8 as from_unix_nano, greatest(s + (e - s) * (i + 1) // 8, s + (e - s) * i // 8 + 1) as to_unix_nano, "
        "count(b.trace_id) as n from r cross join range(8) g(i) left join b on b.trace_id = r.trace_id and b.bucket = i group by all",
        "tree",
        "r as (select trace_id, min(start_ns) as s, greatest(max(end_ns), min(start_ns) + 1) as e from tree group by trace_id)",
        "b as (select t.trace_id, least(7, greatest(0, floor((start_ns - s) * 8.0::double / (e - s)))) as bucket from tree t join r using (trace_id))",
    ),
)(
    lambda spark, sf: T.start_histogram(V.tree_spans(spark, sf), 8).select(
        "trace_id", "bucket", "from_unix_nano", "to_unix_nano", F.col("n").cast("long").alias("n")
    )
)

_SPAN_COLS = ["trace_id", "span_id", "name", "kind", "start_unix_nano", "duration_ns", "status_code"]
_SPAN_SQL = "trace_id, span_id, name, kind, start_ns as start_unix_nano, duration_ns, status_code"
query(
    "span_list_server_errors",
    sql(f"select {_SPAN_SQL} from spans where kind = 1 and status_code >= 2 and start_ns >= {_MID} and seq = 1", "spans"),
)(
    lambda spark, sf: T.list_spans(T.deduplicate_spans(V.spans(spark, sf)), _MID, kind=1, min_status=2).select(*_SPAN_COLS)
)
query(
    "span_page_newest",
    sql(
        f"select {_SPAN_SQL} from spans where kind = 1 order by start_ns desc, trace_id, span_id, duration_ns, status_code, name limit 100 offset 10",
        "spans",
    ),
)(
    lambda spark, sf: T.newest_first(
        T.list_spans(V.spans(spark, sf), kind=1),
        "start_unix_nano",
        "trace_id",
        "span_id",
        "duration_ns",
        "status_code",
        "name",
        limit=100,
        offset=10,
    ).select(*_SPAN_COLS)
)
query(
    "span_dedup_first_write",
    sql(f"select {_SPAN_SQL} from spans where seq = 1", "spans"),
)(lambda spark, sf: T.deduplicate_spans(V.spans(spark, sf)).select(*_SPAN_COLS))

query(
    "trace_fetch",
    sql(f"select {_SPAN_SQL} from spans where trace_id = lpad('7', 32, '0')", "spans"),
)(lambda spark, sf: T.trace_spans(V.spans(spark, sf), "7".rjust(32, "0")).select(*_SPAN_COLS))

query(
    "trace_ranges",
    sql("select trace_id, min(start_ns) as start, greatest(max(end_ns), min(start_ns) + 1) as \"end\" from spans group by trace_id", "spans"),
)(lambda spark, sf: T.trace_ranges(V.spans(spark, sf)))

query(
    "latest_error_traces",
    sql(_SUMMARY.format(where="") + " having max((status_code = 2)::int) = 1 order by first_start desc, trace_id limit 5", "spans"),
)(lambda spark, sf: T.latest_error_traces(V.spans(spark, sf)))

query(
    "alert_trace",
    sql(
        f"select count(*) > 100 as firing, count(*)::double as value from (select trace_id from spans where start_ns between {_MID} and {_MID + 3 * 10**16} "
        "and trace_id in (select trace_id from spans where service_name = 'svc-f') group by trace_id having max((status_code = 2)::int) = 1)",
        "spans",
    ),
)(
    lambda spark, sf: trace_condition(
        V.spans(spark, sf), _MID + 3 * 10**16, 3 * 10**7, 100, has_error=True, service_name="svc-f"
    )
)
