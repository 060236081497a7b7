import pytest
from helpers import one
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telmora import schema as S
from telmora.functions import attributes as A
from telmora.operators import aggregates as AG
from telmora.operators import discovery as D
from telmora.operators import histogram as H
from telmora.operators import logs as LG
from telmora.operators import ranges as R
from telmora.operators import red
from telmora.operators import traces as TR
from telmora.operators import volume as V
from telmora.operators.endpoints import by_calls, endpoint_kpis, endpoint_rollup
from telmora.operators.samples import series_samples
from telmora.operators.selectors import Grid, instant_select, range_select

SEC = 1_000_000_000
SPAN = T.StructType([f for f in S.SPANS.fields if f.name not in ("events", "links", "day")])


def span(trace, sid, parent=None, name="GET /x", kind=1, start=0, end=None, status=1, attrs=None, res=None):
    end = start if end is None else end
    return (trace, sid, parent, name, kind, start, end, max(0, end - start), status, None, attrs or {}, res or {}, None, None)


def spans(spark, rows):
    return spark.createDataFrame(rows, SPAN)


def log(ts, sev, body, attrs=None, res=None, trace=None):
    return (ts, trace, None, sev, None, body, attrs or {}, res or {}, None, None)


def logs(spark, rows):
    return spark.createDataFrame(rows, T.StructType(S.LOGS.fields[:-1]))


LOGS = [
    log(1, 9, "order placed for alice", {"http.route": "/api/orders", "code": "200"}, {"service.name": "shop"}),
    log(2, 17, "payment failed for bob", {"http.route": "/api/billing", "code": "500"}, {"service.name": "billing"}),
    log(3, 17, "db timeout in query", {"http.route": "/api/orders", "code": "500"}, {"service_name": "shop"}),
    log(4, 5, "no attributes"),
]


def bodies(df):
    return sorted(r["ts_unix_nano"] for r in df.collect())


def test_log_attribute_filters(spark):
    l = logs(spark, LOGS)

    def by(*f, **kw):
        return bodies(LG.search_logs(l, attributes=f, **kw))

    assert by(("code", "=", "500")) == [2, 3]
    assert by(("code", "!=", "500")) == [1]
    assert by(("http.route", "=~", "bill")) == [2]
    assert by(("http_route", "!~", "bill")) == [1, 3]
    assert by(("service_name", "=", "shop"), ("code", "=", "500")) == [3]
    assert by(("code", "=", "500"), text="TIMEOUT in") == [3]
    assert by(text="time") == []
    assert by(text="  ") == [1, 2, 3, 4]
    assert by(text="***") == []
    assert by(min_severity=9, from_ns=2) == [2, 3]
    assert by(service_names=["shop", " ", "billing"]) == [1, 2, 3]
    assert by(service_names=[], service_name="billing") == [2]


def test_phrase_ignores_case_and_accents(spark):
    df = spark.createDataFrame([("Größe Café-Crème (neu)",), ("cafe  creme",), ("cafecreme",), (None,)], "t string")
    assert df.where(A.contains_phrase(F.col("t"), "CAFÉ:creme")).count() == 2
    assert df.where(A.contains_phrase(F.col("t"), "große cafe")).count() == 1


def test_phrase_finds_every_latin_letter_with_marks(spark):
    import unicodedata

    lower = [c for c in map(chr, range(0x80, 0x3000)) if c == c.lower() and unicodedata.name(c, "").startswith("LATIN SMALL LETTER")]
    marked = [(c, unicodedata.normalize("NFD", c)) for c in lower if len(unicodedata.normalize("NFD", c)) > 1]
    marked = [(c, d) for c, d in marked if d[0].isascii()]
    assert len(marked) > 200
    rows = [(c.upper() if len(c.upper()) == 1 else c, d, d[0]) for c, d in marked]
    df = spark.createDataFrame(rows, "whole string, apart string, plain string")
    for c in ("whole", "apart"):
        assert df.where(A.searchable(F.col(c)) != A.searchable(F.col("plain"))).count() == 0
    words = spark.createDataFrame([("das ṣaḥīḥ Buch",), ("Tiếng Việt",), ("Straße",)], "t string")
    for phrase in ("sahih", "tieng viet", "TIẾNG viet", "straße"):
        assert words.where(A.contains_phrase(F.col("t"), phrase)).count() == 1
    assert words.where(A.contains_phrase(F.col("t"), "strase")).count() == 0


def test_line_and_stream_filters(spark):
    l = logs(spark, LOGS)
    assert bodies(LG.match_logs(l, lines=[("|=", "for"), ("!=", "bob")])) == [1]
    assert bodies(LG.match_logs(l, lines=[("|~", "^db|^no")])) == [3, 4]
    assert bodies(LG.match_logs(l, lines=[("|~", "")])) == []
    assert bodies(LG.match_logs(l, stream=[("HTTP_ROUTE", "=", "/api/orders")])) == [1, 3, 4]
    assert bodies(LG.match_logs(l, stream=[("Code", "!~", "5..")])) == [1, 4]


def test_log_pages_and_groups(spark):
    l = LG.search_logs(logs(spark, LOGS))
    assert [r["ts_unix_nano"] for r in LG.log_page(l, "severity", "asc", 2, 1, ["ts_unix_nano"]).collect()] == [1, 2]
    many = spark.range(150).select(F.col("id").alias("ts_unix_nano"), F.lit(9).alias("severity"))
    assert [r["ts_unix_nano"] for r in LG.log_page(many).collect()] == list(range(149, -1, -1))  # no limit unless asked for
    grouped = LG.group_by_service(l).collect()
    assert [(r["service_group"], r["ts_unix_nano"]) for r in grouped] == [("(none)", 4), ("shop", 3), ("shop", 1), ("billing", 2)]
    assert bodies(LG.latest_error_logs(logs(spark, LOGS), 1)) == [3]


TREE = [
    span("t", "a", None, start=10, end=50), span("t", "b", "a", start=30), span("t", "c", "a", start=20),
    span("t", "d", "c", start=25), span("t", "o", "gone", start=5), span("u", "x", "y", start=2), span("u", "y", "x", start=1),
    span("u", "z", "", start=9),
]


def test_tree_order(spark):
    got = {(r["trace_id"], r["position"]): (r["span_id"], r["depth"]) for r in TR.trace_tree_order(spans(spark, TREE)).collect()}
    assert got == {
        ("t", 1): ("o", 0), ("t", 2): ("a", 0), ("t", 3): ("c", 1), ("t", 4): ("d", 2), ("t", 5): ("b", 1),
        ("u", 1): ("z", 0), ("u", 2): ("y", 0), ("u", 3): ("x", 0),
    }
    with pytest.raises(ValueError):
        TR.trace_tree_order(spans(spark, TREE), max_depth=1)


def test_tree_order_of_repeated_spans_and_long_chains(spark):
    twice = [*TREE[:4], span("t", "d", "c", start=25), span("t", "a", "b", start=40)]
    got = [(r["span_id"], r["depth"]) for r in TR.trace_tree_order(spans(spark, twice)).orderBy("position").collect()]
    assert got == [("a", 0), ("c", 1), ("d", 2), ("b", 1)]
    chain = [span("t", f"s{i:04d}", f"s{i - 1:04d}" if i else None, start=i) for i in range(300)]
    got = [(r["span_id"], r["depth"]) for r in TR.trace_tree_order(spans(spark, chain)).orderBy("position").collect()]
    assert got == [(f"s{i:04d}", i) for i in range(300)]


def test_trace_range_and_histogram(spark):
    s = spans(spark, TREE)
    assert TR.trace_ranges(s).where("trace_id='u'").first()[1:] == (1, 9)
    h = TR.start_histogram(s, 20)
    assert h.count() == 40
    assert {r["trace_id"]: r["s"] for r in h.groupBy("trace_id").agg(F.sum("n").alias("s")).collect()} == {"t": 5, "u": 3}


def test_trace_list(spark):
    rows = [
        span("t1", "1", None, "root one", start=10, end=30, res={"service.name": "shop", "service.version": "1"}),
        span("t1", "2", "1", "db call", start=15, end=90, status=2, res={"service.name": "db", "service.version": "2"}),
        span("t2", "3", "gone", "orphan late", start=40, end=45, res={"service_name": "shop"}),
        span("t2", "4", "gone", "orphan early", start=35, end=36),
    ]
    s = spans(spark, rows)

    def ids(**kw):
        return sorted(r["trace_id"] for r in TR.trace_summaries(s, **kw).collect())

    t1 = TR.trace_summaries(s).where("trace_id='t1'").first()
    assert t1.asDict() == {"trace_id": "t1", "first_start": 10, "last_end": 90, "duration_ns": 80, "span_count": 2, "has_error": True}
    assert ids(has_error=True) == ["t1"] and ids(has_error=False) == ["t2"]
    assert ids(service_names=["shop"]) == ["t1", "t2"] and ids(service_name="db") == ["t1"]
    assert ids(service_name="shop", service_version="2") == [] and ids(service_name="db", service_version="2") == ["t1"]
    assert ids(name_contains="db CALL") == ["t1"] and ids(name_contains=" ") == []
    assert ids(from_ns=20) == ["t2"]
    page = TR.with_roots(TR.trace_page(TR.trace_summaries(s), "duration", "asc", 5), s)
    assert {r["trace_id"]: (r["root_name"], r["root_service"]) for r in page.collect()} == {"t1": ("root one", "shop"), "t2": ("orphan early", "")}
    assert TR.trace_page(TR.trace_summaries(s), limit=1).first()["trace_id"] == "t2"
    assert [r["trace_id"] for r in TR.latest_error_traces(s).collect()] == ["t1"]
    assert [r["span_id"] for r in TR.trace_spans(s, "t2").collect()] == ["4", "3"]
    assert TR.list_spans(s, 12, 40, kind=1, min_status=2).count() == 1


def test_dedup_keeps_first_arrival(spark):
    s = spans(spark, [span("t", "a", name="first"), span("t", "a", name="second"), span("t", "b")])
    s = s.withColumn("ingest_seq", F.when(F.col("name") == "second", 2).otherwise(1))
    assert sorted(r["name"] for r in TR.deduplicate_spans(s).collect()) == ["GET /x", "first"]


def test_discovery(spark):
    l = logs(spark, LOGS)
    s = spans(spark, [span("t", "a", res={"service.name": "db", "service.version": "7"})])
    assert {r["service"] for r in D.service_names(l, s).collect()} == {"shop", "billing", "db"}
    assert {r["service"] for r in D.service_names(l).collect()} == {"shop", "billing"}
    assert [r["version"] for r in D.service_versions("db", l, s).collect()] == ["7"]


def test_signal_volume(spark):
    m = 60 * SEC
    s = spans(spark, [span("t", "1", start=m), span("t", "2", start=m + 1), span("t", "3", start=2 * m)])
    l = logs(spark, [log(m + 5, 9, "x")])
    p = spark.createDataFrame([(m + 7,), (2 * m,)], "ts_unix_nano long")
    vol = V.signal_volume(s, l, p, 0, 10 * m, m)
    assert sorted(map(tuple, vol.collect())) == [(m, 2, 1, 1), (2 * m, 1, 0, 1)]
    assert V.signal_volume(s, l, p, 0, 10 * m, 0).count() == 0 and V.signal_volume(s, l, p, 5, 4, m).count() == 0
    dense = V.dense_volume(vol, 3 * m, m, 4).orderBy("slot").collect()
    assert [r["spans"] for r in dense] == [0, 2, 1, 0]
    lanes = {r["signal"]: (r["last"], r["peak"], r["per_second"]) for r in V.volume_lanes(V.dense_volume(vol, 2 * m, m, 60)).collect()}
    assert lanes["spans"] == (1, 2, 3 / 3600) and lanes["logs"] == (0, 1, 1 / 3600)


def test_endpoints(spark):
    rows = [
        span("t", str(i), start=0, end=i * 1_000_000, status=2 if i == 1 else 1,
             attrs={"aspnetmvc.controller": "Users", "aspnetmvc.action": "Get"})
        for i in range(1, 21)
    ]
    out = endpoint_rollup(spans(spark, rows))
    assert out.count() == 3
    for r in out.collect():
        assert (r["calls"], r["errors"], r["avg_ns"], r["min_ns"], r["max_ns"]) == (20, 1, 10.5e6, 1e6, 20e6)
        assert r["p50"] == pytest.approx(10.5e6) and r["p95"] == pytest.approx(19.95e6)
    k = endpoint_kpis(by_calls(out), 10 * SEC).first()
    assert (k["calls_per_s"], k["error_pct"], k["error_tone"], k["p95_tone"], k["max_tone"]) == (2, 5, "err", "ok", "ok")


@pytest.mark.parametrize(
    "route,want",
    [("/api/v1/parts/7", "parts"), ("api/V2", "api"), ("/Home//x", "Home"), ("/v3/q", "q"), ("", "(unbekannt)"), (None, "(unbekannt)"),
     ("/api//users", "users"), ("/", "(unbekannt)"), ("/apiary/v1", "apiary"), ("/api/vX/z", "vX")],
)
def test_controller_of_route(spark, route, want):
    df = spark.createDataFrame([(route,)], "r string")
    assert df.select(A.controller_of_route(F.col("r")).alias("c")).first()["c"] == want


def server(start_s, dur_s, status="200", method=None):
    attrs = {"http.route": "/a", "http.response.status_code": status}
    if method:
        attrs["http.method"] = method
    return span("t", str(start_s), kind=1, start=int(start_s * SEC), end=int((start_s + dur_s) * SEC), attrs=attrs, res={"service.name": "shop"})


def test_red_rate_and_quantile(spark):
    s = spans(spark, [server(100, 0.01), server(100, 0.01), server(102, 0.01), server(102, 0.01), span("t", "i", kind=0, start=100 * SEC)])
    lo, hi, at = 99_000, 105_000, Grid.instant(105_000)
    smp = series_samples(red.red_points(s, lo * 10**6, hi * 10**6, 10**9), "http_requests_total", lo, hi)
    # two requests per second bucket, cumulated to 2 and 4 over a five second range
    assert one(R.rate(range_select(smp, at, 5000))) == pytest.approx(0.4)
    s = spans(spark, [server(100, 0.02), server(100, 0.2), server(100, 2.0)])
    b = series_samples(red.red_points(s, lo * 10**6, hi * 10**6, 10**9), "http_request_duration_seconds_bucket", lo, hi)
    v = AG.sum_(instant_select(b, at), by=["le"])
    assert one(H.histogram_quantile(0.95, v)) == pytest.approx(2.275)
    assert {r["value"] for r in red.red_label_values(s, "http.method").collect()} == {"GET"}
    own = spark.createDataFrame([("x", 1)], "name string, type int")
    both = red.composite_points(own, s, lo * 10**6, hi * 10**6, 10**9)
    assert {r["name"] for r in both.select("name").distinct().collect()} == {"x", "http_requests", "http_request_duration"}


def test_metric_discovery(spark):
    p = spark.createDataFrame(
        [("orders", "1", 1, {"service.name": "s", "a.b": "1"}), ("lat", "ms", 2, {"a.b": "2"}), ("g", "%", 0, {})],
        "name string, unit string, type int, labels map<string,string>",
    )
    meta = {r["metric"]: r["kind"] for r in D.metric_metadata(p).collect()}
    assert meta == {
        "orders_total": "counter", "orders": "counter", "lat_seconds_bucket": "histogram", "lat_seconds_sum": "histogram",
        "lat_seconds_count": "histogram", "g_ratio": "gauge", "g": "gauge",
    }
    assert {r["label"] for r in D.label_names(p).collect()} == {"job", "service_name", "a_b"}
    assert {r["value"] for r in D.label_values(p, "a_b").collect()} == {"1", "2"}
    assert {r["value"] for r in D.label_values(p, "job").collect()} == {"s"}
    assert D.label_values(p, "__name__").count() == 7
    assert D.matching_points(p, [("a.b", "=~", "."), ("service.name", "!=", "s")]).count() == 1
