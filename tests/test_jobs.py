import json
import math
import random

import pytest
from helpers import fp, vector
from pyspark.sql import functions as F

from telmora import schema as S
from telmora.operators import alerts as AL
from telmora.plans import kpis as K
from telmora.plans import maintenance as M
from telmora.plans import panels as P
from telmora.sources import exposition as E
from telmora.sources import filters as FI
from telmora.sources import otlp as O
from telmora.sources import tables as TB
from telmora.streaming import jobs as J

SEC = 1_000_000_000
DAY = 86_400 * SEC
METRICS = (
    "series_id string, name string, unit string, type int, temporality int, ts_unix_nano long, value double, count long,"
    "sum double, min double, max double, bucket_counts array<bigint>, explicit_bounds array<double>"
)


def points(spark, type_, temp, values=(10.0, 20.0, 30.0), base=60 * SEC):
    return spark.createDataFrame(
        [("s", "m", None, type_, temp, base + i, v, None, None, None, None, None, None) for i, v in enumerate(values)], METRICS
    )


def hist(spark, temp):
    rows = [
        ("s", "m", None, 2, temp, 60 * SEC, 100.0, 6, 100.0, 1.0, 10.0, [1, 2, 3], [1.0, 2.0]),
        ("s", "m", None, 2, temp, 60 * SEC + 1, 200.0, 15, 200.0, 2.0, 20.0, [4, 5, 6], [1.0, 2.0]),
        ("s", "m", None, 2, temp, 60 * SEC + 2, 0.0, 0, 0.0, None, None, [7], [1.0, 2.0]),
    ]
    return spark.createDataFrame(rows[: 3 if temp == 1 else 2], METRICS)


def test_rollup_per_type(spark):
    for type_, temp, want in [(0, 0, 30), (1, 1, 60), (1, 2, 30)]:
        r = M.roll_up(points(spark, type_, temp), 1000 * SEC).collect()
        assert [(x["value"], x["bucket_start"]) for x in r] == [(want, 60 * SEC)]
    d = M.roll_up(hist(spark, 1), 1000 * SEC).first()
    assert (d["sum"], d["count"], d["min"], d["max"], d["bucket_counts"]) == (300, 21, 1, 20, [5, 7, 9])
    c = M.roll_up(hist(spark, 2), 1000 * SEC).first()
    assert (c["sum"], c["count"], c["min"], c["max"], c["bucket_counts"]) == (200, 15, 1, 20, [4, 5, 6])
    assert c["explicit_bounds"] == [1, 2]


def test_rollup_is_disjoint_and_merges_late_rows(spark):
    now = 10 * DAY
    boundary = M.rollup_boundary(now, 7)
    assert boundary == 3 * DAY
    m = points(spark, 1, 1, base=boundary - 1)
    assert M.roll_up(m, boundary).count() == 1 and M.raw_remainder(m, boundary).count() == 2
    r = M.roll_up(hist(spark, 1), 1000 * SEC)
    twice = r.withColumn("written_at", F.lit(1).cast("long")).unionByName(r.withColumn("written_at", F.lit(2).cast("long")))
    merged = M.merge_rollups(twice).first()
    assert (merged["count"], merged["sum"], merged["bucket_counts"]) == (42, 600, [10, 14, 18])


def test_retention(spark):
    df = spark.createDataFrame([(d * DAY,) for d in range(10)], "ts long")
    assert M.retain(df, "ts", 9 * DAY, 3).count() == 4
    assert M.retain(df, "ts", 9 * DAY, 0).count() == 10
    assert M.retain(df.withColumn("day", TB.day_of(F.col("ts"))), "ts", 9 * DAY, 3).count() == 4
    assert M.effective_days(None, 30) == 30 and M.effective_days(0, 30) == 0
    assert [tuple(r) for r in M.retention_counts(9 * DAY, a=(df, "ts", 3), b=(df, "ts", 0)).collect()] == [("a", 4, 6), ("b", 10, 0)]


def test_eviction(spark):
    rows = spark.range(5000).select(
        F.lit("logs").alias("signal"), F.col("id").cast("string").alias("row_key"),
        ((F.col("id") % 700) * 7_000_000_000_000).alias("ts"), (F.col("id") % 5 + 1).alias("est_bytes"),
    )
    every = sorted(((-r["ts"], r["signal"], r["row_key"], r["est_bytes"]) for r in rows.collect()))
    cap = 9000
    used, keep = 0, set()
    for ts, sig, key, b in every:
        used += b
        if used <= int(cap * 0.9):
            keep.add(key)
    assert {r["row_key"] for r in M.evict_to_budget(rows, cap).collect()} == keep
    assert M.evict_to_budget(rows, 10**9).count() == 5000
    assert [r["ts"] for r in M.oldest_rows(rows, 3).collect()] == [0, 0, 0]


def test_interning(spark):
    base = dict(name="m", unit=None, type=0, temporality=0, ts_unix_nano=1, value=1.0)
    rows = [{**base, "attrs": {"a": x}, "resource": {"r": "1"}, "scope_name": None, "scope_version": None} for x in "xxy"]
    p = spark.createDataFrame(rows, S.POINTS)
    facts, series = TB.intern_series(p)
    assert facts.count() == 3 and series.count() == 2
    assert TB.intern_series(p, series)[1].count() == 0
    joined = TB.resolve_series(facts, series)
    assert sorted(r["labels"]["a"] for r in joined.collect()) == ["x", "x", "y"]
    assert M.orphan_series(series, facts.limit(0)).count() == 2 and M.used_series(series, facts).count() == 2
    roll = M.roll_up(facts, 100 * SEC)
    got = TB.fetch_points(facts, series, ["m"], rollup=roll)
    assert got.count() == 5 and {r["labels"]["r"] for r in got.collect()} == {"1"}
    assert TB.metric_series(facts, " ").count() == 0 and TB.metric_series(facts, "m", limit=2).count() == 2


def test_attribute_index_and_json(spark):
    df = spark.createDataFrame([(1, {"a": "1", "e": "", "n": None}, {"a": "1", "b": "2"})], "id int, attrs map<string,string>, resource map<string,string>")
    assert sorted(map(tuple, TB.attribute_index(df, "id").collect())) == [(1, "a", "1"), (1, "b", "2"), (1, "e", "")]
    assert json.loads(df.select(TB.attributes_json(F.col("attrs")).alias("j")).first()["j"]) == {"a": "1"}
    nums = spark.createDataFrame([([1.5, math.inf, -math.inf, math.nan],)], "v array<double>").select(TB.numbers_json(F.col("v")).alias("j"))
    back = nums.select(TB.parse_numbers(F.regexp_replace("j", "\\+Inf", "Infinity")).alias("v"), "j").first()
    assert nums.first()["j"] == '[1.5,"+Inf","-Inf","NaN"]' and back["v"][0] == 1.5
    assert nums.select(TB.parse_numbers(F.col("j")).alias("v")).first()["v"][1] == math.inf
    t = spark.createDataFrame([('{"a":1,"b":null}', "{bad", "[1,2]")], "x string, y string, z string")
    r = t.select(TB.parse_attributes(F.col("x")).alias("x"), TB.parse_attributes(F.col("y")).alias("y"), TB.parse_numbers(F.col("z"), "bigint").alias("z")).first()
    assert (r["x"], r["y"], r["z"]) == ({"a": "1"}, {}, [1, 2])
    a = spark.createDataFrame([([1, 2], [3, 4]), ([1], [3, 4]), (None, [5]), ([5], None)], "a array<bigint>, b array<bigint>")
    assert [x["s"] for x in a.select(TB.add_arrays(F.col("a"), F.col("b")).alias("s")).collect()] == [[4, 6], [1], [5], [5]]


def test_exclusion(spark):
    df = spark.createDataFrame([({"http.route": "/otel/x"},), ({"url.path": "/a"},), ({},)], "attrs map<string,string>")
    assert FI.exclude_span_routes(df, ["/otel"]).count() == 2
    assert FI.exclude_metric_routes(df, ["/otel", ""]).count() == 2
    lg = spark.createDataFrame([("Micro.X",), ("micro.X",), (None,)], "scope_name string")
    assert FI.exclude_log_categories(lg, ["Micro"]).count() == 2


def test_exposition(spark):
    v = vector(spark, [(fp(__name__="o_total", job="a"), 46), (fp(__name__="h_bucket", le="1"), 2), (fp(__name__="h_count"), math.nan)], 3000)
    meta = spark.createDataFrame([("o_total", "counter"), ("h_bucket", "histogram"), ("h_sum", "histogram"), ("h_count", "histogram")], "metric string, kind string")
    got = [r["line"] for r in E.exposition_lines(v, meta).orderBy("family", "position", "line").collect()]
    assert got == ["# TYPE h histogram", 'h_bucket{le="1"} 2 3000', "h_count NaN 3000", "# TYPE o_total counter", 'o_total{job="a"} 46 3000']


def test_kpis(spark):
    req = spark.createDataFrame([(i * SEC, float(v)) for i, v in enumerate([0, 10, 30, 5, 25])], "ts_unix_nano long, value double")
    err = spark.createDataFrame([(i * SEC, float(v)) for i, v in enumerate([0, 1, 1, 1])], "ts_unix_nano long, value double")
    rates = K.neighbour_rate(req, [], 5 * SEC)
    assert [r["rate"] for r in rates.orderBy("ts_unix_nano").collect()] == [10, 20, 0, 20]
    ratio = K.error_ratio(rates, K.neighbour_rate(err, [], 5 * SEC)).orderBy("position").collect()
    assert [r["ratio"] for r in ratio] == [0.1, 0, 0]
    assert K.availability(req, err).first()["availability"] == pytest.approx(0.96)
    assert K.availability(req.limit(0), err).first()["availability"] == 1
    assert K.availability(req, err.limit(0)).first()["availability"] == 1
    assert tuple(req.limit(0).agg(*K.reducers()).first()) == (0, 0, 0, 0)
    assert tuple(req.agg(*K.reducers()).first()) == (30, 25, 70, 14)
    h = spark.createDataFrame([(2, SEC, [0, 10, 0], [1.0, 2.0]), (1, SEC, None, None)], "type int, ts_unix_nano long, bucket_counts array<bigint>, explicit_bounds array<double>")
    assert [r["p"] for r in K.latency_series(h, {"p": 0.5}).collect()] == [1.5]
    d = K.dashboard(req, err, h, 5 * SEC).first()
    assert (d["calls_per_s"], d["peak_calls_per_s"], d["p50"], d["error_tone"], d["availability_tone"], d["p95_tone"]) == (20, 20, 1.5, "ok", "warn", "err")


def test_kpis_per_key(spark):
    kind = "service string, ts_unix_nano long, value double"
    series = {"a": [0, 10, 30], "b": [0, 40, 40, 80], None: [0, 4]}
    req = spark.createDataFrame([(k, i * SEC, float(v)) for k, vs in series.items() for i, v in enumerate(vs)], kind)
    err = spark.createDataFrame([(k, i * SEC, float(v)) for k, vs in {"a": [0, 1], "b": [0, 8, 8], None: [0, 2], "c": [3]}.items() for i, v in enumerate(vs)], kind)
    h = spark.createDataFrame([("b", 2, SEC, [0, 10, 0], [1.0, 2.0]), ("d", 2, SEC, [0, 10, 0], [1.0, 2.0])], "service string, type int, ts_unix_nano long, bucket_counts array<bigint>, explicit_bounds array<double>")
    ratio = K.error_ratio(K.neighbour_rate(req, ["service"], 5 * SEC), K.neighbour_rate(err, ["service"], 5 * SEC), ["service"])
    assert {(r["service"], r["position"]): r["ratio"] for r in ratio.collect()} == {("a", 1): 0.1, ("b", 1): 0.2, ("b", 2): 0, (None, 1): 0.5}
    up = {r["service"]: r["availability"] for r in K.availability(req, err, ["service"]).collect()}
    assert up == pytest.approx({"a": 1 - 1 / 30, "b": 0.9, None: 0.5, "c": 1})
    rows = {r["service"]: r for r in K.dashboard(req, err, h, 5 * SEC, ["service"]).collect()}
    assert {k: (r["calls_per_s"], r["peak_calls_per_s"], r["error_ratio"], r["p50"]) for k, r in rows.items()} == {
        "a": (20, 20, 0.1, 0), "b": (40, 40, 0, 1.5), None: (4, 4, 0.5, 0), "c": (0, 0, 0, 0), "d": (0, 0, 0, 1.5)
    }


def test_panels(spark):
    v = vector(spark, [(fp(__name__="m", a="1"), 5), (fp(__name__="m", b="2"), math.inf), (fp(__name__="m", a="2"), 8)])
    steps = [(None, "green"), (6.0, "#E0B400"), (8.0, "dark-red")]
    assert [(r["value"], r["class"]) for r in P.stat_grid(v, steps).collect()] == [(8, "err"), (5, "ok")]
    assert sorted(r["key"] for r in P.label_keys(v).collect()) == ["a", "b"]
    t = P.table(v, ["a", "b"], rename={"a": "A", "Value": "v"}, exclude=["B"])
    assert t.columns == ["A", "v"] and sorted(r["A"] for r in t.collect()) == ["", "1", "2"]
    assert P.single_stat(P.finite(v)).first()["value"] == 13
    assert {r["max"] for r in P.bar_gauge(P.finite(v)).collect()} == {8}
    assert {r["max"] for r in P.bar_gauge(vector(spark, [("x", -1)])).collect()} == {1}
    assert sorted(r["share"] for r in P.pie(P.finite(v)).collect()) == [5 / 13, 8 / 13]
    assert P.timeseries({"x": v, "y": v}).count() == 6
    assert P.threshold_class(F.lit(1.0), []) is not None


def ticks(spark, flags, rule="r", every=60):
    return spark.createDataFrame([(rule, i * every * 1000, bool(f), float(f)) for i, f in enumerate(flags)], "rule_id string, t_ms long, firing boolean, value double")


def rules(spark, for_s=60, enabled=True, every_s=0):
    return spark.createDataFrame([("r", enabled, for_s, every_s)], "rule_id string, enabled boolean, for_s int, every_s int")


def states(df):
    return [(r["state"], r["notify"]) for r in df.orderBy("t_ms").collect()]


def test_alert_transitions(spark):
    h = AL.state_history(ticks(spark, [0, 1, 1, 1, 0, 0, 1, 0]), rules(spark))
    assert states(h) == [
        ("Ok", None), ("Pending", None), ("Firing", "Firing"), ("Firing", None), ("Resolved", "Resolved"), ("Ok", None),
        ("Pending", None), ("Ok", None),
    ]
    # even without a waiting time it takes one tick
    assert states(AL.state_history(ticks(spark, [1, 1]), rules(spark, 0))) == [("Pending", None), ("Firing", "Firing")]
    assert states(AL.state_history(ticks(spark, [1, 1, 1]), rules(spark, 120))) == [("Pending", None), ("Pending", None), ("Firing", "Firing")]
    assert AL.state_history(ticks(spark, [1, 1]), rules(spark, enabled=False)).count() == 0
    assert [r["t_ms"] for r in AL.state_history(ticks(spark, [0] * 5), rules(spark, every_s=120)).orderBy("t_ms").collect()] == [0, 120_000, 240_000]
    assert AL.transitions(h).count() == 2
    assert AL.latest_states(h).first()["state"] == "Ok"
    firing = AL.latest_states(AL.state_history(ticks(spark, [1, 1]), rules(spark, 0)))
    assert [tuple(r) for r in AL.state_overview(rules(spark), firing).collect()] == [("Firing", 1)]
    assert AL.rules_in_state(rules(spark), firing, "firing").count() == 1 and AL.rules_in_state(rules(spark), firing, "ok").count() == 0


def test_disabled_rule_resolves():
    s = AL.RuleState(AL.FIRING, 0, 5, 3.0, 0)
    new, notify = AL.advance(s, 10, True, 1.0, False, 0, 0)
    assert (new.state, notify, new.last_value) == (AL.RESOLVED, AL.RESOLVED, 3.0)
    new, notify = AL.advance(new, 20, True, 1.0, False, 0, 0)
    assert (new.state, notify) == (AL.OK, None)
    assert AL.advance(new, 30, True, 1.0, False, 0, 0) is None


def test_metric_condition(spark):
    r = AL.metric_condition(vector(spark, [("a", 0), ("b", math.nan), ("c", 2), ("d", -5)])).first()
    assert (r["firing"], r["value"], r["message"]) == (True, 2, "2/4")
    r = AL.metric_condition(vector(spark, [("a", 0)])).first()
    assert (r["firing"], r["value"]) == (False, 0)


TRACES = {
    "resourceSpans": [
        {
            "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}]},
            "scopeSpans": [
                {
                    "scope": {"name": "lib", "version": "1"},
                    "spans": [
                        {
                            "traceId": "AA01", "spanId": "bb", "name": "GET", "kind": 2, "startTimeUnixNano": "100", "endTimeUnixNano": "350",
                            "attributes": [
                                {"key": "i", "value": {"intValue": "7"}}, {"key": "d", "value": {"doubleValue": 1.50}},
                                {"key": "b", "value": {"boolValue": True}}, {"key": "y", "value": {"bytesValue": "/wA="}},
                                {"key": "l", "value": {"arrayValue": {"values": [{"intValue": "1"}]}}}, {"key": "e", "value": {"stringValue": ""}},
                            ],
                            "events": [{"timeUnixNano": "120", "name": "ev", "attributes": [{"key": "k", "value": {"stringValue": "v"}}]}],
                            "links": [{"traceId": "01", "spanId": "02"}, {"traceId": "01"}],
                            "status": {"code": 2, "message": "bad"},
                        },
                        {"spanId": "cc", "name": "no trace"},
                        {"traceId": "AA01", "spanId": "dd", "parentSpanId": "bb", "kind": "SPAN_KIND_CLIENT", "startTimeUnixNano": 9, "endTimeUnixNano": 5},
                    ],
                }
            ],
        }
    ]
}


def write_lines(path, *docs):
    path.mkdir(parents=True, exist_ok=True)
    (path / "requests.json").write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs))
    return str(path)


def test_otlp_traces(spark, tmp_path):
    req = O.read_requests(spark, "traces", write_lines(tmp_path / "t", TRACES, "{broken"))
    a, b = O.to_spans(req).orderBy("span_id").collect()
    assert (a["trace_id"], a["kind"], a["duration_ns"], a["status_code"], a["status_msg"]) == ("aa01", 1, 250, 2, "bad")
    assert a["attrs"] == {"i": "7", "d": "1.5", "b": "true", "y": "ff00", "l": '{"arrayValue":{"values":[{"intValue":"1"}]}}'}
    assert a["resource"] == {"service.name": "shop"} and (a["scope_name"], a["scope_version"]) == ("lib", "1")
    assert a["events"][0]["attrs"] == {"k": "v"} and [tuple(l)[:2] for l in a["links"]] == [("01", "02")]
    assert (b["parent_id"], b["kind"], b["duration_ns"], b["status_code"], b["links"]) == ("bb", 2, 0, 0, [])
    assert req.where("_corrupt_record is not null and resourceSpans is null").count() == 1


def test_otlp_logs(spark, tmp_path):
    recs = [
        {"timeUnixNano": "5", "severityNumber": n, "body": {"stringValue": str(n)}} for n in (0, 1, 4, 5, 8, 9, 12, 13, 16, 17, 20, 21, 24)
    ] + [{"observedTimeUnixNano": "7", "severityNumber": "SEVERITY_NUMBER_WARN2", "body": {"intValue": "3"}, "traceId": "AB"}, {"body": {"doubleValue": 2.0}}]
    req = O.read_requests(spark, "logs", write_lines(tmp_path / "l", {"resourceLogs": [{"scopeLogs": [{"logRecords": recs}]}]}))
    got = {r["body"]: r for r in O.to_logs(req, now_ns=99).collect()}
    assert [got[str(n)]["severity"] for n in (0, 1, 4, 5, 8, 9, 12, 13, 16, 17, 20, 21, 24)] == [9, 1, 1, 5, 5, 9, 9, 13, 13, 17, 17, 21, 21]
    late = [r for r in O.to_logs(req, now_ns=99).collect() if r["ts_unix_nano"] == 7][0]
    assert (late["severity"], late["body"], late["trace_id"]) == (13, "3", "ab")
    assert got["2"]["ts_unix_nano"] == 99


METRIC_REQUEST = {
    "resourceMetrics": [{"scopeMetrics": [{"metrics": [
        {"name": "g", "unit": "%", "gauge": {"dataPoints": [{"timeUnixNano": "1", "asDouble": 1.5}]}},
        {"name": "c", "sum": {"aggregationTemporality": 2, "dataPoints": [{"timeUnixNano": "2", "asInt": "7", "attributes": [{"key": "k", "value": {"stringValue": "v"}}]}]}},
        {"name": "h", "unit": "s", "histogram": {"aggregationTemporality": "AGGREGATION_TEMPORALITY_DELTA", "dataPoints": [
            {"timeUnixNano": "3", "count": "3", "sum": 4.5, "min": 1, "bucketCounts": ["1", "2"], "explicitBounds": [0.5]}]}},
        {"name": "x", "exponentialHistogram": {"dataPoints": []}}, {"name": "y", "summary": {}},
    ]}]}]
}


def test_otlp_metrics(spark, tmp_path):
    req = O.read_requests(spark, "metrics", write_lines(tmp_path / "m", METRIC_REQUEST))
    g = {r["name"]: r for r in O.to_points(req).collect()}
    assert set(g) == {"g", "c", "h"}
    assert (g["g"]["value"], g["g"]["type"], g["g"]["unit"]) == (1.5, 0, "%")
    assert (g["c"]["value"], g["c"]["temporality"], g["c"]["attrs"], g["c"]["unit"]) == (7, 2, {"k": "v"}, None)
    h = g["h"]
    assert (h["value"], h["count"], h["min"], h["max"], h["bucket_counts"], h["explicit_bounds"], h["temporality"]) == (4.5, 3, 1, None, [1, 2], [0.5], 1)
    assert O.rejected_metrics(req).first()["rejected"] == 2


def test_tables_round_trip(spark, tmp_path):
    req = O.read_requests(spark, "traces", write_lines(tmp_path / "t", TRACES))
    s = O.to_spans(req).withColumn("start_unix_nano", F.col("start_unix_nano") + F.lit(DAY)).withColumn("ingest_seq", F.monotonically_increasing_id())
    path = str(tmp_path / "spans")
    TB.append_spans(s.unionByName(s), path)
    stored = TB.scan(spark, path, "start_unix_nano")
    assert stored.count() == 2
    TB.append_spans(s, path, stored)
    assert TB.scan(spark, path, "start_unix_nano", DAY, DAY + 50).count() == 1
    assert TB.scan(spark, path, "start_unix_nano", to_ns=DAY - 1).count() == 0
    plan = TB.scan(spark, path, "start_unix_nano", DAY)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_streaming_ingest_matches_batch(spark, tmp_path):
    src = write_lines(tmp_path / "in", METRIC_REQUEST)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    J.ingest(O.to_points(O.stream_requests(spark, "metrics", src)), out, ck, "ts_unix_nano").awaitTermination()
    cols = ["name", "value", "type", "temporality", "ts_unix_nano"]
    want = O.to_points(O.read_requests(spark, "metrics", src)).select(*cols)
    got = spark.read.parquet(out).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def run_memory(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streaming_dedup_volume_rollup(spark, tmp_path):
    base = 60 * SEC * 28_000_000
    later = json.loads(json.dumps(TRACES).replace('"100"', f'"{base + 100}"').replace("Nano\": 9", f'Nano": {base + 9}'))
    req = write_lines(tmp_path / "in", later, later)
    sp = O.to_spans(O.stream_requests(spark, "traces", req))
    assert run_memory(J.first_spans(sp), "dedup").count() == 2
    lg = O.to_logs(O.stream_requests(spark, "logs", write_lines(tmp_path / "l", {"resourceLogs": []})), 1)
    mt = O.to_points(O.stream_requests(spark, "metrics", write_lines(tmp_path / "m", METRIC_REQUEST)))
    vol = run_memory(J.volume(sp, lg, mt), "vol", "complete")
    assert sorted(map(tuple, vol.collect())) == [(0, 0, 0, 3), (base, 4, 0, 0)]
    roll = run_memory(J.rollup(mt.withColumn("series_id", F.lit("s"))), "roll", "complete")
    assert {r["name"]: r["value"] for r in roll.collect()} == {"g": 1.5, "c": 7, "h": 4.5}
    smp = mt.select(F.col("name").alias("labels_fp"), F.lit(1500).cast("long").alias("ts_ms"), "value")
    slide = run_memory(J.sliding_over_time(smp, "2 seconds", "1 second", F.sum), "slide", "complete")
    assert sorted((r["labels_fp"], r["t_ms"]) for r in slide.collect()) == [(n, t) for n in "cgh" for t in (2000, 3000)]


def test_streaming_rollup_with_distributions_matches_batch(spark, tmp_path):
    cols = [c.split()[0] for c in METRICS.replace(", ", ",").split(",")]
    sets = [
        hist(spark, 1), hist(spark, 2).withColumn("name", F.lit("c")),
        points(spark, 0, 0).withColumn("name", F.lit("g")), points(spark, 1, 1).withColumn("name", F.lit("d")),
        points(spark, 1, 2).withColumn("name", F.lit("t")),
        hist(spark, 1).withColumns({"name": F.lit("e"), "bucket_counts": F.array().cast("array<bigint>")}),
        hist(spark, 1).withColumns({"name": F.lit("n"), "bucket_counts": F.lit(None).cast("array<bigint>")}),
        hist(spark, 1).withColumn("ts_unix_nano", F.col("ts_unix_nano") + 60 * SEC),
    ]
    rows = sets[0]
    for df in sets[1:]:
        rows = rows.unionByName(df)
    closing = points(spark, 0, 0, values=(1.0,), base=10_000 * SEC)
    src = str(tmp_path / "points")
    rows.select(*cols).coalesce(1).write.parquet(src)
    closing.select(*cols).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = run_memory(J.rollup_full(stream, "10 seconds"), "roll_full")
    want = M.roll_up(rows, 1000 * SEC)
    assert want.count() == 8
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.where("name = 'm' and bucket_counts = array(5, 7, 9)").count() == 2


def test_streaming_alerts_match_batch(spark, tmp_path):
    from telmora.streaming.alerts import state_stream

    flags = [0, 1, 1, 0, 0, 1]
    t = ticks(spark, flags).join(rules(spark), "rule_id")
    src = str(tmp_path / "ticks")
    t.coalesce(1).write.parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(t.schema).parquet(src)
    got = states(run_memory(state_stream(stream), "alerts"))
    assert got == states(AL.state_history(ticks(spark, flags), rules(spark)))


def test_state_history_equals_the_machine_tick_by_tick(spark, monkeypatch):
    """Random rules over many chunks, with pauses, gaps, repeated times and a disabled rule."""
    monkeypatch.setattr(AL, "CHUNK_MS", 7_000)
    rnd = random.Random(11)
    settings, data = [], []
    for i in range(24):
        rule = f"r{i}"
        settings.append((rule, i != 5, rnd.choice([0, 1, 3, 10]), rnd.choice([0, 0, 2, 5, 30])))
        t, flag = rnd.randrange(5_000), False
        for _ in range(60):
            flag = flag if rnd.random() < (0.8 if i % 2 else 0.5) else not flag
            data.append((rule, t, flag, float(rnd.randrange(100))))
            t += rnd.choice([200, 1000, 1000, 3000, 40_000 if rnd.random() < 0.1 else 500])
    want = []
    for rule, enabled, for_s, every_s in settings:
        s = AL.RuleState()
        for _, t, f, v in [d for d in data if d[0] == rule]:
            step = AL.advance(s, t, f, v, enabled, for_s, every_s)
            if step is not None:
                s, notify = step
                want.append((rule, t, s.state, s.since_ms, s.notified_ms, s.last_value, v, notify))
    extra = [(None, 1, True, 1.0), ("r0", None, True, 1.0), ("unknown", 3, True, 1.0), data[0], data[-1]]
    df = spark.createDataFrame(data + extra, "rule_id string, t_ms long, firing boolean, value double").repartition(7)
    rule_table = spark.createDataFrame(settings, "rule_id string, enabled boolean, for_s int, every_s int")
    got = AL.state_history(df, rule_table)
    assert got.columns == [c.split()[0] for c in AL.HISTORY.split(", ")]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    assert AL.state_history(df.limit(0), rule_table).count() == 0
