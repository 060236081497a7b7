import math
import statistics

import pytest
from helpers import at, fp, one, values, vector
from pyspark.sql import functions as F

from telmora.functions import ieee
from telmora.functions import labels as L
from telmora.functions import naming as N
from telmora.operators import aggregates as A
from telmora.operators import binary as B
from telmora.operators import histogram as H
from telmora.operators import ordered as O
from telmora.operators import scalar as S
from telmora.operators.samples import cumulate_delta, expand_points, series_samples
from telmora.operators.selectors import Grid

NAN, INF = math.nan, math.inf


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == b


def evaluate(spark, fn, *args):
    df = spark.createDataFrame([tuple(float(a) for a in args)], [f"c{i}" for i in range(len(args))])
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(args))]).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "op,l,r,want",
    [("/", 1, 0, INF), ("/", -1, 0, -INF), ("/", 0, 0, NAN), ("/", 1, -0.0, -INF), ("%", 5, 0, NAN), ("%", -7, 3, -1),
     ("^", 2, 3, 8), ("+", 1, NAN, NAN), ("-", 5, 7, -2), ("*", 3, 4, 12)],
)
def test_arithmetic(spark, op, l, r, want):
    assert same(evaluate(spark, ieee.ARITHMETIC[op], l, r), want)


def test_comparison_with_nan(spark):
    for op in ieee.COMPARISONS:
        assert evaluate(spark, lambda a, b, o=op: ieee.compare(o, a, b), NAN, NAN) == (op == "!=")
        assert evaluate(spark, lambda a, b, o=op: ieee.compare(o, a, b), NAN, 1) == (op == "!=")


@pytest.mark.parametrize(
    "name,v,want",
    [("ceil", NAN, NAN), ("floor", INF, INF), ("ceil", 1.2, 2), ("floor", -1.2, -2), ("floor", 1e300, 1e300),
     ("ln", 0, -INF), ("ln", -1, NAN), ("log2", 8, 3), ("log10", 1000, 3), ("sgn", NAN, 0), ("sgn", -3, -1),
     ("sqrt", -1, NAN), ("asin", 2, NAN), ("deg", math.pi, 180), ("rad", 180, math.pi), ("abs", -2, 2)],
)
def test_functions(spark, name, v, want):
    assert same(evaluate(spark, lambda c: S.apply(name, c), v), want)


def test_round_and_clamp(spark):
    v = vector(spark, [("a", 2.5), ("b", -2.5), ("c", NAN)])
    got = values(S.round_(v))
    assert (got[("a", 0)], got[("b", 0)]) == (3, -3) and math.isnan(got[("c", 0)])
    assert values(S.round_(v, 0))[("a", 0)] == 2.5
    assert values(S.round_(vector(spark, [("a", 7.3)]), 0.5)) == {("a", 0): 7.5}
    assert math.isnan(values(S.clamp_min(v, 0))[("c", 0)])
    assert values(S.clamp_max(v, 1))[("a", 0)] == 1


def test_labels_round_trip(spark):
    m = {"a": 'x"y,k="z', "b": "back\\slash", "c.d": "", "e=f": "1", "g,h": "2", "__name__": "n"}
    df = spark.createDataFrame([(m,)], "m map<string,string>").select("m", L.fingerprint(F.col("m")).alias("labels_fp"))
    r = df.select(
        L.labels_of("labels_fp").alias("m"),
        L.label("labels_fp", "a").alias("a"),
        L.label("labels_fp", "k").alias("k"),
        L.label("labels_fp", "g,h").alias("gh"),
        L.labels_of(L.without("labels_fp", ["a", "__name__"])).alias("w"),
        L.labels_of(L.only("labels_fp", ["b", "e=f", "zz"])).alias("o"),
        L.without("labels_fp", m).alias("nothing"),
        L.labels_of(L.with_label("labels_fp", "b", F.lit("new"))).alias("set"),
    ).first()
    assert r["m"] == m and r["a"] == m["a"] and r["k"] is None and r["gh"] == "2"
    assert r["w"] == {k: v for k, v in m.items() if k not in ("a", "__name__")}
    assert r["o"] == {"b": m["b"], "e=f": "1"}
    assert r["nothing"] == ""
    assert r["set"] == {**m, "b": "new"}


def test_matchers(spark):
    v = vector(spark, [(fp(a="abc"), 1), (fp(b="x"), 2)])

    def kept(op, value):
        return sorted(r["value"] for r in v.where(L.matches(F.col("labels_fp"), "a", op, value)).collect())

    assert kept("=", "") == [2] and kept("=", "abc") == [1] and kept("!=", "abc") == [2]
    assert kept("=~", "b") == [1] and kept("!~", "b") == [2] and kept("!~", "zz") == [1, 2]


def test_expose_and_merge(spark):
    df = spark.createDataFrame(
        [({"service.name": "shop", "x": "1"}, {"x": "2", "http.route": "/a"})], "r map<string,string>, a map<string,string>"
    )
    got = df.select(L.expose(L.merge(F.col("r"), F.col("a"))).alias("m")).first()["m"]
    assert got == {"job": "shop", "service_name": "shop", "x": "2", "http_route": "/a"}


V = [(fp(job="a", r="x"), 1), (fp(job="a", r="y"), 3), (fp(job="b", r="x"), 10), (fp(job="b"), NAN)]


def test_aggregates(spark):
    v = vector(spark, V)
    a, b = (fp(job="a"), 0), (fp(job="b"), 0)
    assert values(A.sum_(v, by=["job"]))[a] == 4
    assert math.isnan(values(A.sum_(v, by=["job"]))[b])
    assert values(A.max_(v, by=["job"])) == {a: 3, b: 10}
    assert values(A.min_(v)) == {("", 0): 1}
    assert values(A.count(v, without=["r"])) == {a: 2, b: 2}
    assert values(A.group(v)) == {("", 0): 1}
    assert values(A.avg(v, by=["job"]))[a] == 2
    assert values(A.stddev(v, by=["job"]))[a] == 1 and values(A.stdvar(v, by=["job"]))[a] == 1
    assert values(A.quantile(0.5, v, by=["job"]))[a] == 2
    assert values(A.quantile(2, v, by=["job"]))[a] == 3
    assert values(A.count_values("r", v)) == {(fp(r="x"), 0): 2, (fp(r="y"), 0): 1}
    assert set(values(A.topk(1, v, by=["job"]))) == {(fp(job="a", r="y"), 0), (fp(job="b", r="x"), 0)}
    assert set(values(A.bottomk(1, v, by=["job"]))) == {(fp(job="a", r="x"), 0), (fp(job="b"), 0)}
    assert A.topk(0, v).count() == 0
    only_nan = vector(spark, [("x", NAN)])
    assert one(A.max_(only_nan)) == -INF and one(A.min_(only_nan)) == INF


def test_quantiles_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    data = [("k", rnd.choice([0.0, -0.0, 1e-300, -5.5, rnd.gauss(0, 1e6), 7.0])) for _ in range(2000)]
    data += [("nan", NAN), ("nan", 2.0), ("inf", INF), ("inf", -INF), ("one", 4.0), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(data, "k string, v double")
    for rule in ("r7", "r6"):
        qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
        got = {r["k"]: r for r in O.exact_quantiles(df, ["k"], "v", qs, rule).collect()}
        vals = sorted(v for k, v in data if k == "k")
        cuts = statistics.quantiles(vals, n=1000, method="exclusive" if rule == "r6" else "inclusive")
        for name, q in qs.items():
            want = vals[0] if q == 0 else vals[-1] if q == 1 else cuts[round(1000 * q) - 1]
            assert got["k"][name] == pytest.approx(want, rel=1e-12), (rule, name)
        assert got["one"]["b"] == 4 and got["one"]["n"] == 1
        assert math.isnan(got["nan"]["a"]) and got["nan"]["e"] == 2
        assert got["inf"]["a"] == -INF and got["inf"]["e"] == INF
        assert got[None]["e"] == 2


def test_vector_matching(spark):
    l = vector(spark, [(fp(__name__="l", j="a", r="1"), 6), (fp(__name__="l", j="a", r="2"), 8), (fp(__name__="l", j="b", r="1"), 1)])
    r = vector(spark, [(fp(__name__="r", j="a"), 2), (fp(__name__="r", j="a", z="9"), 4)])
    assert values(B.arithmetic(l, "/", r)) == {}
    assert sorted(x["value"] for x in B.arithmetic(l, "/", r, on=["j"]).collect()) == [1.5, 2]
    got = values(B.arithmetic(l, "/", r, ignoring=["r", "z"], group_left=[]))
    assert got == {(fp(j="a", r="1"), 0): 1.5, (fp(j="a", r="2"), 0): 2}
    got = values(B.arithmetic(l, "/", r, on=["j"], group_left=["r"]))
    assert got == {(fp(j="a", r="1"), 0): 1.5, (fp(j="a", r="2"), 0): 2}
    right = B.arithmetic(r, "*", l, on=["j"], group_right=["z"]).collect()
    assert sorted((x["labels_fp"], x["value"]) for x in right) == [(fp(j="a", z="9"), 24), (fp(j="a", z="9"), 32)]
    assert sorted(x["value"] for x in B.comparison(l, ">", r, on=["j"]).collect()) == [6, 8]
    assert sorted(x["value"] for x in B.comparison(l, "<", r, bool_=True, on=["j"]).collect()) == [0, 0]
    assert len(B.and_(l, r, on=["j"]).collect()) == 2
    assert values(B.unless(l, r, on=["j"])) == {(fp(__name__="l", j="b", r="1"), 0): 1}
    assert len(B.or_(r, l, on=["j"]).collect()) == 3


def test_scalars(spark):
    v = vector(spark, [(fp(__name__="n"), 4)], t=5000)
    k = (fp(__name__="n"), 5000)
    assert values(B.arithmetic(10, "-", v)) == {k: 6}
    assert values(B.arithmetic(v, "%", 3)) == {k: 1}
    assert values(B.arithmetic(v, "+", S.time_())) == {k: 9}
    assert values(B.comparison(v, ">", 3)) == {k: 4}
    assert values(B.comparison(v, ">", 5)) == {}
    assert values(B.comparison(v, ">", 5, bool_=True)) == {k: 0}
    assert values(B.negate(v)) == {k: -4}
    assert one(S.scalar(v)) == 4
    assert values(S.vector(Grid.instant(7), spark, 2)) == {("", 7): 2}
    assert values(S.absent(v, Grid(0, 5000, 5000))) == {("", 0): 1}
    assert values(S.timestamp(v)) == {k: 5}


def test_label_functions(spark):
    v = vector(spark, [(fp(src="val-7"), 1), (fp(other="q"), 2)])
    got = values(S.label_replace(v, "dst", "$1", "src", "(.*)"))
    assert got == {(fp(dst="val-7", src="val-7"), 0): 1, (fp(dst="", other="q"), 0): 2}
    got = values(S.label_replace(v, "dst", "n$1x$3", "src", r"-(\d)"))
    assert got == {(fp(dst="n7x", src="val-7"), 0): 1, (fp(other="q"), 0): 2}
    got = values(S.label_join(v, "j", "-", "other", "src", "none"))
    assert got == {(fp(j="val-7", src="val-7"), 0): 1, (fp(j="q", other="q"), 0): 2}


def test_sort_puts_nan_first_or_last(spark):
    v = vector(spark, [("a", 2), ("b", NAN), ("c", 1)])
    assert [r["labels_fp"] for r in S.sort(v).collect()] == ["b", "c", "a"]
    assert [r["labels_fp"] for r in S.sort_desc(v).collect()] == ["a", "c", "b"]


BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def cumulative(spark, counts, bounds=BOUNDS):
    rows, run = [], 0
    for c, b in zip(counts, [*bounds, None]):
        run += c
        le = "+Inf" if b is None else str(int(b)) if b == int(b) else str(b)
        rows.append((fp(__name__="h_bucket", job="x", le=le), run))
    return vector(spark, rows)


def test_histogram_quantile(spark):
    h = cumulative(spark, [18] * 5 + [10] + [0] * 6)
    p95 = one(H.histogram_quantile(0.95, h))
    assert 0.1 < p95 <= 0.25
    assert one(H.histogram_quantile(0.1, h)) == 0
    assert one(H.histogram_quantile(0.1, h, interpolate_first=True)) == pytest.approx(0.005 * 10 / 18)
    assert one(H.histogram_quantile(-1, h)) == -INF and one(H.histogram_quantile(1.5, h)) == INF
    assert math.isnan(one(H.histogram_quantile(NAN, h)))
    assert math.isnan(one(H.histogram_quantile(0.5, cumulative(spark, [0] * 12))))
    assert one(H.histogram_quantile(0.9, cumulative(spark, [1] + [0] * 10 + [9]))) == 10
    assert one(H.histogram_count(h)) == 100
    assert math.isnan(one(H.histogram_sum(h)))
    sums = vector(spark, [(fp(__name__="h_sum", job="x"), 50)])
    assert one(H.histogram_avg(h, sums)) == 0.5


def test_bucket_quantile(spark):
    def q(counts, bounds, q):
        df = spark.createDataFrame([(counts, bounds)], "c array<bigint>, b array<double>")
        return df.select(H.bucket_quantile(F.col("c"), F.col("b"), q).alias("r")).first()["r"]

    assert q([10, 0, 0], [1.0, 2.0], 0.5) == 0.5
    assert q([0, 10, 0], [1.0, 2.0], 0.5) == 1.5
    assert q([0, 0, 5], [1.0, 2.0], 0.9) == 2
    assert q([0, 0, 0], [1.0, 2.0], 0.9) == 0
    assert q([], [], 0.9) == 0 and q(None, None, 0.5) == 0


def test_endpoint_percentiles(spark):
    df = spark.createDataFrame([(float(i) * 1e6,) for i in range(1, 21)], "d double")
    r = H.raw_quantiles(df.withColumn("k", F.lit(1)), ["k"], "d", {"p50": 0.5, "p95": 0.95}).first()
    assert r["p50"] == pytest.approx(10.5e6) and r["p95"] == pytest.approx(19.95e6)


def test_heatmap(spark):
    v = vector(spark, [(fp(le="1"), 2), (fp(le="2"), 1), (fp(le="+Inf"), 5)])
    assert [r["value"] for r in H.heatmap(v, at(0)).orderBy("le").collect()] == [2, 0, 4]
    assert [r["value"] for r in H.heatmap(vector(spark, [(fp(le="1"), 0)]), at(0)).collect()] == [0]


def test_le_text(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.5, 0.005, 1e-5, 1.5e-7, 0.00025, 12345678.5, 1e22, INF)], "b double")
    assert [r["t"] for r in df.select(H.le_text(F.col("b")).alias("t")).collect()] == [
        "1", "2.5", "0.005", "1E-05", "1.5E-07", "0.00025", "12345678.5", "10000000000000000000000", "+Inf",
    ]


POINTS = (
    "name string, unit string, type int, temporality int, ts_unix_nano long, value double, count long, sum double,"
    "bucket_counts array<bigint>, explicit_bounds array<double>, labels map<string,string>"
)


def test_expand_points(spark):
    lab = {"service.name": "shop", "Zone": "z", "le2": "q"}
    rows = [
        ("orders", "1", 1, 2, 5_000_000, 3.0, None, None, None, None, lab),
        ("lat", "ms", 2, 1, 5_000_000, 30.0, 3, 30.0, [1, 2], [10.0], lab),
        ("dotnet.gc.collections", None, 1, 2, 0, 1.0, None, None, None, None, {}),
        ("temp", "%", 0, 0, 0, 1.0, None, None, None, None, {}),
    ]
    p = spark.createDataFrame(rows, POINTS)
    got = {r["labels_fp"]: (r["value"], r["is_delta"]) for r in expand_points(p).collect()}
    base = {"job": "shop", "service_name": "shop", "Zone": "z", "le2": "q"}
    assert got == {
        fp(**base, __name__="orders_total"): (3, False),
        fp(**base, __name__="orders"): (3, False),
        fp(**base, __name__="lat_seconds_bucket", le="0.01"): (1, True),
        fp(**base, __name__="lat_seconds_bucket", le="+Inf"): (3, True),
        fp(**base, __name__="lat_seconds_sum"): (0.03, True),
        fp(**base, __name__="lat_seconds_count"): (3, True),
        fp(__name__="dotnet_gc_collections_total"): (1, False),
        fp(__name__="dotnet_gc_collections"): (1, False),
        fp(__name__="process_runtime_dotnet_gc_collections_count_total"): (1, False),
        fp(__name__="temp_ratio"): (1, False),
        fp(__name__="temp"): (1, False),
    }
    only = expand_points(p, "lat_seconds_count").collect()
    assert [r["value"] for r in only] == [3]
    names = p.select("name").distinct()
    assert [r["name"] for r in N.resolve_stored_name(names, "lat_seconds_bucket").collect()] == ["lat"]
    assert [r["name"] for r in N.resolve_stored_name(names, "process_runtime_dotnet_gc_collections_count_total").collect()] == ["dotnet.gc.collections"]


def test_delta_cumulation(spark):
    rows = [("a", t, 1.0, True) for t in range(0, 100, 10)] + [("b", 5, 7.0, False), ("b", 6, 7.0, False)]
    s = spark.createDataFrame(rows, "labels_fp string, ts_ms long, value double, is_delta boolean")
    got = {(r["labels_fp"], r["ts_ms"]): r["value"] for r in cumulate_delta(s, 20, 95).collect()}
    assert got == {("a", t): (t - 10) / 10 for t in range(20, 100, 10)}
    assert cumulate_delta(s).where("labels_fp='b'").count() == 2
    p = spark.createDataFrame([("c", None, 1, 1, t * 1_000_000, 2.0, None, None, None, None, {}) for t in range(5)], POINTS)
    assert sorted(r["value"] for r in series_samples(p, "c_total", 1, 3).collect()) == [2, 4, 6]


def test_running_total_and_rank_match_plain_windows(spark):
    from pyspark.sql import Window as W

    df = spark.range(2000).select(
        (F.col("id") % 3).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(50_000)) * 4000 + F.col("id")).alias("ts"), F.col("id").alias("v"), "id"
    )
    w = W.partitionBy("k").orderBy("ts", "id")
    want = {r["id"]: (r["s"], r["n"]) for r in df.select(
        "id", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"), F.row_number().over(w).alias("n")).collect()}
    got = {r["v"]: r["s"] for r in O.running_total(df, ["k"], "ts", "v", "s", 777_000).collect()}
    assert got == {k: s for k, (s, _) in want.items()}
    n = {r["id"]: r["n"] for r in O.ranked(df, ["k"], ["ts", "id"], "n").collect()}
    assert n == {k: c for k, (_, c) in want.items()}
    s = {r["id"]: r["n"] for r in O.ranked(df, ["k"], ["ts", "id"], "n", "v").collect()}
    assert s == {k: c for k, (c, _) in want.items()}


@pytest.mark.parametrize("base,step", [(1.7e12, 1.0), (1.7e12, 2.0**-11), (-5.0, 2.0**-50), (0.0, 1.0)])
def test_quantiles_of_values_close_together(spark, base, step):
    """Values of one bucket are told apart by parts of it, not by sorting the bucket."""
    from telmora.operators.ordered import exact_quantiles

    n = 20_000
    df = spark.range(n).select(F.lit("k").alias("k"), (F.lit(base) + ((F.col("id") * 7919) % n) * step).alias("v"))
    got = exact_quantiles(df, ["k"], "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}, "r7").first()
    values = sorted(r["v"] for r in df.collect())
    for name, q in (("a", 0.0), ("b", 0.37), ("c", 0.5), ("d", 1.0)):
        pos = q * (n - 1)
        low, high, frac = values[math.floor(pos)], values[math.ceil(pos)], pos - math.floor(pos)
        assert got[name] == (low if frac == 0 else low * (1 - frac) + high * frac)
    assert got["n"] == n


def test_no_window_holds_a_whole_value_bucket(spark):
    from telmora.operators.ordered import exact_quantiles

    df = spark.range(1000).select(F.lit("k").alias("k"), (F.lit(1.7e12) + F.col("id")).alias("v"))
    plan = exact_quantiles(df, ["k"], "v", {"a": 0.5}, "r7")._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("__v" not in x or "__s#" in x.split("windowspecdefinition")[1] for x in windows)
