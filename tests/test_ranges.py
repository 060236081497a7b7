import math
import random

import numpy as np
import pytest
from helpers import at, fp, one, samples, values
from pyspark.sql import functions as F

from telmora.operators import ranges as R
from telmora.operators.selectors import Grid, forward_fill, instant_select, range_select, with_at, with_offset

ORDERS = fp(__name__="orders_total", job="shop", region="eu", service_name="shop")
COUNTER = [(ORDERS, 0, 10), (ORDERS, 1000, 21), (ORDERS, 2000, 33), (ORDERS, 3000, 46)]


def test_counter_figures(spark):
    s = samples(spark, COUNTER)
    three = range_select(s, at(3000), 3000)
    assert one(instant_select(s, at(3000))) == 46
    assert one(R.rate(three)) == 12
    assert one(R.increase(three)) == 36
    assert one(R.irate(range_select(s, at(3000), 60_000))) == 13
    assert one(R.avg_over_time(three)) == 27.5
    assert R.rate(three).first()["labels_fp"] == fp(job="shop", region="eu", service_name="shop")


def test_reset_adds_value_before_it(spark):
    s = samples(spark, [("", 0, 100), ("", 1000, 30)])
    rv = range_select(s, at(1000), 60_000)
    assert one(R.increase(rv)) == 30
    assert one(R.delta(rv)) == 30
    assert one(R.rate(rv)) == 0.5
    assert one(R.resets(rv)) == 1
    assert one(R.irate(rv)) == 30
    assert one(R.idelta(rv)) == -70


def test_single_point(spark):
    rv = range_select(samples(spark, [("", 0, 5)]), at(1000), 60_000)
    assert math.isnan(one(R.irate(rv)))
    assert one(R.idelta(rv)) == 5
    assert one(R.increase(rv)) == 0
    assert one(R.deriv(rv)) == 0
    assert R.predict_linear(rv, 10).count() == 0
    assert one(R.present_over_time(rv)) == 1


def test_offset_at_absent(spark):
    s = samples(spark, COUNTER)
    grid = Grid(0, 4000, 1000)
    rv = range_select(s, grid, 0)
    assert one(R.last_over_time(range_select(s, at(4000), 0, offset_ms=2000))) == 33
    assert {k[1]: v for k, v in values(R.sum_over_time(with_at(rv, 1000))).items()} == dict.fromkeys(range(0, 5000, 1000), 21)
    assert [k[1] for k in values(R.absent_over_time(rv))] == [4000]
    assert [k[1] for k in values(R.absent_over_time(with_offset(rv, 2000)))] == [0, 1000]
    assert one(instant_select(s, at(9000), at_ms=1500)) == 21
    assert instant_select(s, at(400_000)).count() == 0
    kept = instant_select(s, at(3500)).first()
    assert (kept["t_ms"], kept["sample_ts_ms"]) == (3500, 3000)


def test_forward_fill(spark):
    s = samples(spark, [("a", 0, 1), ("b", 2000, 5)])
    v = instant_select(s, Grid(0, 2000, 1000), lookback_ms=0)
    assert values(forward_fill(v, Grid(0, 2000, 1000))) == {("a", 0): 1, ("a", 2000): 1, ("b", 0): 0, ("b", 2000): 5}


def brute(points, grid, range_ms, fn, offset=0):
    out = {}
    for series in sorted({p[0] for p in points}):
        mine = sorted((t, v) for s, t, v in points if s == series)
        for t in range(grid.start_ms, grid.end_ms + 1, grid.step_ms):
            win = [p for p in mine if t - offset - range_ms <= p[0] <= t - offset]
            if win:
                out[(series, t)] = fn(win, t)
    return out


def _inc(w, _):
    return w[-1][1] - w[0][1] + sum(a[1] for a, b in zip(w, w[1:]) if b[1] < a[1])


def _irate(w, _):
    if len(w) < 2 or w[-1][0] == w[-2][0]:
        return math.nan
    d = w[-1][1] - w[-2][1]
    return (w[-1][1] if d < 0 else d) / ((w[-1][0] - w[-2][0]) / 1000)


def _q(w, _):
    v = sorted(x for _, x in w)
    pos = 0.3 * (len(v) - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    return v[lo] * (1 - pos + lo) + v[hi] * (pos - lo) if lo != hi else v[lo]


def _slope(w, _):
    n = len(w)
    mx, my = sum(t for t, _ in w) / n / 1000, sum(v for _, v in w) / n
    d = sum((t / 1000 - mx) ** 2 for t, _ in w)
    return 0 if d == 0 else sum((t / 1000 - mx) * (v - my) for t, v in w) / d


CASES = {
    "increase": (R.increase, _inc),
    "irate": (R.irate, _irate),
    "idelta": (R.idelta, lambda w, _: w[-1][1] - w[-2][1] if len(w) > 1 else w[-1][1]),
    "changes": (R.changes, lambda w, _: sum(a[1] != b[1] for a, b in zip(w, w[1:]))),
    "resets": (R.resets, lambda w, _: sum(b[1] < a[1] for a, b in zip(w, w[1:]))),
    "sum": (R.sum_over_time, lambda w, _: sum(v for _, v in w)),
    "avg": (R.avg_over_time, lambda w, _: sum(v for _, v in w) / len(w)),
    "min": (R.min_over_time, lambda w, _: min(v for _, v in w)),
    "max": (R.max_over_time, lambda w, _: max(v for _, v in w)),
    "count": (R.count_over_time, lambda w, _: len(w)),
    "last": (R.last_over_time, lambda w, _: w[-1][1]),
    "stdvar": (R.stdvar_over_time, lambda w, _: sum((v - sum(x for _, x in w) / len(w)) ** 2 for _, v in w) / len(w)),
    "quantile": (lambda rv: R.quantile_over_time(0.3, rv), _q),
    "deriv": (R.deriv, _slope),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("step,range_ms,offset", [(1000, 1500, 0), (100, 1030, 0), (50, 1000, 170), (700, 0, 0), (1, 3, 0)])
def test_against_brute_force(spark, name, step, range_ms, offset):
    """Direct and class-wise evaluation, both ways of finding the predecessor, ties in time included."""
    rnd = random.Random(hash((step, range_ms)))
    span = 20_000 if step > 1 else 3000
    points = [
        (s, rnd.randrange(0, span, 10 if step > 1 else 1), float(rnd.randrange(0, 9)))
        for s in ("a", "b")
        for _ in range(120)
    ]
    grid = Grid(500, span, step)
    mine, theirs = CASES[name]
    got = values(mine(range_select(samples(spark, points), grid, range_ms, offset_ms=offset)))
    want = brute(points, grid, range_ms, theirs, offset)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (math.isnan(v) and math.isnan(got[k])) or got[k] == pytest.approx(v, abs=1e-6), k


@pytest.mark.parametrize("name", ["deriv", "stdvar", "avg"])
def test_large_values_lose_no_digits_in_blocks(spark, name):
    """A counter of epoch size with a spike in the same block: moments are merged, never subtracted."""
    rnd = random.Random(3)
    points = [("a", t, 1.7e9 + t / 1000 + rnd.random() + (1e9 if t == 30_000 else 0)) for t in range(0, 60_000, 500)]
    grid = Grid(0, 60_000, 1000)
    mine, _ = CASES[name]
    exact = {
        "deriv": lambda w, _: float(np.polyfit([(t - w[0][0]) / 1000 for t, _ in w], [v - 1.7e9 for _, v in w], 1)[0]) if len(w) > 1 else 0.0,
        "stdvar": lambda w, _: float(np.var([v - 1.7e9 for _, v in w])),
        "avg": lambda w, _: float(np.mean([v - 1.7e9 for _, v in w])) + 1.7e9,
    }[name]
    got = values(mine(range_select(samples(spark, points), grid, 10_000)))
    want = brute(points, grid, 10_000, exact)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-6, abs=1e-5), k


def test_blocks_give_three_parts_per_step_however_long_the_range(spark):
    """A range of 2,000 steps: the rows merged per step don't grow with it."""
    points = [("a", t, float(t % 7)) for t in range(0, 4_000_000, 1000)]
    rv = range_select(samples(spark, points), Grid(0, 4_000_000, 1000), 2_000_500)
    cells = R._celled(rv).groupBy("labels_fp", "__k", "__c", "__long").agg(F.count("*").alias("n"))
    whole = cells.groupBy("labels_fp", "__k", "__c").agg(F.sum("n").alias("n"))
    parts = R._slide(rv, whole, {"n": F.sum("n")}, cells.where("__long"))
    assert parts.count() <= 3 * 4001
    assert values(R.count_over_time(rv))[("a", 4_000_000)] == 2000


def test_predict_linear(spark):
    s = samples(spark, [("", t, 2 * t / 1000 + 1) for t in range(0, 10_000, 1000)])
    assert one(R.predict_linear(range_select(s, at(9000), 9000), 10)) == pytest.approx(39)
    assert one(R.predict_linear(range_select(s, at(11_000), 9000, offset_ms=2000), 10)) == pytest.approx(43)


def test_nan_is_skipped_by_extremes(spark):
    rv = range_select(samples(spark, [("", 0, "nan"), ("", 1, 3)]), at(10), 10)
    assert one(R.max_over_time(rv)) == 3
    assert one(R.min_over_time(rv)) == 3


def test_shape_is_one_row_per_series_and_step(spark):
    s = samples(spark, COUNTER)
    rows = range_select(s, Grid(0, 3000, 1000), 1000).rows()
    assert rows.groupBy("t_ms").agg(F.count("*").alias("n")).orderBy("t_ms").collect()[1]["n"] == 2


def test_trailing_frames_at_sample_times(spark):
    rnd = random.Random(6)
    rows = [(s, rnd.randint(-40, 300), rnd.randint(0, 9)) for s in "ab" for _ in range(80)]
    df = samples(spark, rows)
    for range_ms in (0, 1, 7, 50, 1000):
        got = sorted(map(tuple, R.frame_over_time(df, range_ms, F.sum).collect()))
        want = sorted((s, t, sum(w for r, u, w in rows if r == s and t - range_ms <= u <= t)) for s, t, _ in rows)
        assert got == want
    assert R.frame_over_time(df.where("false"), 5, F.sum).count() == 0
    nulls = df.select("labels_fp", F.lit(None).cast("long").alias("ts_ms"), "value")
    assert R.frame_over_time(nulls, 5, F.max).count() == 0
