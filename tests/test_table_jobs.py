"""Round trips of the jobs that change stored tables."""

import pytest
from pyspark.sql import functions as F

from telmora.plans import table_jobs as J
from telmora.sources import tables as TB

SEC = 1_000_000_000
DAY = 86_400 * SEC
METRICS = (
    "series_id string, name string, unit string, type int, temporality int, ts_unix_nano long, value double, count long,"
    "sum double, min double, max double, bucket_counts array<bigint>, explicit_bounds array<double>"
)


def delta(ts, value, name="m"):
    return ("s", name, None, 1, 1, ts, float(value), None, None, None, None, None, None)


def hist(ts, counts):
    return ("h", "lat", None, 2, 1, ts, 0.0, sum(counts), 1.0, 1.0, 2.0, counts, [1.0])


def files(path):
    return {str(p.relative_to(path)): (p.stat().st_size, p.stat().st_mtime_ns) for p in path.rglob("*.parquet")}


def rolled(spark, path):
    rows = spark.read.parquet(str(path)).collect()
    return sorted((r["name"], r["bucket_start"], r["value"], r["count"], r["bucket_counts"]) for r in rows)


@pytest.fixture
def raw(spark, tmp_path):
    rows = [delta(d * DAY + s * SEC, 1 + s) for d in range(1, 6) for s in (0, 30, 60)] + [hist(DAY, [1, 2]), hist(DAY + 1, [3, 4])]
    TB.append_metrics(spark.createDataFrame(rows, METRICS), str(tmp_path / "raw"))
    return tmp_path / "raw"


def test_rollup_replaces_raw_days_and_merges_late_points(spark, raw, tmp_path):
    roll, now = tmp_path / "rollup", 10 * DAY + 61 * SEC
    untouched = {k: v for k, v in files(raw).items() if "1970-01-05" in k or "1970-01-06" in k}
    assert J.roll_up_table(spark, str(raw), str(roll), now, 7)  # the boundary is a minute into day 3
    want = [("m", d * DAY, 32.0, None, None) for d in (1, 2, 3)] + [("m", d * DAY + 60 * SEC, 61.0, None, None) for d in (1, 2)]
    got = {(r[0], r[1]): r[2:] for r in rolled(spark, roll)}
    assert {k: v[0] for k, v in got.items() if k[0] == "m"} == {(w[0], w[1]): w[2] for w in want}
    assert got["lat", DAY] == (2.0, 10, [4, 6])
    left = sorted(r[0] for r in spark.read.parquet(str(raw)).select("ts_unix_nano").collect())
    assert left == [3 * DAY + 60 * SEC] + [d * DAY + s * SEC for d in (4, 5) for s in (0, 30, 60)]
    assert [str(d) for d in J.stored_days(spark, str(raw))] == ["1970-01-04", "1970-01-05", "1970-01-06"]
    assert untouched.items() <= files(raw).items()

    day2 = {k: v for k, v in files(roll).items() if "1970-01-03" in k}
    TB.append_metrics(spark.createDataFrame([delta(DAY + 5 * SEC, 100), hist(DAY + 2, [10, 10])], METRICS), str(raw))
    assert J.roll_up_table(spark, str(raw), str(roll), now, 7)
    got = {(r[0], r[1]): r[2:] for r in rolled(spark, roll)}
    assert got["m", DAY][0] == 132.0 and got["lat", DAY] == (3.0, 30, [14, 16])
    assert len(got) == 6 and day2.items() <= files(roll).items()
    assert not J.roll_up_table(spark, str(raw), str(roll), now, 7)


def test_failed_rollup_leaves_old_days_and_planned_one_is_finished(spark, raw, tmp_path, monkeypatch):
    roll, now = tmp_path / "rollup", 10 * DAY
    before = files(raw)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(J, "_commit", broken)
        with pytest.raises(RuntimeError):
            J.roll_up_table(spark, str(raw), str(roll), now, 7)
    assert files(raw) == before and not roll.exists()
    assert not J.resume(spark, str(roll)) and not (tmp_path / "rollup__job").exists()

    calls = []
    apply = J._apply

    def second_fails(*step):
        calls.append(step)
        if len(calls) == 3:
            raise RuntimeError("lost")
        apply(*step)

    with monkeypatch.context() as m:
        m.setattr(J, "_apply", second_fails)
        with pytest.raises(RuntimeError):
            J.roll_up_table(spark, str(raw), str(roll), now, 7)
    assert J.resume(spark, str(roll)) and not J.resume(spark, str(roll))
    assert sum(r[2] for r in rolled(spark, roll) if r[0] == "m") == 2 * 93.0
    assert spark.read.parquet(str(raw)).count() == 9


def test_retention_drops_days_and_rewrites_only_the_edge(spark, raw, tmp_path):
    before = files(raw)
    # ten days after 45 s into day 3
    now = 13 * DAY + 45 * SEC
    got = J.sweep(spark, {"metrics": (str(raw), "ts_unix_nano", 10), "logs": (str(tmp_path / "none"), "ts_unix_nano", 10)}, now)
    assert {r["signal"]: r["deleted"] for r in got.collect()} == {"metrics": 3 + 2 + 3 + 2, "logs": 0}
    after = files(raw)
    assert {k.split("/")[0] for k in after} == {"day=1970-01-04", "day=1970-01-05", "day=1970-01-06"}
    assert {k: v for k, v in before.items() if k.split("/")[0] > "day=1970-01-04"}.items() <= after.items()
    assert sorted(r[0] for r in spark.read.parquet(str(raw)).where("day = '1970-01-04'").select("ts_unix_nano").collect()) == [3 * DAY + 60 * SEC]
    assert J.drop_expired(spark, str(raw), "ts_unix_nano", now, 10) == 0 and files(raw) == after
    assert J.drop_expired(spark, str(raw), "ts_unix_nano", now, 0) == 0
    assert J.drop_expired(spark, str(raw), "ts_unix_nano", 30 * DAY, 1) == 7 and not files(raw)


def test_eviction_deletes_the_oldest_rows_of_all_tables(spark, tmp_path):
    logs = spark.createDataFrame([(f"l{i}", i * 20 * SEC + 3 * DAY * (i % 2)) for i in range(40)], "id string, ts_unix_nano long")
    TB.append_logs(logs, str(tmp_path / "logs"))
    TB.append_metrics(
        spark.createDataFrame([(f"m{i}", "m", i * 7 * SEC + 3 * DAY) for i in range(60)], "id string, name string, ts_unix_nano long"),
        str(tmp_path / "metrics"),
    )
    tables = {"logs": (str(tmp_path / "logs"), "ts_unix_nano", "id"), "metrics_rollup": (str(tmp_path / "metrics"), "ts_unix_nano", "id")}
    size = lambda df: F.lit(10)
    assert {r["evicted"] for r in J.evict_tables(spark, tables, size, 1000).collect()} == {0}
    rows = [(r[1], "logs", r[0]) for r in logs.collect()] + [(i * 7 * SEC + 3 * DAY, "metrics_rollup", f"m{i}") for i in range(60)]
    want = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:45]  # 90 % of 500 bytes
    got = {r["signal"]: (r["kept"], r["evicted"]) for r in J.evict_tables(spark, tables, size, 500).collect()}
    n = sum(r[1] == "logs" for r in want)
    assert got == {"logs": (n, 40 - n), "metrics": (45 - n, 60 - 45 + n)}
    left = {(s, r["id"]) for s, p in (("logs", "logs"), ("metrics_rollup", "metrics")) for r in spark.read.parquet(str(tmp_path / p)).collect()}
    assert left == {(r[1], r[2]) for r in want}


def test_series_dictionary_grows_by_buckets(spark, tmp_path):
    path = str(tmp_path / "series")
    row = lambda i: (f"id{i}", "m")
    first = spark.createDataFrame([row(i) for i in range(10)] + [row(1)], "series_id string, name string")
    assert J.insert_series(first, path, 8).count() == 10
    one_bucket = files(tmp_path / "series")
    second = spark.createDataFrame([row(3), row(99)], "series_id string, name string")
    assert [r["series_id"] for r in J.insert_series(second, path, 8).collect()] == ["id99"]
    stored = [r["series_id"] for r in spark.read.parquet(path).collect()]
    assert sorted(stored) == sorted({f"id{i}" for i in range(10)} | {"id99"}) and one_bucket.items() <= files(tmp_path / "series").items()
    facts = spark.createDataFrame([("id3",), ("id99",)], "series_id string")
    assert J.remove_orphans(spark, path, facts) == 9
    assert sorted(r["series_id"] for r in spark.read.parquet(path).collect()) == ["id3", "id99"]
    assert J.remove_orphans(spark, path, facts) == 0


def test_only_buckets_of_the_batch_are_read(spark, tmp_path):
    path = str(tmp_path / "series")
    J.insert_series(spark.createDataFrame([(f"id{i}",) for i in range(200)], "series_id string"), path, 16)
    batch = J._bucketed(spark.createDataFrame([("id7",)], "series_id string"), ["series_id"], 16)
    plan = J._only_new(spark, batch, path, ["series_id"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_spans_are_appended_once_over_days_and_batches(spark, tmp_path):
    spans, keys = str(tmp_path / "spans"), str(tmp_path / "keys")
    schema = "trace_id string, span_id string, start_unix_nano long, name string, ingest_seq long"
    one = spark.createDataFrame([("t1", "a", DAY, "first", 1), ("t1", "a", DAY, "again", 2), ("t2", "a", DAY, "first", 3)], schema)
    assert J.append_new_spans(one, spans, keys) == 2
    two = spark.createDataFrame([("t1", "a", 5 * DAY, "other day", 4), ("t3", "a", 5 * DAY, "first", 5)], schema)
    assert J.append_new_spans(two, spans, keys) == 1
    got = spark.read.parquet(spans).collect()
    assert sorted((r["trace_id"], r["name"]) for r in got) == [("t1", "first"), ("t2", "first"), ("t3", "first")]
    TB.append_spans(spark.createDataFrame([("t4", "b", 6 * DAY, "x", 6)], schema), spans)  # a job that failed before its keys
    assert J.restore_keys(spark, spans, keys, 6 * DAY, 7 * DAY) == 1
    assert J.append_new_spans(spark.createDataFrame([("t4", "b", 6 * DAY, "x", 6)], schema), spans, keys) == 0


def test_spans_not_stored_are_written_once(spark, tmp_path, monkeypatch):
    schema = "trace_id string, span_id string, start_unix_nano long, name string, ingest_seq long"
    keys, written = str(tmp_path / "keys"), []
    checkpointed = J.checkpointed
    monkeypatch.setattr(J, "checkpointed", lambda df: written.append(df.columns) or checkpointed(df))
    one = spark.createDataFrame([("t1", "a", 0, "x", 2), ("t1", "a", 0, "y", 1), (None, "b", 0, "z", 3)], schema)
    first = J.spans_not_stored(one, keys, buckets=4)
    assert sorted(r["name"] for r in first.collect()) == ["y", "z"] and first.columns == one.columns
    J.remember_spans(first, keys, 4)
    two = spark.createDataFrame([("t1", "a", DAY, "x", 4), ("t1", "c", DAY, "w", 5), (None, "b", 0, "z", 6)], schema)
    assert sorted(r["name"] for r in J.spans_not_stored(two, keys, buckets=4).collect()) == ["w", "z"]
    assert len(written) == 2
