"""Jobs that change stored tables: roll-up, retention, eviction, growth of dictionaries and of key indexes.

Tables are Parquet folders partitioned by ``day``. A job that rewrites days first writes its whole result to a folder
beside the table, then a plan; only then does it touch the table, by dynamic overwrite of the days concerned
and by removing the folders of days that end empty. Each of these steps can be repeated: ``resume`` finishes a
job whose plan was written and clears one whose plan was not, so a failure leaves the days before or the
days after. One job or writer at a time may change the days that a job rewrites.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from telmora.operators.ordered import ranked
from telmora.plans import maintenance as M
from telmora.runtime import checkpointed
from telmora.schema import NS_PER_S
from telmora.sources import tables as TB
from telmora.sources.tables import day_of, scan

DAY_NS = 86_400 * NS_PER_S
MINUTE_NS = 60 * NS_PER_S
_EPOCH = date(1970, 1, 1)
_PLAN = "action string, target string, staged string, day date"


def _day(ts_ns: int) -> date:
    return _EPOCH + timedelta(days=ts_ns // DAY_NS)


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _folder(spark, path)
    return fs.exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    fs, where = _folder(spark, path)
    fs.delete(where, True)


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """Days of a table, from the names of its folders; no file is opened."""
    fs, where = _folder(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    return sorted(date.fromisoformat(n[4:]) for n in names if n.startswith("day=") and n[4:5].isdigit())


def _stage(path: str) -> str:
    return f"{path.rstrip('/')}__job"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A staged table, None if it has no rows."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _write_days(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("day").parquet(path)


def _commit(spark: SparkSession, stage: str, steps: list[tuple]) -> None:
    """Write the plan of a job; from here on it will be carried out."""
    spark.createDataFrame(steps, _PLAN).coalesce(1).write.mode("overwrite").parquet(f"{stage}/plan")


def resume(spark: SparkSession, path: str) -> bool:
    """Carry out the job on the table at ``path`` whose plan was written, if any; clear what an unfinished one left."""
    stage = _stage(path)
    planned = exists(spark, f"{stage}/plan/_SUCCESS")
    if planned:
        for step in spark.read.parquet(f"{stage}/plan").collect():  # one row for each day that goes, and for each table
            _apply(spark, step["action"], step["target"], step["staged"], step["day"])
    _remove(spark, stage)
    return planned


def _apply(spark: SparkSession, action: str, target: str, staged: str | None, day: date | None) -> None:
    if action == "drop":
        _remove(spark, f"{target}/day={day.isoformat()}")
        return
    rows = _read(spark, staged)
    if rows is not None:
        overwrite = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        overwrite.partitionBy("day").parquet(target)


def _empty_days(spark: SparkSession, staged: str, touched: Sequence[date]) -> list[date]:
    return sorted(set(touched) - set(stored_days(spark, staged)))


# --- roll-up ------------------------------------------------------------------------------------------


def roll_up_table(
    spark: SparkSession, raw: str, rollup: str, now_ns: int, raw_days: float, resolution_s: int = 60
) -> bool:
    """Replace raw points in complete buckets older than ``raw_days`` by roll-up rows; True if there were any.

    Only days up to the boundary are read, of raw and roll-up table alike. Points that came late, after their
    bucket had been rolled up, are merged into the bucket's row. Raw days before the boundary's day go as
    folders, the boundary's day is rewritten.
    """
    resume(spark, rollup)
    boundary = M.rollup_boundary(now_ns, raw_days, resolution_s)
    touched = [d for d in stored_days(spark, raw) if d <= _day(boundary - 1)] if boundary > 0 else []
    if not touched:
        return False
    stage = _stage(rollup)
    # A bucket may start on the day before its points.
    old = scan(spark, raw, "ts_unix_nano", DAY_NS * (touched[0] - _EPOCH).days, boundary - 1)
    fresh = M.roll_up(old, boundary, resolution_s).withColumn("written_at", F.lit(1))
    fresh = checkpointed(fresh.withColumn("day", day_of(F.col("bucket_start"))))
    days = [r["day"] for r in fresh.select("day").distinct().collect()]  # one row for each day
    if not days:
        return False
    known = sorted(set(days) & set(stored_days(spark, rollup)))
    rows = fresh
    if known:
        before = spark.read.parquet(rollup).where(F.col("day").isin(known)).withColumn("written_at", F.lit(0))
        rows = rows.unionByName(before)
    merged = M.merge_rollups(rows).withColumn("day", day_of(F.col("bucket_start")))
    _write_days(merged.repartition("day", "name"), f"{stage}/rollup")
    edge = _day(boundary)
    remainder = scan(spark, raw, "ts_unix_nano", boundary, DAY_NS * ((edge - _EPOCH).days + 1) - 1)
    if edge in touched:
        _write_days(remainder, f"{stage}/raw")
    gone = [d for d in touched if d != edge]
    if edge in touched:
        gone += _empty_days(spark, f"{stage}/raw", [edge])
    steps = [("replace", rollup, f"{stage}/rollup", None), ("replace", raw, f"{stage}/raw", None)]
    _commit(spark, stage, steps + [("drop", raw, None, d) for d in gone])
    return resume(spark, rollup)


# --- retention ----------------------------------------------------------------------------------------


def drop_expired(spark: SparkSession, path: str, ts: str, now_ns: int, days: int) -> int:
    """Delete rows older than ``days``; returns their number.

    Whole days go as folders: their rows are counted from the files' footers only. The day that holds the cut-off
    is rewritten; other days keep their files.
    """
    resume(spark, path)
    cutoff = M.retention_cutoff(now_ns, days)
    if cutoff is None:
        return 0
    edge = _day(cutoff)
    stored = stored_days(spark, path)
    older = [d for d in stored if d < edge]
    gone = spark.read.parquet(path).where(F.col("day").isin(older)).count() if older else 0
    steps = [("drop", path, None, d) for d in older]
    if edge in stored:
        start = DAY_NS * (edge - _EPOCH).days
        expired = scan(spark, path, ts, start, cutoff - 1).count() if cutoff > start else 0
        if expired:
            gone += expired
            _write_days(scan(spark, path, ts, cutoff, start + DAY_NS - 1), f"{_stage(path)}/kept")
            steps.append(("replace", path, f"{_stage(path)}/kept", None))
            steps += [("drop", path, None, d) for d in _empty_days(spark, f"{_stage(path)}/kept", [edge])]
    if steps:
        _commit(spark, _stage(path), steps)
        resume(spark, path)
    return gone


def sweep(spark: SparkSession, tables: dict[str, tuple[str, str, int]], now_ns: int) -> DataFrame:
    """Retention of several tables, given as signal: (path, time column, days); returns ``signal, deleted``.

    Signals may repeat as ``metrics`` and ``metrics_rollup``; the latter count as metrics.
    """
    counts: dict[str, int] = {}
    for signal, (path, ts, days) in tables.items():
        name = signal.removesuffix("_rollup")
        counts[name] = counts.get(name, 0) + drop_expired(spark, path, ts, now_ns, days)
    return spark.createDataFrame(sorted(counts.items()), "signal string, deleted long")


# --- eviction -----------------------------------------------------------------------------------------


def minute_cube(rows: DataFrame) -> DataFrame:
    """Bytes and rows by signal, day and minute: the one pass over ``signal, ts, est_bytes`` that eviction needs."""
    ts = F.col("ts")
    return rows.groupBy("signal", (ts - ts % F.lit(DAY_NS)).alias("day_ns"), (ts - ts % F.lit(MINUTE_NS)).alias("minute_ns")).agg(
        F.sum("est_bytes").alias("bytes"), F.count(F.lit(1)).alias("n")
    )


def budget_cut(cube: DataFrame, max_bytes: int, fill: float = 0.9) -> tuple[int, int] | None:
    """The minute in which the budget runs out, counted from the newest, and the bytes left for it; None if all fits.

    The driver sees one number for each day, and one for each minute of a single day.
    """
    by_day = cube.groupBy("day_ns").agg(F.sum("bytes").alias("bytes")).orderBy(F.col("day_ns").desc()).collect()
    if sum(r["bytes"] for r in by_day) <= max_bytes:
        return None
    left = int(max_bytes * fill)
    for r in by_day:
        if r["bytes"] > left:
            inside = cube.where(F.col("day_ns") == r["day_ns"]).groupBy("minute_ns").agg(F.sum("bytes").alias("bytes"))
            for m in inside.orderBy(F.col("minute_ns").desc()).collect():
                if m["bytes"] > left:
                    return m["minute_ns"], left
                left -= m["bytes"]
        left -= r["bytes"]
    return None


def eviction_counts(rows: DataFrame, max_bytes: int, fill: float = 0.9) -> DataFrame:
    """``signal, kept, evicted`` of an eviction to ``max_bytes``; ``rows``: ``signal, row_key, ts, est_bytes``.

    Of signals named ``..._rollup`` rows count under the name before that. Whole minutes are counted from the
    cube; only rows of the minute in which the budget ends are put in order.
    """
    cube = checkpointed(minute_cube(rows))
    cut = budget_cut(cube, max_bytes, fill)
    name = F.regexp_replace("signal", "_rollup$", "").alias("signal")
    if cut is None:
        return cube.groupBy(name).agg(F.sum("n").alias("kept"), F.lit(0).cast("long").alias("evicted"))
    minute, _ = cut
    newer, older = F.col("minute_ns") > minute, F.col("minute_ns") < minute
    zero = F.lit(0).cast("long")
    whole = cube.select(name, F.when(newer, F.col("n")).otherwise(zero).alias("kept"), F.when(older, F.col("n")).otherwise(zero).alias("evicted"))
    edge = _edge(rows, cut).select(name, F.col("__stays").cast("long").alias("kept"), (~F.col("__stays")).cast("long").alias("evicted"))
    return whole.unionByName(edge).groupBy("signal").agg(F.sum("kept").alias("kept"), F.sum("evicted").alias("evicted"))


def _edge(rows: DataFrame, cut: tuple[int, int]) -> DataFrame:
    """Rows of the minute in which the budget ends, with ``__stays``."""
    minute, left = cut
    inside = rows.where((F.col("ts") >= minute) & (F.col("ts") < minute + MINUTE_NS)).withColumn("__age", -F.col("ts"))
    placed = ranked(inside, [], ["__age", "signal", "row_key"], "__used", "est_bytes")
    return placed.withColumn("__stays", F.col("__used") <= left).drop("__age", "__used")


def evict_tables(
    spark: SparkSession, tables: dict[str, tuple[str, str, str]], est_bytes, max_bytes: int, fill: float = 0.9
) -> DataFrame:
    """Delete the oldest rows of all tables until at most ``fill`` of ``max_bytes`` is used; ``signal, kept, evicted``.

    ``tables``: signal: (path, time column, key column); ``est_bytes(df)`` estimates a row. Days before the cut
    go as folders, the day of the cut is rewritten.
    """
    for path, _, _ in tables.values():
        resume(spark, path)
    stored = {s: t for s, t in tables.items() if stored_days(spark, t[0])}
    rows = None
    for signal, (path, ts, key) in stored.items():
        df = spark.read.parquet(path)
        part = df.select(F.lit(signal).alias("signal"), F.col(key).cast("string").alias("row_key"), F.col(ts).alias("ts"), est_bytes(df).cast("long").alias("est_bytes"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return spark.createDataFrame([], "signal string, kept long, evicted long")
    counts = checkpointed(eviction_counts(rows, max_bytes, fill))
    cut = budget_cut(minute_cube(rows), max_bytes, fill)
    if cut is None:
        return counts
    edge, minute = _day(cut[0]), cut[0]
    keep = checkpointed(_edge(rows, cut).where("__stays").select("signal", "row_key", "ts").distinct())
    for signal, (path, ts, key) in stored.items():
        days = stored_days(spark, path)
        steps = [("drop", path, None, d) for d in days if d < edge]
        if edge in days:
            start = DAY_NS * (edge - _EPOCH).days
            day = scan(spark, path, ts, start, start + DAY_NS - 1)
            mine = keep.where(F.col("signal") == signal).select(F.col("row_key").alias("__key"), F.col("ts").alias("__ts"))
            same = (F.col(key).cast("string").eqNullSafe(F.col("__key"))) & (F.col(ts) == F.col("__ts"))
            edge_minute = day.where(F.col(ts) < minute + MINUTE_NS).where(F.col(ts) >= minute)
            kept = day.where(F.col(ts) >= minute + MINUTE_NS).unionByName(edge_minute.join(mine, same, "left_semi"))
            _write_days(kept, f"{_stage(path)}/kept")
            steps.append(("replace", path, f"{_stage(path)}/kept", None))
            steps += [("drop", path, None, d) for d in _empty_days(spark, f"{_stage(path)}/kept", [edge])]
        if steps:
            _commit(spark, _stage(path), steps)
            resume(spark, path)
    return counts


# --- tables that only grow ----------------------------------------------------------------------------

SERIES_BUCKETS, KEY_BUCKETS = 64, 256


def _bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _stored_keys(spark: SparkSession, rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame | None:
    """Keys of the bucketed table at ``path`` in the buckets that occur in ``rows``; None if there is no table."""
    if not exists(spark, f"{path}/_SUCCESS"):
        return None
    buckets = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most the number of buckets
    return spark.read.parquet(path).where(F.col("bucket").isin(buckets)).select("bucket", *keys)


def _only_new(spark: SparkSession, rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in the bucketed table at ``path``; reads only the buckets that occur in ``rows``."""
    known = _stored_keys(spark, rows, path, keys)
    return rows if known is None else rows.join(known, ["bucket", *keys], "left_anti")


def _append_buckets(rows: DataFrame, path: str, sort: Sequence[str]) -> None:
    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", *sort)
    ordered.write.mode("append").partitionBy("bucket").parquet(path)


def insert_series(series: DataFrame, path: str, buckets: int = SERIES_BUCKETS) -> DataFrame:
    """Insert-or-ignore of ``series`` (series_id, ...) into the stored dictionary; returns the rows that were new.

    The dictionary is cut by a hash of the id; only buckets with series of this batch are read. Ids are digests, so a
    series has the same one in every batch.
    """
    spark = series.sparkSession
    batch = checkpointed(_bucketed(series.dropDuplicates(["series_id"]), ["series_id"], buckets))
    fresh = checkpointed(_only_new(spark, batch, path, ["series_id"]))
    _append_buckets(fresh, path, ["series_id"])
    return fresh.drop("bucket")


def remove_orphans(spark: SparkSession, path: str, *facts: DataFrame) -> int:
    """Rewrite the buckets of the dictionary that hold series without points; returns how many series went."""
    if not exists(spark, f"{path}/_SUCCESS"):
        return 0
    series = spark.read.parquet(path)
    orphans = checkpointed(M.orphan_series(series, *facts).select("series_id", "bucket"))
    per_bucket = {r["bucket"]: r["n"] for r in orphans.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per_bucket:
        return 0
    touched = series.where(F.col("bucket").isin(list(per_bucket)))
    kept = checkpointed(touched.join(orphans, ["bucket", "series_id"], "left_anti"))
    left = {r["bucket"] for r in kept.select("bucket").distinct().collect()}
    overwrite = kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    overwrite.partitionBy("bucket").parquet(path)
    for bucket in set(per_bucket) - left:
        _remove(spark, f"{path}/bucket={bucket}")
    return sum(per_bucket.values())


def spans_not_stored(spans: DataFrame, keys: str, arrival: str = "ingest_seq", buckets: int = KEY_BUCKETS) -> DataFrame:
    """The first arrival of each (trace_id, span_id) whose ids the table at ``keys`` lacks.

    ``keys`` holds the ids stored so far, cut by a hash of the trace id and sorted by it. Only its buckets with
    traces of this batch are read, and no stored span of any day. Whole spans are dealt out once, by both ids, and
    written once; the buckets come from the trace ids alone.
    """
    ids = ["trace_id", "span_id"]
    known = _stored_keys(spans.sparkSession, _bucketed(spans.select("trace_id"), ["trace_id"], buckets), keys, ids)
    return checkpointed(TB.new_spans(spans, None if known is None else known.drop("bucket"), arrival))


def remember_spans(spans: DataFrame, keys: str, buckets: int = KEY_BUCKETS) -> None:
    """Add the ids of spans that were just stored."""
    ids = _bucketed(spans.select("trace_id", "span_id"), ["trace_id"], buckets)
    _append_buckets(ids, keys, ["trace_id", "span_id"])


def append_new_spans(spans: DataFrame, path: str, keys: str, arrival: str = "ingest_seq") -> int:
    """Append spans, first write wins per (trace_id, span_id); returns how many were appended.

    The ids are written after the spans: a job that fails between the two is mended with ``restore_keys``.
    """
    fresh = spans_not_stored(spans, keys, arrival)
    TB.append_spans(fresh, path, None, arrival)
    remember_spans(fresh, keys)
    return fresh.count()


def restore_keys(spark: SparkSession, path: str, keys: str, from_ns: int, to_ns: int, buckets: int = KEY_BUCKETS) -> int:
    """Add the ids of stored spans of a time range that the key table lacks; returns their number."""
    stored = scan(spark, path, "start_unix_nano", from_ns, to_ns).select("trace_id", "span_id").distinct()
    lacking = checkpointed(_only_new(spark, checkpointed(_bucketed(stored, ["trace_id"], buckets)), keys, ["trace_id", "span_id"]))
    _append_buckets(lacking, keys, ["trace_id", "span_id"])
    return lacking.count()
