"""Order-dependent computations that never gather a whole key into one task.

A single series, service or bucket may hold a large share of all rows. Running totals and
"previous row" are therefore computed inside (key, time chunk) groups; what a chunk needs from
the chunks before it arrives as one carry row per (key, chunk), taken from a small aggregate.
Exact quantiles narrow down to the value range that holds the wanted rank before anything is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telmora.functions.integers import floor_div
from telmora.runtime import checkpointed

_CHUNK = "__chunk"
DEFAULT_CHUNK_MS = 21_600_000
_CHUNKS_PER_WINDOW = 1024


def chunk_width(window_ms: int) -> int:
    """Chunk length that cuts a query window into about a thousand pieces."""
    return max(1, -(-window_ms // _CHUNKS_PER_WINDOW))


def _chunk(ts: str, width_ms: int) -> Column:
    return floor_div(F.col(ts), width_ms)


def _chunked(df: DataFrame, keys: list[str], ts: str, width_ms: int) -> DataFrame:
    """Rows with their chunk, shuffled by (key, chunk).

    The rows themselves and the per-chunk aggregate both start from this one exchange. They use the same
    columns, so Spark shuffles (and computes) the rows once and reads them twice.
    """
    return df.withColumn(_CHUNK, _chunk(ts, width_ms)).repartition(*keys, _CHUNK)


def _with_carries(rows: DataFrame, carries: DataFrame, keys: list[str]) -> DataFrame:
    """Add one leading row per chunk. Both sides are partitioned alike, so the union needs no shuffle; and
    a later filter on the keys reaches both sides alike, so that they keep sharing the exchange."""
    both = rows.withColumn("__carry", F.lit(False))
    return both.unionByName(carries.withColumn("__carry", F.lit(True)).repartition(*keys, _CHUNK))


def _inside(keys: list[str], ts: str, value: str):
    return Window.partitionBy(*keys, _CHUNK).orderBy(F.col("__carry").desc(), F.col(ts), F.col(value))


def running_total(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, output: str, chunk_ms: int = DEFAULT_CHUNK_MS
) -> DataFrame:
    """``keys, ts, value`` and the running sum of ``value`` per key in ``ts`` order (ties by value).

    The chunk totals give each chunk's opening balance, which enters the chunk as its first row.
    """
    keys = list(keys)
    rows = _chunked(df.select(*keys, ts, value), keys, ts, chunk_ms)
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    opening = (
        rows.groupBy(*keys, _CHUNK)
        .agg(F.sum(value).alias("__sum"), F.max(ts).alias("__last"))
        .withColumn("__open", F.sum("__sum").over(before))
        .withColumn("__open_ts", F.max("__last").over(before))
        .where(F.col("__open_ts").isNotNull())
        .select(*keys, F.col("__open_ts").alias(ts), F.col("__open").alias(value), _CHUNK)
    )
    run = F.sum(value).over(_inside(keys, ts, value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = _with_carries(rows, opening, keys).withColumn(output, run)
    return both.where(~F.col("__carry")).select(*keys, ts, value, output)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    window_ms: int,
    reach_ms: int | None = None,
) -> DataFrame:
    """``keys, ts, value`` with ``prev_ts``, ``prev_value`` and ``last_of_ts`` (no later row has the same
    time), in ``ts`` order, ties by value.

    ``reach_ms`` says that a predecessor further away than that is never used. When it is short against
    the window, each chunk also receives the rows just before its start, in the same pass; otherwise the
    last row before a chunk comes from a per-chunk aggregate. The chunk column stays in the result, so
    that a following aggregation by (key, chunk, …) needs no further exchange.
    """
    keys = list(keys)
    src = df.select(*keys, ts, value)
    if reach_ms is not None and reach_ms * 8 * 64 <= window_ms:
        rows = _overlapping(src, ts, reach_ms)
    else:
        rows = _chunked(src, keys, ts, chunk_width(window_ms))
        before = Window.partitionBy(*keys).orderBy(_CHUNK)
        carries = (
            rows.groupBy(*keys, _CHUNK)
            .agg(F.max(F.struct(F.col(ts), F.col(value))).alias("__last"))
            .withColumn("__prev", F.lag("__last").over(before))
            .where(F.col("__prev").isNotNull())
            .select(*keys, F.col(f"__prev.{ts}").alias(ts), F.col(f"__prev.{value}").alias(value), _CHUNK)
        )
        rows = _with_carries(rows, carries, keys)
    w = _inside(keys, ts, value)
    return (
        rows.withColumn("prev_ts", F.lag(ts).over(w))
        .withColumn("prev_value", F.lag(value).over(w))
        .withColumn("last_of_ts", ~F.coalesce(F.lead(ts).over(w) == F.col(ts), F.lit(False)))
        .where(~F.col("__carry"))
        .drop("__carry")
    )


def _overlapping(src: DataFrame, ts: str, reach_ms: int) -> DataFrame:
    """At most every eighth row is repeated as the lead-in of the next chunk."""
    width = max(1, reach_ms * 8)
    own = _chunk(ts, width)
    near_end = F.pmod(F.col(ts), F.lit(width)) >= width - reach_ms
    here = F.struct(own.alias("c"), F.lit(False).alias("lead_in"))
    following = F.struct((own + 1).alias("c"), F.lit(True).alias("lead_in"))
    placed = src.withColumn(
        "__target", F.explode(F.when(near_end, F.array(here, following)).otherwise(F.array(here)))
    )
    return placed.select(
        *src.columns, F.col("__target.c").alias(_CHUNK), F.col("__target.lead_in").alias("__carry")
    )


CHUNK_COLUMN = _CHUNK


def _value_bucket(value: Column) -> Column:
    """Coarse bucket number that never decreases with the value; NaN sorts first.

    1024 buckets per power of two, mirrored for negative values.
    """
    size = F.floor(F.log2(F.abs(value)) * 1024).cast("long") + 2_000_000
    return (
        F.when(F.isnan(value), F.lit(-9_000_000))
        .when(value == 0, F.lit(0))
        .when(F.abs(value) == F.lit(float("inf")), F.signum(value).cast("long") * 8_000_000)
        .when(value > 0, size)
        .otherwise(-size)
        .cast("long")
    )


#: Parts of a value bucket. A bucket spans less than a thousandth of its values, so it has under 2^43 doubles,
#: and a part under 2^24.
PARTS = 1 << 20


def _part(value: Column, low: Column, high: Column) -> Column:
    """Number of the equal part of [low, high] that holds the value; it never decreases with the value."""
    place = F.floor((value - low) / (high - low) * (PARTS - 1)).cast("int")
    return F.when((high > low) & ~F.isnan(value), place).otherwise(F.lit(0))


def _rank_bounds(rule: str, q: float, n: Column) -> tuple[Column, Column, Column]:
    """1-based lower rank, upper rank and weight of the upper one."""
    one = F.lit(1).cast("long")
    if rule == "r7":
        q = min(1.0, max(0.0, q))
        pos = F.lit(q) * (n - 1)
        low = F.floor(pos).cast("long")
        return low + 1, F.ceil(pos).cast("long") + 1, pos - low
    if rule == "r6":
        if q <= 0:
            return one, one, F.lit(0.0)
        if q >= 1:
            return n, n, F.lit(0.0)
        pos = (n + 1) * F.lit(q)
        low = F.floor(pos).cast("long")
        inside = (low >= 1) & (low < n)
        return (
            F.when(low < 1, one).when(low >= n, n).otherwise(low),
            F.when(low < 1, one).when(low >= n, n).otherwise(low + 1),
            F.when(inside, pos - low).otherwise(F.lit(0.0)),
        )
    raise ValueError(f"unknown quantile rule {rule!r}")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    rule: str = "r7",
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles per key, one output column per entry of ``quantiles``, plus ``n``.

    ``rule`` is "r7" (position q·(n−1)) or "r6" (position q·(n+1)). ``weight`` counts repeated rows.

    1. Equal values are counted together, which collapses heavy hitters before the shuffle.
    2. Counts per coarse value bucket tell, per key, which buckets hold the wanted ranks.
    3. Only those buckets are kept, and cut into up to a million equal parts. Counts per part tell which ones
       hold the wanted ranks; only these are sorted, so no task sorts a whole bucket, however close the values are.
    """
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1)
    counted = (
        df.select(*keys, F.col(value).cast("double").alias("__v"), w.cast("long").alias("__w"))
        .where(F.col("__v").isNotNull())
        .withColumn("__b", _value_bucket(F.col("__v")))
        .groupBy(*keys, "__b", "__v")
        .agg(F.sum("__w").alias("__c"))
    )
    upto = Window.partitionBy(*keys).orderBy("__b")
    buckets = (
        counted.groupBy(*keys, "__b")
        .agg(F.sum("__c").alias("__bc"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        .withColumn("__end", F.sum("__bc").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("n", F.sum("__bc").over(Window.partitionBy(*keys)))
    )
    start = F.col("__end") - F.col("__bc")
    ranks = {name: _rank_bounds(rule, q, F.col("n")) for name, q in quantiles.items()}

    def holds_rank(first: Column, last: Column) -> Column:
        bounds = [r for low, high, _ in ranks.values() for r in (low, high)]
        return reduce(lambda a, b: a | b, [(r > first) & (r <= last) for r in bounds], F.lit(False))

    names = [f"__k{i}" for i in range(len(keys))]
    wanted = buckets.where(holds_rank(start, F.col("__end"))).select(
        *[F.col(k).alias(k2) for k, k2 in zip(keys, names)], F.col("__b").alias("__wb"), start.alias("__start"), "__low", "__high", "n"
    )
    on = F.col("__b") == F.col("__wb")
    for k, k2 in zip(keys, names):
        on = on & F.col(k).eqNullSafe(F.col(k2))
    inside = counted.join(wanted, on, "inner").withColumn("__s", _part(F.col("__v"), F.col("__low"), F.col("__high")))
    inside = inside.select(*keys, "__b", "__s", "__v", "__c", "__start", "n")
    # The parts of a bucket that hold a wanted rank; at most PARTS rows meet in a window.
    before = Window.partitionBy(*keys, "__b").orderBy("__s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = inside.groupBy(*keys, "__b", "__s", "__start", "n").agg(F.sum("__c").alias("__sc"))
    totals = totals.withColumn("__upto", F.col("__start") + F.sum("__sc").over(before))
    parts = totals.where(holds_rank(F.col("__upto") - F.col("__sc"), F.col("__upto"))).select(
        *[F.col(k).alias(k2) for k, k2 in zip(keys, names)],
        F.col("__b").alias("__wb"), F.col("__s").alias("__ws"), (F.col("__upto") - F.col("__sc")).alias("__from"),
    )
    order = Window.partitionBy(*keys, "__b", "__s").orderBy(F.isnan("__v").desc(), F.col("__v"))
    placed = (
        inside.join(parts, on & (F.col("__s") == F.col("__ws")), "inner")
        .select(*keys, "__b", "__s", "__v", "__c", "__from", "n")
        .withColumn(
            "__hi", F.col("__from") + F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        )
        .withColumn("__lo", F.col("__hi") - F.col("__c"))
    )
    aggs = [F.max("n").alias("n")]
    for name, (low, high, _) in ranks.items():
        for part, r in (("l", low), ("h", high)):
            at = (r > F.col("__lo")) & (r <= F.col("__hi"))
            aggs.append(F.max(F.when(at, F.col("__v"))).alias(f"__{part}_{name}"))
    found = placed.groupBy(*keys).agg(*aggs)
    out = [F.col(k) for k in keys] + [F.col("n")]
    for name, (_, _, frac) in ranks.items():
        low_v, high_v = F.col(f"__l_{name}"), F.col(f"__h_{name}")
        if rule == "r7":
            between = low_v * (1 - frac) + high_v * frac
        else:
            between = low_v + frac * (high_v - low_v)
        out.append(F.when(frac == 0, low_v).otherwise(between).alias(name))
    return found.select(*out)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread: str) -> DataFrame:
    """The first ``k`` rows of each group in ``order``.

    A first round picks ``k`` per (group, hash slice of ``spread``), so a group that holds a large
    share of all rows is cut down in many tasks before its remaining candidates meet in one.
    """
    keys = list(keys)
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(spread), F.lit(64)))
    first = Window.partitionBy(*keys, "__slice").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        sliced.withColumn("__rn", F.row_number().over(first))
        .where(F.col("__rn") <= k)
        .withColumn("__rn", F.row_number().over(final))
        .where(F.col("__rn") <= k)
        .drop("__rn", "__slice")
    )


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], output: str, weight: str | None = None
) -> DataFrame:
    """1-based row number per key (or running sum of ``weight``) over rows of any number.

    Rows are range-partitioned by (key, order), so a large key spans many partitions; a row's number
    is its place inside its partition plus the key's counts in the partitions before. The partitioned
    rows are checkpointed because both sides of the join must see the same split.
    """
    keys, order = list(keys), list(order)
    placed = checkpointed(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("__at", F.monotonically_increasing_id())
        .withColumn("__part", F.spark_partition_id())
    )
    amount = F.col(weight) if weight else F.lit(1)
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "__part")
        .agg(F.min("__at").alias("__first"), F.sum(amount).alias("__n"))
        .withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .drop("__n")
    )
    if weight:
        w = Window.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
        inside = F.sum(weight).over(w)
    else:
        inside = F.col("__at") - F.col("__first") + 1
    renamed = offsets.withColumnsRenamed({k: f"__k_{k}" for k in keys}).withColumnRenamed("__part", "__own")
    same = F.col("__part") == F.col("__own")
    for k in keys:  # a null key is a key
        same = same & placed[k].eqNullSafe(F.col(f"__k_{k}"))
    return (
        placed.join(renamed, same)
        .withColumn(output, F.col("__base") + inside)
        .drop("__at", "__part", "__own", "__first", "__base", *[f"__k_{k}" for k in keys])
    )


def sliced_join(
    many: DataFrame, one: DataFrame, keys: Sequence[str], spread: str, how: str = "inner", slices: int | None = None
) -> DataFrame:
    """Join in which one key may own a large share of ``many``.

    Rows of ``many`` are cut into slices by a hash of ``spread``; ``one``, which has few rows per key, is
    repeated per slice. By default there are as many slices as an eighth of the shuffle partitions, 8 at least.
    """
    if slices is None:
        slices = max(8, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    left = many.withColumn("__slice", F.pmod(F.xxhash64(spread), F.lit(slices)).cast("int"))
    right = one.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return left.join(right, [*keys, "__slice"], how).drop("__slice")
