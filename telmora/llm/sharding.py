"""K-d tree partitioning of rows into shards of near equal weight."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telmora.llm.common import checkpointed, partitions, small_table

#: Buckets of one refinement pass; a pass collects at most (nodes of a level) x BUCKETS sums.
BUCKETS = 1024
#: A cut is good enough if it is off by at most this share of a shard.
TOLERANCE = 0.0005


@dataclass
class _Box:
    """A box of the tree: ``leaves`` shards from ``first`` on, cut along one axis."""

    first: int
    leaves: int
    axis: int = 0
    cut: tuple[float, ...] = (0.0,)


@dataclass
class _Search:
    """The weighted median of one box: fixed values of leading keys, then a range of the next key."""

    box: _Box
    target: float
    low: float
    high: float
    fixed: tuple[float, ...] = ()
    before: float = 0.0


_CUT = "__box int, __axis int, __c0 double, __c1 double, __c2 double, __above int"
_RANGE = "__box int, __axis int, __f0 double, __f1 double, __low double, __high double"


def kd_shards(rows: DataFrame, weight: str, axes: list[str], leaves: int) -> DataFrame:
    """Add ``shard`` (0 to ``leaves`` - 1) and ``slot`` (gapless from 0 in each shard).

    A box of several shards is split along its widest axis, measured against the whole table's
    extent, at the weighted quantile that leaves each side its share of the shards. The medians
    are found by sums over buckets that narrow down to one value; equal values are told apart by a
    hash and then by the row, so one value may hold any share of the rows. The driver sees sums
    only, at most ``BUCKETS`` for each box of a level.

    ``axes`` are numeric columns; a null counts as the least value. An empty table gives no rows.
    Columns named ``shard`` or ``slot`` are replaced.
    """
    names = [f"__axis{i}" for i in range(len(axes))]
    wide = rows.drop("shard", "slot")
    wide = wide.withColumns(
        {n: F.coalesce(F.col(a).cast("double"), F.lit(float("-1e300"))) for n, a in zip(names, axes)}
        | {"__weight": F.col(weight).cast("double"), "__row": F.monotonically_increasing_id().cast("double")}
    )
    mixed = F.xxhash64(*wide.columns)
    table = checkpointed(wide.withColumns({"__tie": F.shiftrightunsigned(mixed, 12).cast("double"), "__box": F.lit(0)}))
    least = {n: F.min(F.when(F.col(n) > -1e300, F.col(n))).alias(n) for n in names}
    total = table.agg(
        F.sum("__weight").alias("w"),
        *[x.alias(f"low{n}") for n, x in least.items()],
        *[F.max(n).alias(f"high{n}") for n in names],
    ).first()
    # A null lies one hundredth of the extent below the least value.
    span = {n: max((total[f"high{n}"] or 0.0) - (total[f"low{n}"] or 0.0), 0.0) or 1.0 for n in names}
    floor = {n: (total[f"low{n}"] or 0.0) - span[n] / 100 for n in names}
    table = table.withColumns({n: F.greatest(F.col(n), F.lit(floor[n])) for n in names})
    placed = table.select("__box", "__weight", "__row", "__tie", *names)
    open_boxes = [_Box(0, leaves)] if leaves > 1 and total["w"] is not None else []
    while open_boxes:
        _find_cuts(placed, open_boxes, span, TOLERANCE * total["w"] / leaves)
        placed = checkpointed(_apply_cuts(placed, open_boxes, names))
        halves = [(_Box(b.first, b.leaves // 2), _Box(b.first + b.leaves // 2, b.leaves - b.leaves // 2)) for b in open_boxes]
        open_boxes = [b for pair in halves for b in pair if b.leaves > 1]
    slots = _slots(placed.select(F.col("__box").alias("shard"), "__row"))
    return table.drop("__weight", "__tie", "__box", *names).join(slots, "__row").drop("__row")


def _on_axis(names: list[str]) -> Column:
    """A row's value on the axis of its box."""
    return F.get(F.array(*names), F.col("__axis"))


def _apply_cuts(placed: DataFrame, boxes: list[_Box], names: list[str]) -> DataFrame:
    """Move rows above the cut of their box to its upper half. The table of cuts has a row for each box."""
    rows = [(b.first, b.axis, *b.cut, *[None] * (3 - len(b.cut)), b.first + b.leaves // 2) for b in boxes]
    cuts = small_table(placed.sparkSession, rows, _CUT)
    value, below = _on_axis(names), F.lit(False)
    for key, at in (("__row", "__c2"), ("__tie", "__c1"), (None, "__c0")):
        x = value if key is None else F.col(key)
        below = F.coalesce((x < F.col(at)) | ((x == F.col(at)) & below), F.lit(False))
    moved = F.when(F.col("__above").isNull() | below, F.col("__box")).otherwise(F.col("__above"))
    joined = placed.join(F.broadcast(cuts), "__box", "left").withColumn("__box", moved)
    return joined.drop(*[c.split()[0] for c in _CUT.split(", ")[1:]])


def _find_cuts(placed: DataFrame, boxes: list[_Box], span: dict[str, float], tolerance: float) -> None:
    """Choose axis and cut of every box of one level."""
    by_first = {b.first: b for b in boxes}
    names = list(span)
    extents = placed.groupBy("__box").agg(
        F.sum("__weight").alias("w"),
        *[f(n).alias(k + n) for n in span for k, f in (("low", F.min), ("high", F.max))],
    )
    searches: dict[int, _Search] = {}
    for r in extents.collect():
        if box := by_first.get(r["__box"]):
            widest = max(names, key=lambda n: (r[f"high{n}"] - r[f"low{n}"]) / span[n])
            box.axis = names.index(widest)
            share = r["w"] * (box.leaves // 2) / box.leaves
            searches[box.first] = _Search(box, share, r[f"low{widest}"], r[f"high{widest}"])
    while searches:
        searches = _narrow(placed, searches, names, tolerance)


def _narrow(placed: DataFrame, searches: dict[int, _Search], names: list[str], tolerance: float) -> dict[int, _Search]:
    """One pass over the rows for all open searches; finished ones set the cut of their box."""
    rows = [(k, s.box.axis, *s.fixed, *[None] * (2 - len(s.fixed)), s.low, s.high) for k, s in searches.items()]
    ranges = small_table(placed.sparkSession, rows, _RANGE)
    value = F.col("__value")
    key = (
        F.when(F.col("__f0").isNull(), value)
        .when((value == F.col("__f0")) & F.col("__f1").isNull(), F.col("__tie"))
        .when((value == F.col("__f0")) & (F.col("__tie") == F.col("__f1")), F.col("__row"))
    )
    share = F.floor((F.col("__key") - F.col("__low")) / (F.col("__high") - F.col("__low")) * BUCKETS)
    bucket = F.when(F.col("__high") > F.col("__low"), F.least(share, F.lit(BUCKETS - 1))).otherwise(0)
    sums = (
        placed.join(F.broadcast(ranges), "__box")
        .withColumn("__value", _on_axis(names))
        .withColumn("__key", key)
        .where(F.col("__key").between(F.col("__low"), F.col("__high")))
        .groupBy("__box", bucket.alias("__bucket"))
        .agg(F.sum("__weight").alias("w"), F.min("__key").alias("low"), F.max("__key").alias("high"))
        .collect()
    )
    found: dict[int, list] = {}
    for r in sums:
        found.setdefault(r["__box"], []).append(r)
    still: dict[int, _Search] = {}
    for first, s in searches.items():
        before, rows = s.before, sorted(found[first], key=lambda r: r["__bucket"])
        for r in rows:
            if before + r["w"] >= s.target or r is rows[-1]:
                break
            before += r["w"]
        over, under = before + r["w"] - s.target, s.target - before
        one_value = r["low"] == r["high"]
        one_row = one_value and len(s.fixed) == 2
        if under <= tolerance or (one_row and under <= over):
            s.box.cut = (*s.fixed, r["low"])
        elif over <= tolerance or one_row:
            s.box.cut = (*s.fixed, math.nextafter(r["high"], math.inf))
        elif one_value:
            still[first] = _Search(s.box, s.target, 0.0, 2.0**53, (*s.fixed, r["low"]), before)
        else:
            still[first] = _Search(s.box, s.target, r["low"], r["high"], s.fixed, before)
    return still


def _slots(sharded: DataFrame) -> DataFrame:
    """Number the rows of a shard in blocks; a block's first number is the count of the blocks before it."""
    blocks = max(64, partitions(sharded.sparkSession))
    split = sharded.withColumn("__block", F.pmod(F.col("__row").cast("long"), F.lit(blocks)))
    inside = Window.partitionBy("shard", "__block").orderBy("__row")
    sizes = split.groupBy("shard", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = split.withColumn("__at", F.row_number().over(inside))
    slot = (F.col("__start") + F.col("__at") - 1).cast("long")
    return numbered.join(starts, ["shard", "__block"]).withColumn("slot", slot).drop("__block", "__at", "__start")
