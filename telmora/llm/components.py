"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telmora.llm.common import checkpointed

#: Edges that a task holds at least while stars are hung, unless there are fewer than ``LEAST_TASKS`` such tasks.
EDGES_A_TASK = 20_000
LEAST_TASKS = 4


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (least node reachable) for the nodes of ``edges`` (a long, b long).

    Alternating stars: every node hangs its larger neighbours, then its smaller ones and itself, on
    its least neighbour, until only stars are left; the number of rounds grows with the logarithm of
    the longest chain. Each round's edges are written to the checkpoint folder. Least neighbours are
    partial sums, and the joins are plain equi-joins of written tables, so Spark can split a hub.
    A round has as many tasks as its edges need, not as many as there are shuffle partitions: with few edges each
    task's files and records would take more disk than the edges.
    Self-loops, repeated and null edges do no harm; no edges give no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v and a is not null and b is not null")
    stars = checkpointed(pairs.distinct())
    tasks = _tasks(stars.count())  # rounds have twice as many edges at most
    stars = stars.coalesce(tasks)
    while not _settled(stars, tasks):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = checkpointed(_hang(both, stars, tasks, upward=True))
        stars = checkpointed(_hang(hung, hung, tasks, upward=False))
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select("v").distinct().coalesce(tasks).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(roots)


def _tasks(edges: int) -> int:
    """Tasks for so many edges; more than there are partitions change nothing."""
    return max(LEAST_TASKS, -(-edges // EDGES_A_TASK))


def _hang(neighbours: DataFrame, edges: DataFrame, tasks: int, upward: bool) -> DataFrame:
    """Edges (u > v) from each node's larger (upward) or smaller neighbours to its least one."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    least = checkpointed(least.coalesce(tasks))
    if upward:  # edge (u, v), u > v: u is a larger neighbour of v
        moved = edges.join(least, F.col("v") == F.col("n")).select("u", F.col("m").alias("v"))
    else:
        moved = edges.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    ordered = moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return ordered.coalesce(tasks).distinct().coalesce(tasks)


def _settled(edges: DataFrame, tasks: int) -> bool:
    """Whether distinct edges (u > v) are stars around their least nodes: no node hangs on two others, and none
    on which others hang hangs itself."""
    upper = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    lower = edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    nodes = upper.unionByName(lower).groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.coalesce(tasks).where("hangs + holds > 1").isEmpty()


@dataclass
class Bounds:
    """What tells dissimilar rows apart before they are paired across components: ``of`` gives ``columns`` of
    classes (c), a row for each, and ``maybe`` a condition on them (by endings) and the group's token that every similar
    pair meets in one of its groups at least."""

    columns: list[str]
    of: Callable[[DataFrame], DataFrame]
    maybe: Callable[[str, str, Column], Column]


def linked_within(
    entries: DataFrame,
    links_of: Callable[[DataFrame], DataFrame],
    extra: list[str],
    compatible: Callable[[str, str], Column],
    first_shared: Callable[[str, str], Column] | None = None,
    bounds: Bounds | None = None,
) -> DataFrame:
    """Links (a, b) that connect everything that all pairs within the groups of ``entries`` (token, c,
    weight: long, and ``extra`` columns) would connect, without forming all pairs.

    ``compatible`` tells by the extra columns (whose names get the given endings) which rows can belong
    to similar pairs. ``links_of`` reduces pairs (a < b, extra columns ending in _a, _b; a row for each
    group they share) to the similar ones. ``entries`` should be a written table.

    First the members of each group are paired with its leader, the member of greatest weight: weights
    should be high for texts from which others in their groups were made. Similar ones form
    components. Then, in groups that still hold several components, members outside the group's
    largest component are paired with compatible members of other components: every pair not yet
    connected that shares a group is among these, with a row for each group it shares. Which side comes
    first there depends on the group's leader or largest component, so sides are put in order. Links of the first
    round are returned as its components' stars.

    ``first_shared`` is a stricter condition that every similar pair meets in one of its groups at least. Then
    pairs have ``shared`` besides, the number of groups that a row stands for (1 in the first round), and the second
    round has only pairs that meet the condition somewhere, each once, with all their common groups counted; members
    must come once in a group.

    ``bounds`` is such a condition for the second round alone, on columns that are looked up for its groups only.
    """
    named = lambda df, end: df.select("token", *[F.col(x).alias(x + end) for x in ("c", *extra)])
    leaders = entries.groupBy("token").agg(F.max(F.struct("weight", "c", *extra)).alias("x"), F.count("*").alias("m"))
    leaders = checkpointed(named(leaders.where("m > 1").select("token", "x.*"), "_a"))
    stars = named(entries, "_b").join(leaders, "token").where("c_a <> c_b").where(compatible("_a", "_b"))
    stars = _in_order(stars, extra)
    first = links_of(stars.withColumn("shared", F.lit(1)) if first_shared else stars)

    placed = checkpointed(components(first).withColumnRenamed("node", "c"))
    color = F.coalesce("component", "c").alias("k")
    slim = entries.select("token", "c").join(placed, "c", "left").select("token", color)
    mixed = slim.groupBy("token").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low <> high")
    colored = entries.join(placed, "c", "left").select("token", "c", *extra, color)
    open_ = checkpointed(colored.join(checkpointed(mixed.select("token")), "token", "left_semi"))
    more, condition = extra, first_shared or compatible
    if bounds:
        open_ = checkpointed(open_.join(bounds.of(checkpointed(open_.select("c").distinct())), "c"))
        more, condition = [*extra, *bounds.columns], lambda a, b: (first_shared or compatible)(a, b) & bounds.maybe(a, b, others["token"])
    largest = open_.groupBy("token", "k").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("k", F.struct("m", "k")).alias("main"))
    outside = open_.join(checkpointed(largest), "token").where("k <> main")
    outside = checkpointed(outside.select("token", "main", *[F.col(x).alias(x + "_b") for x in ("c", "k", *more)]))
    others = open_.select("token", *[F.col(x).alias(x + "_a") for x in ("c", "k", *more)])
    other = (F.col("k_a") != F.col("k_b")) & ((F.col("k_a") == F.col("main")) | (F.col("k_a") < F.col("k_b")))
    crossing = others.join(outside, "token").where(other & condition("_a", "_b"))
    crossing = _in_order(crossing, extra)
    second = links_of(_counted(crossing, open_) if first_shared else crossing)
    stars = placed.where("c <> component").select(F.col("c").alias("a"), F.col("component").alias("b"))  # as first connects
    return stars.unionByName(second)


def _counted(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Each of ``pairs`` (a, b, ...) once, with the least of its other columns, and ``shared``, the number of
    groups of ``entries`` (token, c) that hold both."""
    least = [F.min(x).alias(x) for x in pairs.columns if x not in ("a", "b")]
    once = checkpointed(pairs.groupBy("a", "b").agg(*least))
    wanted = checkpointed(once.select(F.explode(F.array("a", "b")).alias("c")).distinct())
    held = checkpointed(entries.join(wanted, "c", "left_semi").groupBy("c").agg(F.collect_set("token").alias("tokens")))
    of = lambda x: held.select(F.col("c").alias(x), F.col("tokens").alias("of_" + x))
    both = F.size(F.array_intersect("of_a", "of_b")).alias("shared")
    return once.join(of("a"), "a").join(of("b"), "b").select(*once.columns, both)


def _in_order(pairs: DataFrame, extra: list[str]) -> DataFrame:
    """Pairs (c, extra columns; endings _a, _b) as a < b with their extra columns."""
    def side(x: str, end: str, other: str) -> Column:
        return F.when(F.col("c_a") < F.col("c_b"), F.col(x + end)).otherwise(F.col(x + other))

    ordered = [(x, "a" if x == "c" else x + "_a", "b" if x == "c" else x + "_b") for x in ["c", *extra]]
    columns = [c for x, a, b in ordered for c in (side(x, "_a", "_b").alias(a), side(x, "_b", "_a").alias(b))]
    return pairs.select(*columns)
