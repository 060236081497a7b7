"""Exact top-k search by inner product: a Voronoi join of queries and data."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telmora.llm.common import checkpointed, partitions

SCALE = 256
#: Queries of one cell, about; with it, the number of pivots follows the number of queries.
CELL_QUERIES = 256
#: Pivots go to all tasks, so there are at most this many.
MAX_PIVOTS = 256
#: Data rows of one local block, about.
BLOCK_ROWS = 65_536


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Neither null nor holding null, NaN or infinite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf))
    return vector.isNotNull() & good


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: doubles where every sum is below 2^53, else wider integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.array(list(vectors), np.int64).reshape(len(vectors), dim)


def _cells(pivots: dict[int, np.ndarray]):
    """The nearest pivot of the same dimension, and distance to it, for each vector."""

    def run(frames):
        for f in frames:
            cell, distance, norm = np.zeros(len(f), np.int32), np.zeros(len(f)), np.zeros(len(f))
            dims = f["v"].map(len).to_numpy()
            for dim in np.unique(dims).tolist():
                here = np.flatnonzero(dims == dim)
                x = _matrix(f["v"].iloc[here], dim).astype(np.float64)
                p = pivots.get(dim, np.zeros((1, dim)))
                squares = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)
                cell[here] = squares.argmin(1)
                distance[here] = np.linalg.norm(x - p[cell[here]], axis=1)
                norm[here] = np.linalg.norm(x, axis=1)
            yield f.assign(dim=dims.astype(np.int32), cell=cell, distance=distance, norm=norm)

    return run


def _local(k: int):
    """The best k of a block of data for each query of a cell."""

    def run(key, queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(data):
            dim = int(key[0])
            x, ids = _matrix(data["v"], dim), data["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            own, rows = queries["id"].to_numpy(), queries["row"].to_numpy()
            for low in range(0, len(own), 128):
                score = _dot(_matrix(queries["v"].iloc[low : low + 128], dim), x)
                for i, s in enumerate(score):
                    other = np.flatnonzero(ids != own[low + i])
                    s_other = s[other]
                    if len(other) > k:
                        edge = np.partition(s_other, len(other) - k)[len(other) - k]
                        other = other[s_other >= edge]
                    best = other[np.argsort(-s[other], kind="stable")][:k]
                    out += [(own[low + i], rows[low + i], int(ids[j]), int(s[j])) for j in best]
        return pd.DataFrame(out, columns=["query_id", "row", "vec_id", "score"])

    return run


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_SCORED = "query_id long, row long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the ``k`` rows of ``vectors`` (id, v:
    array of long) with the highest inner products with each row of ``queries`` (same columns).

    Both sides are put into the cells of pivots drawn from the queries by hash. For a query q with
    pivot p, and x in the data: q.x = p.x + (q - p).x, so q.x <= p.x + r |x| with r the cell's
    greatest distance of a query, and q.x >= p.x - r |x|. The k + 1 highest lower bounds of each
    data cell are its summary; over all cells they give a score that every query of the query cell
    reaches k times without itself. Data whose upper bound stays below it are not sent to that query
    cell; everything else is, dealt over blocks of about ``BLOCK_ROWS``, where the scores are exact.

    A row is never a partner of a query with its own id. Ties go to the smaller id. Vectors of another
    dimension than the query's take no part; an empty vector scores 0. Rows with a null id take part
    in nothing. Repeated rows are partners (and queries) once each; empty tables give no rows.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.where("id is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<long>").alias("v"))
    data, asked = checkpointed(clean(vectors)), checkpointed(clean(queries).withColumn("row", F.monotonically_increasing_id()))
    n_queries, n_data = asked.count(), data.count()
    drawn = asked.orderBy(F.xxhash64("id", "v")).limit(min(MAX_PIVOTS, -(-n_queries // CELL_QUERIES)))
    pivots: dict[int, list] = {}
    for r in drawn.collect():
        pivots.setdefault(len(r["v"]), []).append(r["v"])
    points = {d: np.array(p, np.float64).reshape(len(p), d) for d, p in pivots.items()}
    located = ", dim int, cell int, distance double, norm double"
    asked = checkpointed(asked.mapInPandas(_cells(points), "id long, v array<long>, row long" + located))
    data = checkpointed(data.mapInPandas(_cells(points), "id long, v array<long>" + located))
    radii = {(r["dim"], r["cell"]): r["r"] for r in asked.groupBy("dim", "cell").agg(F.max("distance").alias("r")).collect()}

    def bounds(frames):
        """Lower and upper bound of each data row for each query cell of its dimension."""
        for f in frames:
            for dim, part in f.groupby("dim"):
                cells = sorted(c for d, c in radii if d == dim)
                if not cells:
                    continue
                x = _matrix(part["v"], int(dim)).astype(np.float64)
                middle = x @ points.get(int(dim), np.zeros((1, int(dim))))[cells].T
                for j, c in enumerate(cells):
                    # a little room for rounding
                    reach = radii[dim, c] * part["norm"].to_numpy() * (1 + 1e-9) + 1e-6 * (1 + np.abs(middle[:, j]))
                    yield part.assign(q_cell=np.int32(c), low=middle[:, j] - reach, high=middle[:, j] + reach)

    bounded = data.mapInPandas(bounds, "id long, v array<long>" + located + ", q_cell int, low double, high double")
    slices = max(partitions(spark), -(-n_data // BLOCK_ROWS))
    part = ["dim", "q_cell", "cell", "slice"]
    lows = bounded.select("id", *part[:3], F.pmod(F.xxhash64("id"), F.lit(slices)).alias("slice"), "low")
    # A repeated id counts once, as a query leaves out all rows of its own id.
    lows = lows.repartition(*part).groupBy(*part, "id").agg(F.max("low").alias("low"))
    summary = Window.partitionBy(*part).orderBy(F.desc("low"))
    lows = lows.withColumn("n", F.row_number().over(summary)).where(F.col("n") <= k + 1)
    over = Window.partitionBy("dim", "q_cell").orderBy(F.desc("low"))
    lows = lows.withColumn("n", F.row_number().over(over)).where(F.col("n") == k + 1)
    floors = {(r["dim"], r["q_cell"]): r["low"] for r in lows.select("dim", "q_cell", "low").collect()}
    floor = F.lit(-math.inf)
    for (d, c), low in floors.items():
        floor = F.when((F.col("dim") == d) & (F.col("q_cell") == c), low).otherwise(floor)
    needed = bounded.where(F.col("high") >= floor)
    needed = needed.select("dim", "q_cell", "id", "v", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"))
    copied = asked.select("dim", F.col("cell").alias("q_cell"), "id", "v", "row", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    keys = ["dim", "q_cell", "slice"]
    scored = copied.groupBy(*keys).cogroup(needed.groupBy(*keys)).applyInPandas(_local(k), _SCORED)
    return _best(scored, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
