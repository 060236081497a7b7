"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telmora.functions import labels as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# A small shift keeps exact halves of the last digit, where both sides may round differently, apart.
SHIFT = 1.23e-7


def shifted(vector: DataFrame) -> DataFrame:
    return vector.withColumn("value", F.col("value") + SHIFT)


def rounded(value: Column, digits: int = 6) -> Column:
    """Values for comparison with SQL, where sums run in another order. -0 becomes 0."""
    return F.round(value, digits) + F.lit(0.0)


def show(vector: DataFrame, labels: Sequence[str], *extra: Column | str, digits: int = 6) -> DataFrame:
    """Labels as columns, evaluation time and rounded value."""
    return vector.select(
        *[L.label("labels_fp", k).alias(k) for k in labels], "t_ms", *extra, rounded(F.col("value"), digits).alias("value")
    )
