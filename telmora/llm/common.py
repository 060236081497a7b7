"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telmora.runtime import checkpointed

__all__ = ["ascii_lower", "checkpointed", "fresh", "hinted", "partitions", "row_key", "small_table"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows of a narrow table (under 100 bytes each) up to which it may be broadcast: about 20 MB.
BROADCAST_ROWS = 200_000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Only A-Z change; ``lower`` would also fold letters outside ASCII."""
    return F.translate(text, _UPPER, _UPPER.lower())


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a narrow table of a known number of rows if that is small; else Spark shuffles it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def row_key() -> Column:
    """Rows with the same id but another text are different documents."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def fresh(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without columns whose names an operator adds itself."""
    return df.drop(*columns)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few int and double rows that lives in the plan itself."""
    kinds = [c.split() for c in schema.split(", ")]

    def literal(x: float | None, kind: str) -> str:
        return f"cast({'null' if x is None else repr(x) + 'D' * (kind == 'double')} as {kind})"

    values = ", ".join("(" + ", ".join(literal(x, k) for x, (_, k) in zip(r, kinds)) + ")" for r in rows)
    return spark.sql(f"select * from values {values} as t({', '.join(name for name, _ in kinds)})")
