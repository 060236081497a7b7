"""Element-wise functions of instant vectors, and functions that touch only labels or times."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telmora.functions import ieee
from telmora.functions import labels as L
from telmora.operators.selectors import Grid

_FUNCTIONS = {
    "abs": F.abs,
    "ceil": ieee.ceil,
    "floor": ieee.floor,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "ln": ieee.ln,
    "log2": ieee.log2,
    "log10": ieee.log10,
    "sgn": ieee.sgn,
    "deg": ieee.to_degrees,
    "rad": ieee.to_radians,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
}
ELEMENTWISE = tuple(_FUNCTIONS)


def apply(name: str, operand: DataFrame | Column | float):
    """``abs ceil floor sqrt exp ln log2 log10 sgn deg rad`` and the trigonometric functions.

    A vector keeps its labels, including the name, and its sample times.
    """
    fn = _FUNCTIONS[name]
    if isinstance(operand, DataFrame):
        return operand.withColumn("value", fn(F.col("value")).cast("double"))
    return fn(operand if isinstance(operand, Column) else F.lit(float(operand))).cast("double")


def round_(operand: DataFrame | Column | float, to: float = 1.0):
    """Nearest multiple of ``to``, halves away from zero. On a scalar ``to`` has no effect."""
    if isinstance(operand, DataFrame):
        return operand.withColumn("value", ieee.round_half_away(F.col("value"), to))
    return ieee.round_half_away(operand if isinstance(operand, Column) else F.lit(float(operand)))


def clamp_min(operand: DataFrame | Column | float, bound: float):
    """Raise values below ``bound``. On a scalar the bound has no effect."""
    if isinstance(operand, DataFrame):
        return operand.withColumn("value", ieee.at_least(F.col("value"), bound))
    return operand


def clamp_max(operand: DataFrame | Column | float, bound: float):
    """Lower values above ``bound``. On a scalar the bound has no effect."""
    if isinstance(operand, DataFrame):
        return operand.withColumn("value", ieee.at_most(F.col("value"), bound))
    return operand


def time_() -> Column:
    """Evaluation time in seconds."""
    return F.col("t_ms") / F.lit(1000.0)


def pi() -> Column:
    return F.pi()


def vector(grid: Grid, spark, value: Column | float) -> DataFrame:
    """One unlabelled sample per step."""
    value = value if isinstance(value, Column) else F.lit(float(value))
    return grid.frame(spark).select(
        F.lit("").alias("labels_fp"), "t_ms", F.col("t_ms").alias("sample_ts_ms"), value.alias("value")
    )


def scalar(vector_: DataFrame, strict: bool = False) -> DataFrame:
    """Steps with exactly one sample, as ``t_ms, value``. Other steps fail to evaluate and leave a gap;
    ``strict`` raises instead."""
    out = vector_.groupBy("t_ms").agg(F.count(F.lit(1)).alias("__n"), F.max("value").alias("value"))
    if strict:
        ok = F.when(F.col("__n") == 1, F.col("value")).otherwise(
            F.raise_error(F.lit("scalar() needs a vector with one sample"))
        )
        return out.select("t_ms", ok.alias("value"))
    return out.where(F.col("__n") == 1).select("t_ms", "value")


def absent(vector_: DataFrame, grid: Grid) -> DataFrame:
    """An unlabelled 1 on each step without any sample."""
    present = vector_.select("t_ms").distinct()
    missing = grid.frame(vector_.sparkSession).join(present, "t_ms", "left_anti")
    return missing.select(
        F.lit("").alias("labels_fp"), "t_ms", F.col("t_ms").alias("sample_ts_ms"), F.lit(1.0).alias("value")
    )


def timestamp(vector_: DataFrame) -> DataFrame:
    """Time of each sample in seconds."""
    return vector_.withColumn("value", F.col("sample_ts_ms") / F.lit(1000.0))


def label_replace(vector_: DataFrame, dst: str, replacement: str, src: str, regex: str) -> DataFrame:
    """Set ``dst`` to ``replacement`` (with ``$N`` groups) where ``regex`` is found in label ``src``.

    The match is unanchored and the first one counts; without a match the labels stay.
    """
    groups = re.compile(regex).groups
    source = F.coalesce(L.label("labels_fp", src), F.lit(""))
    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\$(\d)", replacement)):
        if i % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
        elif int(piece) <= groups:
            parts.append(F.regexp_extract(source, regex, int(piece)))
    value = F.concat(*parts) if parts else F.lit("")
    return vector_.withColumn(
        "labels_fp",
        F.when(source.rlike(regex), L.with_label("labels_fp", dst, value)).otherwise(F.col("labels_fp")),
    )


def label_join(vector_: DataFrame, dst: str, separator: str, *sources: str) -> DataFrame:
    """Set ``dst`` to the values of those ``sources`` that exist, joined by ``separator``."""
    value = F.concat_ws(separator, *[L.label("labels_fp", s) for s in sources])
    return vector_.withColumn("labels_fp", L.with_label("labels_fp", dst, value))


def sort(vector_: DataFrame) -> DataFrame:
    """Ascending by value, NaN first; ties by labels."""
    return vector_.orderBy("t_ms", *ieee.ascending(F.col("value")), "labels_fp")


def sort_desc(vector_: DataFrame) -> DataFrame:
    """Descending by value, NaN last; ties by labels."""
    return vector_.orderBy("t_ms", *ieee.descending(F.col("value")), "labels_fp")
