"""IEEE-754 arithmetic and comparison for sample values.

Spark's ANSI mode raises on division by zero, treats NaN as equal to NaN and larger than every
number, and lets NaN win in ``max``. Sample values need plain IEEE behaviour, so every operator
on them goes through these expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def div(left, right) -> Column:
    left, right = _col(left), _col(right)
    # pow(±0, -1) is ±Infinity, so the product carries the sign and yields NaN for 0/0.
    return F.when(right == 0, left * F.pow(right, F.lit(-1.0))).otherwise(left / right)


def mod(left, right) -> Column:
    left, right = _col(left), _col(right)
    return F.when(right == 0, F.lit(NAN)).otherwise(left % right)


ARITHMETIC = {
    "+": lambda a, b: _col(a) + _col(b),
    "-": lambda a, b: _col(a) - _col(b),
    "*": lambda a, b: _col(a) * _col(b),
    "/": div,
    "%": mod,
    "^": lambda a, b: F.pow(_col(a), _col(b)),
}


def _ordered(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b)


def compare(op: str, left, right) -> Column:
    """Boolean comparison; false whenever a side is NaN, except ``!=`` which is then true."""
    a, b = _col(left), _col(right)
    if op == "==":
        return (a == b) & _ordered(a, b)
    if op == "!=":
        return (a != b) | ~_ordered(a, b)
    if op == ">":
        return (a > b) & _ordered(a, b)
    if op == "<":
        return (a < b) & _ordered(a, b)
    if op == ">=":
        return (a >= b) & _ordered(a, b)
    if op == "<=":
        return (a <= b) & _ordered(a, b)
    raise ValueError(f"unknown comparison {op!r}")


COMPARISONS = ("==", "!=", ">", "<", ">=", "<=")


def max_skip_nan(value: Column) -> Column:
    """Aggregate: NaN is ignored; -Infinity when nothing else is there."""
    return F.coalesce(F.max(F.when(~F.isnan(value), value)), F.lit(-INF))


def min_skip_nan(value: Column) -> Column:
    return F.coalesce(F.min(F.when(~F.isnan(value), value)), F.lit(INF))


def ascending(value: Column) -> list[Column]:
    """Sort keys of an ascending value sort: NaN first."""
    return [F.isnan(value).desc(), value.asc()]


def descending(value: Column) -> list[Column]:
    """Sort keys of a descending value sort: NaN last."""
    return [F.isnan(value).asc(), value.desc()]


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < INF)


def _finite_only(value: Column, result: Column) -> Column:
    return F.when(is_finite(value), result.cast("double")).otherwise(value)


def ceil(value: Column) -> Column:
    # rint-based forms keep values beyond the bigint range exact
    r = F.rint(value)
    return _finite_only(value, F.when(r < value, r + 1.0).otherwise(r))


def floor(value: Column) -> Column:
    r = F.rint(value)
    return _finite_only(value, F.when(r > value, r - 1.0).otherwise(r))


def round_half_away(value: Column, to=1.0) -> Column:
    """Nearest multiple of ``to``; halves go away from zero; ``to = 0`` returns the value."""
    if not isinstance(to, Column) and to == 0:
        return value
    scaled = div(value, to)
    whole = F.signum(scaled) * floor(F.abs(scaled))
    up = F.abs(scaled) - F.abs(whole) >= 0.5
    rounded = F.when(is_finite(scaled), F.when(up, whole + F.signum(scaled)).otherwise(whole)).otherwise(scaled)
    result = rounded * _col(to)
    return F.when(_col(to) == 0, value).otherwise(result) if isinstance(to, Column) else result


def _log(value: Column, fn) -> Column:
    return (
        F.when(F.isnan(value), F.lit(NAN))
        .when(value > 0, fn(value))
        .when(value == 0, F.lit(-INF))
        .otherwise(F.lit(NAN))
    )


def ln(value: Column) -> Column:
    return _log(value, F.ln)


def log2(value: Column) -> Column:
    return _log(value, F.log2)


def log10(value: Column) -> Column:
    return _log(value, F.log10)


def sgn(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(0.0)).when(value > 0, 1.0).when(value < 0, -1.0).otherwise(0.0)


def at_least(value: Column, bound) -> Column:
    b = _col(bound)
    return F.when(F.isnan(value) | F.isnan(b), F.lit(NAN)).otherwise(F.greatest(value, b))


def at_most(value: Column, bound) -> Column:
    b = _col(bound)
    return F.when(F.isnan(value) | F.isnan(b), F.lit(NAN)).otherwise(F.least(value, b))


def to_radians(value: Column) -> Column:
    return value * F.lit(math.pi) / F.lit(180.0)


def to_degrees(value: Column) -> Column:
    return value * F.lit(180.0) / F.lit(math.pi)
