"""Exact division of long values such as nanosecond times, which doubles cannot hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(value: Column, divisor: int) -> Column:
    """Integer quotient, truncated toward zero."""
    return F.call_function("div", value, F.lit(divisor))


def floor_div(value: Column, divisor: int) -> Column:
    """Integer quotient, rounded down."""
    return int_div(value - F.pmod(value, F.lit(divisor)), divisor)
