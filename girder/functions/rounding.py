"""Rounding that does not depend on how a decimal prints: half away from zero on the scaled double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(x: Column, digits: int) -> Column:
    return F.round(x * 10.0**digits) / 10.0**digits


def half_up(x: Column, digits: int) -> Column:
    """Halves go towards positive infinity."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def half_even(x: Column, digits: int = 0) -> Column:
    return F.rint(x * 10.0**digits) / 10.0**digits


def divided(a: Column, b: Column) -> Column:
    """0 where the divisor is not positive."""
    return F.when(b > 0, a / b).otherwise(0.0)
