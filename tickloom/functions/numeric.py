"""Rounding and parsing with the engine's rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves towards plus infinity; SQL's round() takes them away from zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def number(text: Column) -> Column:
    """A double, where an empty or blank text is 0 and anything unreadable null."""
    return F.when(F.trim(text) == "", F.lit(0.0)).otherwise(text.try_cast("double"))


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def positive(x: Column) -> Column:
    """x where it is finite and above zero, else null."""
    return F.when(finite(x) & (x > 0), x)
