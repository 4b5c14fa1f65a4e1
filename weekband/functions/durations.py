"""Durations between two timestamps, in minutes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_DAY = 720


def minutes_between(start: Column, end: Column) -> Column:
    """Fractional minutes from `start` to `end`, the same in every session time zone; NULL if
    either is NULL."""
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return seconds.cast("double") / F.lit(60.0)


def repair_half_day(minutes: Column) -> Column:
    """Add twelve hours, once, to a negative duration."""
    return F.when(minutes < 0, minutes + F.lit(HALF_DAY)).otherwise(minutes)


def sign_class(minutes: Column) -> Column:
    """`negative` or `non-negative`; NULL stays NULL and belongs to neither."""
    return F.when(minutes < 0, "negative").when(minutes >= 0, "non-negative")


def clamp_at_zero(value: Column) -> Column:
    """Zero in place of negative values; NULL stays NULL."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def round_half_even(value: Column, digits: int) -> Column:
    """Round with ties to the even digit."""
    return F.bround(value, digits)


def pseudo_log(value: Column) -> Column:
    """Signed logarithm that is linear around zero: asinh(x / 2)."""
    return F.asinh(value / F.lit(2.0))
