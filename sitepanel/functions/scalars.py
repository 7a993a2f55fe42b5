"""Row-wise conversions and transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """Text to double; NULL where the text is not a number."""
    return text.try_cast("double")


def parse_day(text: Column, pattern: str = "M/d/yyyy") -> Column:
    """Text to date; NULL where it does not parse.  One-digit days and months are accepted."""
    return F.try_to_date(text, pattern)


def coordinate_key(degrees: Column) -> Column:
    """Exact join key for a coordinate: raw doubles almost never compare equal."""
    return F.round(degrees, 3).cast("decimal(9,3)")


def shifted_log(value: Column, shift: float = 1.0) -> Column:
    """ln(value + shift); NULL where that is not positive."""
    moved = value + F.lit(float(shift))
    return F.when(moved > 0, F.ln(moved))


def percent_change(now: Column, before: Column, shift: float = 1.0) -> Column:
    """Relative change in percent of the shifted values; NULL on a zero denominator."""
    base = before + F.lit(float(shift))
    return F.try_divide(now + F.lit(float(shift)) - base, base) * 100


def presence(value: Column) -> Column:
    return value.isNotNull().cast("int")
