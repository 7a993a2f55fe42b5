"""Labels that cut a calendar year into survey seasons, water years and winters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Each season starts on the 21st of its edge month.
SEASON_EDGE_MONTHS = (3, 6, 9, 12)
SEASON_FIRST_DAY = 21
SEASONS = ("winter", "spring", "summer", "autumn")
# The water year runs May to April, the winter November to February.
WATER_YEAR_LAST_MONTH = 4
WINTER_MONTHS = {11: "nov", 12: "dec", 1: "jan", 2: "feb"}
MONTH_NAMES = (
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
)


def late_piece(month: Column, day: Column) -> Column:
    """True for the days of an edge month that already belong to the next season."""
    return month.isin(*SEASON_EDGE_MONTHS) & (day >= SEASON_FIRST_DAY)


def season(month: Column, late: Column) -> Column:
    """Season name of a month, or of the late piece of an edge month."""
    position = month + late.cast("int")
    index = F.floor(F.pmod(position - 1, F.lit(12)) / 3).cast("int")
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), index + 1)


def season_year(year: Column, month: Column, late: Column, winter: str = "calendar") -> Column:
    """Year a season piece counts towards.

    ``calendar`` keeps late December in its own year, so a winter total joins
    both ends of one calendar year; ``contiguous`` moves it to the next year.
    """
    if winter == "calendar":
        return year
    if winter == "contiguous":
        return F.when((month == 12) & late, year + 1).otherwise(year)
    raise ValueError(f"unknown winter rule {winter!r}")


def water_year(year: Column, month: Column) -> Column:
    return F.when(month > WATER_YEAR_LAST_MONTH, year + 1).otherwise(year)


def winter_year(year: Column, month: Column, shift: bool = True) -> Column:
    """Year of the winter a month belongs to; ``shift`` moves November and December on."""
    if not shift:
        return year
    return F.when(month >= 11, year + 1).otherwise(year)
