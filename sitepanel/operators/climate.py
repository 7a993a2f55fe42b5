"""Seasonal, monthly, winter and water-year features from daily readings.

The daily table is read once: ``month_pieces`` reduces it to at most 16 rows
per key and year (twelve months, edge months split at the season day).  Every
feature is then a second, panel-sized aggregate over those pieces, which works
because sums, extremes and counts can be added up from parts.  The first
aggregate combines inside the map tasks, so a site holding a third of all
readings still ships only its pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitepanel.functions import calendar
from sitepanel.functions.nulls import row_min


def month_pieces(readings: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Partial statistics per key, year, month and piece of the month.

    ``readings`` has year, month and day columns.  For each variable the result
    has ``_n`` (known values), ``_sum``, ``_min`` and ``_max``; ``rows`` counts
    all readings, so a missing value can still be noticed later.  Statistics
    that no feature uses are pruned by the optimizer.
    """
    late = calendar.late_piece(F.col("month"), F.col("day"))
    stats = [F.count(F.lit(1)).alias("rows")]
    for v in variables:
        stats += [
            F.count(v).alias(f"{v}_n"),
            F.sum(v).alias(f"{v}_sum"),
            F.min(v).alias(f"{v}_min"),
            F.max(v).alias(f"{v}_max"),
        ]
    return readings.groupBy(*keys, "year", "month", late.alias("late")).agg(*stats)


def pieces_by_site(
    readings: DataFrame, sites: DataFrame, variables: Sequence[str], keep: str = "matched"
) -> DataFrame:
    """Month pieces per site from readings keyed by coordinate.

    The readings are reduced per coordinate before the join, so sites that share
    a coordinate multiply pieces and not daily rows, and the join has at most 16
    rows per coordinate and year on either side.  ``keep`` adds sites without
    readings ("sites") or readings without a site ("readings").
    """
    how = {"matched": "inner", "sites": "left", "readings": "right"}[keep]
    by_place = month_pieces(readings, ["lon_key", "lat_key"], variables)
    places = sites.select("site", "lon_key", "lat_key")
    return places.join(by_place, ["lon_key", "lat_key"], how).drop("lon_key", "lat_key")


def _rolled(stat, variable: str, suffix: str, where: Column | None = None) -> Column:
    """Roll pieces up to one figure that is NULL if any reading inside was NULL."""
    known, rows = F.col(f"{variable}_n"), F.col("rows")
    value = F.col(f"{variable}_{suffix}")
    if where is not None:
        known, rows, value = (F.when(where, c) for c in (known, rows, value))
    return F.when(F.sum(known) == F.sum(rows), stat(value))


def monthly_totals(pieces: DataFrame, keys: Sequence[str], variable: str) -> DataFrame:
    return pieces.groupBy(*keys, "year", "month").agg(_rolled(F.sum, variable, "sum").alias(variable))


def monthly_minima(pieces: DataFrame, keys: Sequence[str], variable: str) -> DataFrame:
    return pieces.groupBy(*keys, "year", "month").agg(_rolled(F.min, variable, "min").alias(variable))


def monthly_summary(
    pieces: DataFrame,
    keys: Sequence[str],
    maxima: Sequence[str] = ("tmax",),
    minima: Sequence[str] = ("tmin",),
    means: Sequence[str] = ("pr", "srad", "swe", "soil"),
    scales: dict[str, float] | None = None,
) -> DataFrame:
    """Maximum, minimum and mean of the daily values of each month.

    ``scales`` divides a mean, for example by ten to turn millimetres into
    centimetres.
    """
    scales = scales or {}
    stats = [_rolled(F.max, v, "max").alias(v) for v in maxima]
    stats += [_rolled(F.min, v, "min").alias(v) for v in minima]
    for v in means:
        mean = F.try_divide(_rolled(F.sum, v, "sum"), F.sum("rows"))
        if v in scales:
            mean = mean / F.lit(scales[v])
        stats.append(mean.alias(f"mean_{v}"))
    return pieces.groupBy(*keys, "year", "month").agg(*stats)


def monthly_maxima(
    pieces: DataFrame, keys: Sequence[str], variable: str, require_first: bool = True
) -> DataFrame:
    """Twelve monthly maxima side by side.

    ``require_first`` drops years without January; later missing months are NULL.
    """
    stats = [
        _rolled(F.max, variable, "max", F.col("month") == m).alias(f"{name}_max")
        for m, name in enumerate(calendar.MONTH_NAMES, start=1)
    ]
    first = F.count(F.when(F.col("month") == 1, F.lit(1)))
    table = pieces.groupBy(*keys, "year").agg(*stats, first.alias("_first"))
    if require_first:
        table = table.where(F.col("_first") > 0)
    return table.drop("_first")


def seasonal_totals(
    pieces: DataFrame,
    keys: Sequence[str],
    variable: str,
    winter: str = "calendar",
    complete: bool = True,
) -> DataFrame:
    """Total per season, one column each.

    Every season is made of four pieces.  A total exists only when all four are
    there and none holds a missing reading; ``complete`` keeps only the years
    with all four totals, otherwise only years without a spring start are left
    out.
    """
    month, late = F.col("month"), F.col("late")
    label = calendar.season(month, late)
    labelled = pieces.withColumn("_season", label).withColumn(
        "_year", calendar.season_year(F.col("year"), month, late, winter)
    )
    stats = []
    for name in calendar.SEASONS:
        inside = F.col("_season") == name
        whole = F.count(F.when(inside, F.lit(1))) == 4
        stats.append(F.when(whole, _rolled(F.sum, variable, "sum", inside)).alias(f"{name}_{variable}"))
    spring_start = F.count(F.when((month == 3) & late, F.lit(1)))
    table = labelled.groupBy(*keys, F.col("_year").alias("year")).agg(
        *stats, spring_start.alias("_first")
    )
    table = table.where(F.col("_first") > 0).drop("_first")
    return table.dropna(how="any") if complete else table


def winter_minimum(
    pieces: DataFrame,
    keys: Sequence[str],
    variable: str,
    shift: bool = True,
    require_first: bool = True,
) -> DataFrame:
    """Monthly minima of November to February and the coldest of the four.

    The coldest night is known only when all four months are.
    """
    month = F.col("month")
    stats = [
        _rolled(F.min, variable, "min", month == m).alias(name)
        for m, name in calendar.WINTER_MONTHS.items()
    ]
    first = F.count(F.when(month == 11, F.lit(1)))
    table = (
        pieces.where(month.isin(*calendar.WINTER_MONTHS))
        .withColumn("_year", calendar.winter_year(F.col("year"), month, shift))
        .groupBy(*keys, F.col("_year").alias("year"))
        .agg(*stats, first.alias("_first"))
    )
    if require_first:
        table = table.where(F.col("_first") > 0)
    names = list(calendar.WINTER_MONTHS.values())
    return table.drop("_first").withColumn("coldest", row_min([F.col(n) for n in names]))


def water_year_total(
    pieces: DataFrame,
    keys: Sequence[str],
    variable: str,
    scale: float = 1.0,
    min_year: int | None = None,
    max_year: int | None = None,
) -> DataFrame:
    """Total from May to April, divided by ``scale``.

    ``min_year`` and ``max_year`` are exclusive cut-offs for incomplete years.
    """
    total = _rolled(F.sum, variable, "sum")
    table = (
        pieces.withColumn("_year", calendar.water_year(F.col("year"), F.col("month")))
        .groupBy(*keys, F.col("_year").alias("year"))
        .agg((total / F.lit(scale) if scale != 1.0 else total).alias(f"water_year_{variable}"))
    )
    if min_year is not None:
        table = table.where(F.col("year") > min_year)
    if max_year is not None:
        table = table.where(F.col("year") < max_year)
    return table


def annual_climate(
    pieces: DataFrame,
    keys: Sequence[str],
    rain: str,
    cold: str,
    shift: bool = True,
    scale: float = 1.0,
    min_year: int | None = None,
    max_year: int | None = None,
) -> DataFrame:
    """Water-year total and coldest winter night per key and year, from one aggregate.

    The two features count a month towards different years.  Each piece is sent
    to the one or two years it belongs to, so the pieces are neither computed
    nor shuffled twice as they would be by joining the two separate features.
    Years without a water-year total are left out, as are years outside the
    exclusive cut-offs.
    """
    year, month = F.col("year"), F.col("month")
    wet, winter = calendar.water_year(year, month), calendar.winter_year(year, month, shift)
    sent = pieces.withColumns({"_wet": wet, "_winter": winter}).withColumn(
        "_label", F.explode(F.array_distinct(F.array("_wet", "_winter")))
    )
    in_wet = F.col("_label") == F.col("_wet")
    in_winter = F.col("_label") == F.col("_winter")
    total = _rolled(F.sum, rain, "sum", in_wet)
    stats = [
        F.count(F.when(in_wet, F.lit(1))).alias("_pieces"),
        (total / F.lit(scale) if scale != 1.0 else total).alias(f"water_year_{rain}"),
        F.count(F.when(in_winter & (month == 11), F.lit(1))).alias("_first"),
    ]
    stats += [
        _rolled(F.min, cold, "min", in_winter & (month == m)).alias(name)
        for m, name in calendar.WINTER_MONTHS.items()
    ]
    table = sent.groupBy(*keys, F.col("_label").alias("year")).agg(*stats).where(F.col("_pieces") > 0)
    names = list(calendar.WINTER_MONTHS.values())
    coldest = F.when(F.col("_first") > 0, row_min([F.col(n) for n in names]))
    if min_year is not None:
        table = table.where(F.col("year") > min_year)
    if max_year is not None:
        table = table.where(F.col("year") < max_year)
    return table.select(*keys, "year", f"water_year_{rain}", coldest.alias("coldest"))


def season_and_maxima(
    pieces: DataFrame, keys: Sequence[str], rain: str, warm: str
) -> DataFrame:
    """Four season totals and twelve monthly maxima per key and calendar year, from one aggregate.

    Both features share their key, so they share the shuffle.  Only years with
    all four totals are kept; a year without January has no maxima.
    """
    month, late = F.col("month"), F.col("late")
    label = calendar.season(month, late)
    stats = []
    for name in calendar.SEASONS:
        inside = label == name
        whole = F.count(F.when(inside, F.lit(1))) == 4
        stats.append(F.when(whole, _rolled(F.sum, rain, "sum", inside)).alias(f"{name}_{rain}"))
    january = F.count(F.when(month == 1, F.lit(1))) > 0
    stats += [
        F.when(january, _rolled(F.max, warm, "max", month == m)).alias(f"{name}_max")
        for m, name in enumerate(calendar.MONTH_NAMES, start=1)
    ]
    totals = [f"{name}_{rain}" for name in calendar.SEASONS]
    return pieces.groupBy(*keys, "year").agg(*stats).dropna(how="any", subset=totals)
