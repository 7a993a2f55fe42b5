"""Climate features from daily readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepanel.catalog.registry import READINGS, query, readings, rounded
from sitepanel.catalog.rows import _PLACES, _places
from sitepanel.functions import calendar
from sitepanel.operators import climate

_MONTHS = dict(enumerate(calendar.MONTH_NAMES, start=1))


def _pieces(spark: SparkSession, folder: str, *variables: str) -> DataFrame:
    return climate.month_pieces(readings(spark, folder), ["site"], variables)


_ALL_KNOWN = "CASE WHEN count({0}) = count(*) THEN {1}({0}) END"

_MAXIMA_SQL = ", ".join(
    f"max(CASE WHEN month = {m} THEN tmax END) AS {name}_max" for m, name in _MONTHS.items()
)


@query(f"""WITH {READINGS}
SELECT site, year, {_MAXIMA_SQL} FROM readings GROUP BY site, year
HAVING count(CASE WHEN month = 1 THEN 1 END) > 0""")
def monthly_max(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve monthly maxima per site and year, from one aggregate."""
    return climate.monthly_maxima(_pieces(spark, folder, "tmax"), ["site"], "tmax")


@query(f"""WITH {READINGS} SELECT site, year, month, min(tmin) AS tmin FROM readings GROUP BY site, year, month""")
def monthly_min(spark: SparkSession, folder: str) -> DataFrame:
    return climate.monthly_minima(_pieces(spark, folder, "tmin"), ["site"], "tmin")


@query(f"""WITH {READINGS}
SELECT site, year, month, {_ALL_KNOWN.format('pr', 'sum')} AS pr FROM readings GROUP BY site, year, month""")
def monthly_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly rain; a month with a missing reading has no total."""
    return climate.monthly_totals(_pieces(spark, folder, "pr"), ["site"], "pr")


@query(f"""WITH {READINGS}
SELECT site, year, month, max(tmax) AS tmax, min(tmin) AS tmin,
       round(CASE WHEN count(pr) = count(*) THEN sum(pr) / count(*) / 10 END, 9) AS mean_pr,
       round(avg(srad), 9) AS mean_srad, round(avg(swe), 9) AS mean_swe, round(avg(soil), 9) AS mean_soil
FROM readings GROUP BY site, year, month""")
def monthly_summary(spark: SparkSession, folder: str) -> DataFrame:
    pieces = _pieces(spark, folder, "tmax", "tmin", "pr", "srad", "swe", "soil")
    table = climate.monthly_summary(pieces, ["site"], scales={"pr": 10.0})
    return rounded(table, "mean_pr", "mean_srad", "mean_swe", "mean_soil", digits=9)


# Season pieces written out by hand, so that the oracle shares nothing with the label functions.
_SEASON_DAYS = {
    "spring": ["month = 3 AND day >= 21", "month = 4", "month = 5", "month = 6 AND day <= 20"],
    "summer": ["month = 6 AND day >= 21", "month = 7", "month = 8", "month = 9 AND day <= 20"],
    "autumn": ["month = 9 AND day >= 21", "month = 10", "month = 11", "month = 12 AND day <= 20"],
    "winter": ["month = 12 AND day >= 21", "month = 1", "month = 2", "month = 3 AND day <= 20"],
}


def _season_sql(name: str) -> str:
    pieces = _SEASON_DAYS[name]
    inside = " OR ".join(f"({p})" for p in pieces)
    whole = " AND ".join(f"count(CASE WHEN {p} THEN 1 END) > 0" for p in pieces)
    return (
        f"CASE WHEN {whole} AND count(CASE WHEN {inside} THEN pr END) = count(CASE WHEN {inside} THEN 1 END) "
        f"THEN sum(CASE WHEN {inside} THEN pr END) END AS {name}_pr"
    )


_SEASONS_SQL = ", ".join(_season_sql(s) for s in _SEASON_DAYS)
_ALL_SEASONS = " AND ".join(f"{s}_pr IS NOT NULL" for s in _SEASON_DAYS)
SEASONS = f"seasons AS (SELECT site, year, {_SEASONS_SQL} FROM readings GROUP BY site, year)"


@query(f"""WITH {READINGS}, {SEASONS} SELECT * FROM seasons WHERE {_ALL_SEASONS}""")
def season_precip(spark: SparkSession, folder: str) -> DataFrame:
    """Season totals of whole years; winter joins both ends of a calendar year."""
    return climate.seasonal_totals(_pieces(spark, folder, "pr"), ["site"], "pr")


@query(f"""WITH {READINGS}, moved AS (
  SELECT site, CASE WHEN month = 12 AND day >= 21 THEN year + 1 ELSE year END AS year, month, day, pr FROM readings)
SELECT site, year, {_SEASONS_SQL} FROM moved GROUP BY site, year
HAVING count(CASE WHEN month = 3 AND day >= 21 THEN 1 END) > 0""")
def season_precip_contiguous(spark: SparkSession, folder: str) -> DataFrame:
    """Season totals with late December counted towards the next year, incomplete years kept."""
    return climate.seasonal_totals(
        _pieces(spark, folder, "pr"), ["site"], "pr", winter="contiguous", complete=False
    )


def _winter_sql(year: str) -> str:
    return f"""SELECT site, {year} AS year,
       min(CASE WHEN month = 11 THEN tmin END) AS nov, min(CASE WHEN month = 12 THEN tmin END) AS dec,
       min(CASE WHEN month = 1 THEN tmin END) AS jan, min(CASE WHEN month = 2 THEN tmin END) AS feb
FROM readings WHERE month IN (11, 12, 1, 2) GROUP BY 1, 2 HAVING count(CASE WHEN month = 11 THEN 1 END) > 0"""


_COLDEST = """CASE WHEN nov IS NOT NULL AND dec IS NOT NULL AND jan IS NOT NULL AND feb IS NOT NULL
            THEN least(nov, dec, jan, feb) END AS coldest"""
_SHIFTED = "CASE WHEN month >= 11 THEN year + 1 ELSE year END"
WINTERS = f"winters AS (SELECT *, {_COLDEST} FROM ({_winter_sql(_SHIFTED)}))"


@query(f"""WITH {READINGS}, {WINTERS} SELECT * FROM winters""")
def winter_min(spark: SparkSession, folder: str) -> DataFrame:
    """Coldest night from November to February, November and December counted forward."""
    return climate.winter_minimum(_pieces(spark, folder, "tmin"), ["site"], "tmin")


@query(f"""WITH {READINGS} SELECT *, {_COLDEST} FROM ({_winter_sql('year')})""")
def winter_min_unshifted(spark: SparkSession, folder: str) -> DataFrame:
    return climate.winter_minimum(_pieces(spark, folder, "tmin"), ["site"], "tmin", shift=False)


_WET = "CASE WHEN month > 4 THEN year + 1 ELSE year END"
WATER = f"""water AS (SELECT site, {_WET} AS year,
  CASE WHEN count(pr) = count(*) THEN sum(pr) END AS water_year_pr FROM readings GROUP BY 1, 2)"""


@query(f"""WITH {READINGS}, {WATER} SELECT site, year, water_year_pr / 10 AS water_year_pr FROM water
WHERE year > 1995 AND year < 2002""")
def water_year_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Rain from May to April without the incomplete first and last years."""
    return climate.water_year_total(
        _pieces(spark, folder, "pr"), ["site"], "pr", scale=10.0, min_year=1995, max_year=2002
    )


@query(f"""WITH {READINGS}, {WATER}, {WINTERS}
SELECT a.site, a.year, a.water_year_pr, w.coldest FROM water a
LEFT JOIN winters w ON a.site = w.site AND a.year = w.year""")
def annual_climate(spark: SparkSession, folder: str) -> DataFrame:
    """Water-year rain and coldest night side by side, from one scan and one roll-up."""
    return climate.annual_climate(_pieces(spark, folder, "pr", "tmin"), ["site"], "pr", "tmin")


@query(f"""WITH {READINGS}, {SEASONS}, maxima AS (
  SELECT site, year, {_MAXIMA_SQL} FROM readings GROUP BY site, year
  HAVING count(CASE WHEN month = 1 THEN 1 END) > 0)
SELECT s.*, {", ".join(f"{n}_max" for n in _MONTHS.values())}
FROM (SELECT * FROM seasons WHERE {_ALL_SEASONS}) s LEFT JOIN maxima m ON s.site = m.site AND s.year = m.year""")
def season_and_maxima(spark: SparkSession, folder: str) -> DataFrame:
    """Season totals and monthly maxima, from one scan and one roll-up."""
    return climate.season_and_maxima(_pieces(spark, folder, "pr", "tmax"), ["site"], "pr", "tmax")


@query(f"""WITH {_PLACES}
SELECT site, year, month, sum(pr) AS pr, max(tmax) AS tmax FROM listed JOIN taken USING (lon_key, lat_key)
GROUP BY site, year, month""")
def site_climate_by_coordinate(spark: SparkSession, folder: str) -> DataFrame:
    """Readings reduced per coordinate first, then shared out to the sites there."""
    taken, listed = _places(spark, folder)
    pieces = climate.pieces_by_site(taken, listed, ["pr", "tmax"])
    return pieces.groupBy("site", "year", "month").agg(F.sum("pr_sum").alias("pr"), F.max("tmax_max").alias("tmax"))


@query(f"""WITH {READINGS}
SELECT site, year, month, day,
       CASE WHEN month IN (4, 5) OR (month = 3 AND day >= 21) OR (month = 6 AND day <= 20) THEN 'spring'
            WHEN month IN (7, 8) OR (month = 6 AND day >= 21) OR (month = 9 AND day <= 20) THEN 'summer'
            WHEN month IN (10, 11) OR (month = 9 AND day >= 21) OR (month = 12 AND day <= 20) THEN 'autumn'
            ELSE 'winter' END AS season,
       {_WET} AS water_year, {_SHIFTED} AS winter_year, count(*) AS readings
FROM readings GROUP BY ALL""")
def calendar_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Season, water-year and winter-year label of every observed day."""
    year, month = F.col("year"), F.col("month")
    return (
        readings(spark, folder)
        .groupBy("site", "year", "month", "day")
        .agg(F.count(F.lit(1)).alias("readings"))
        .withColumns(
            {
                "season": calendar.season(month, calendar.late_piece(month, F.col("day"))),
                "water_year": calendar.water_year(year, month),
                "winter_year": calendar.winter_year(year, month),
            }
        )
    )
