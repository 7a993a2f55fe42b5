"""Query registration and the bindings from test tables to readings, surveys and sites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepanel.sources.tables import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name, with its oracle SQL."""

    def register(function):
        name = function.__name__
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round computed columns: the two engines may sum in another order."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


def _known_rain() -> Column:
    """Rain with gaps: some gauge failures, so that missing-value rules matter."""
    broken = (F.col("l_linenumber") == 7) & (F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1)
    return F.when(~broken, F.col("l_quantity"))


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Daily weather by site, from line items by supplier."""
    day = F.col("l_shipdate")
    return read_parquet(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("site"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("day"),
        _known_rain().alias("pr"),
        (F.col("l_extendedprice") / 1000).alias("tmax"),
        (F.col("l_discount") * 1000 - F.col("l_extendedprice") / 1000).alias("tmin"),
        F.col("l_tax").alias("srad"),
        F.col("l_discount").alias("swe"),
        (F.col("l_tax") * F.col("l_quantity")).alias("soil"),
    )


READINGS = """readings AS (
  SELECT l_suppkey AS site, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(month(l_shipdate) AS INTEGER) AS month, CAST(day(l_shipdate) AS INTEGER) AS day,
         CASE WHEN NOT (l_linenumber = 7 AND l_tax = 0.08 AND l_discount = 0.1) THEN l_quantity END AS pr,
         l_extendedprice / 1000 AS tmax, l_discount * 1000 - l_extendedprice / 1000 AS tmin,
         l_tax AS srad, l_discount AS swe, l_tax * l_quantity AS soil
  FROM lineitem)"""


def site_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Gap-free panel: one row per supplier and year."""
    return (
        readings(spark, folder)
        .groupBy("site", "year")
        .agg(F.min("tmax").alias("stems"), F.max("soil").alias("grass"), F.min("tmin").alias("coldest"))
    )


SITE_PANEL = f"""{READINGS},
site_panel AS (
  SELECT site, year, min(tmax) AS stems, max(soil) AS grass, min(tmin) AS coldest
  FROM readings GROUP BY site, year)"""


def gappy_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Panel with missing years: one row per customer and year with an order."""
    return (
        read_parquet(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("year"))
        .agg(
            (F.max("o_totalprice") / 1000).alias("stems"),
            (F.min("o_totalprice") / 1000).alias("grass"),
            F.count(F.lit(1)).cast("double").alias("insects"),
            F.max(F.dayofyear("o_orderdate")).cast("double").alias("rain"),
        )
    )


GAPPY_PANEL = """gappy_panel AS (
  SELECT o_custkey AS site, CAST(year(o_orderdate) AS INTEGER) AS year,
         max(o_totalprice) / 1000 AS stems, min(o_totalprice) / 1000 AS grass,
         CAST(count(*) AS DOUBLE) AS insects, CAST(max(dayofyear(o_orderdate)) AS DOUBLE) AS rain
  FROM orders GROUP BY 1, 2)"""


def surveys(spark: SparkSession, folder: str) -> DataFrame:
    """Plot surveys by site and year, several per year, from line items by supplier."""
    return read_parquet(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("site"),
        F.year("l_shipdate").alias("year"),
        F.col("l_quantity").alias("target_weed"),
        (F.col("l_discount") * 100 + F.col("l_extendedprice") / 10000).alias("other_weed"),
        (F.col("l_tax") * 100 + F.col("l_quantity") / 10).alias("forbs"),
        (F.col("l_extendedprice") / 2000 + F.col("l_discount") * 50).alias("grass"),
        (F.col("l_linenumber") + F.col("l_extendedprice") / 50000).alias("bare_ground"),
        (F.col("l_discount") * 200 + F.col("l_linenumber") / 2).alias("moss"),
        (F.col("l_extendedprice") / 1000).alias("stems"),
        (F.col("l_quantity") + F.col("l_linenumber")).alias("insects"),
    )


SURVEYS = """surveys AS (
  SELECT l_suppkey AS site, CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS target_weed,
         l_discount * 100 + l_extendedprice / 10000 AS other_weed, l_tax * 100 + l_quantity / 10 AS forbs,
         l_extendedprice / 2000 + l_discount * 50 AS grass, l_linenumber + l_extendedprice / 50000 AS bare_ground,
         l_discount * 200 + l_linenumber / 2 AS moss,
         l_extendedprice / 1000 AS stems,
         l_quantity + l_linenumber AS insects
  FROM lineitem)"""

MEASURES = ["target_weed", "other_weed", "forbs", "grass", "bare_ground", "stems", "insects"]


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """Site metadata, from suppliers."""
    return read_parquet(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("site"), F.col("s_name").alias("site_name"), F.col("s_nationkey").alias("county")
    )
