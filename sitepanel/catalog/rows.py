"""Scans, projections, filters, joins: queries on rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepanel.catalog.registry import GAPPY_PANEL, READINGS, gappy_panel, query, readings, rounded
from sitepanel.functions import nulls, scalars
from sitepanel.operators import joins, panel, reshape
from sitepanel.operators.joins import lookup_join
from sitepanel.session import durable, scratch_path
from sitepanel.sources import schemas, tables


@query("""SELECT l_suppkey AS site, l_quantity AS rain, l_extendedprice * (1 - l_discount) AS net
          FROM lineitem""")
def scan_project(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read_parquet(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("site"),
        F.col("l_quantity").alias("rain"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
    )


@query("""SELECT s_name AS site, 'S' || s_suppkey AS site_code, CAST(NULL AS VARCHAR) AS county,
                 s_acctbal / 100 AS site_lon, s_acctbal / 200 AS site_lat,
                 CASE WHEN s_acctbal > 0 THEN s_acctbal END AS elevation
          FROM supplier""")
def scan_csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Write a site list with awkward headers, read it back under declared names."""
    listed = tables.read_parquet(spark, folder, "supplier").select(
        F.col("s_name").alias("SITE NAME"),
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("Site Code"),
        F.lit("").alias("County"),
        (F.col("s_acctbal") / 100).alias("Lon."),
        (F.col("s_acctbal") / 200).alias("Lat."),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).otherwise(F.lit(float("nan"))).alias("elev"),
    )
    path = scratch_path(spark, "sites-csv")
    tables.write_csv(listed, path)
    return tables.read_csv(spark, path, schemas.PLAIN_SITES)


@query("""SELECT c_name AS site, TRY_CAST(c_mktsegment AS INTEGER) AS release_year,
                 c_acctbal AS balance FROM customer""")
def scan_csv_by_header(spark: SparkSession, folder: str) -> DataFrame:
    """Columns found by header text; one of them holds text where a number is declared."""
    listed = tables.read_parquet(spark, folder, "customer").select(
        F.col("c_nationkey").alias("unused"),
        F.col("c_acctbal").alias("Acct.Bal"),
        F.col("c_mktsegment").alias("ReleaseYear"),
        F.col("c_name").alias("SITE_NAME"),
    )
    path = scratch_path(spark, "releases-csv")
    tables.write_csv(listed, path)
    return tables.read_csv_by_header(
        spark, path, {**schemas.RELEASE_HEADERS, "Acct.Bal": ("balance", "double")}
    )


@query(f"""WITH {GAPPY_PANEL}
SELECT site, stems, insects, year FROM gappy_panel WHERE year > 1996""")
def panel_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Save a panel partitioned by year and read part of it back."""
    path = scratch_path(spark, "panel")
    tables.write_panel(gappy_panel(spark, folder).select("site", "year", "stems", "insects"), path)
    return panel.year_between(tables.read_panel(spark, path), "year", 1996, None)


@query("""SELECT c_custkey AS site, TRY_CAST(substr(c_name, 10) AS DOUBLE) AS code,
                 TRY_CAST(c_mktsegment AS DOUBLE) AS segment
          FROM customer""")
def numeric_coercion(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read_parquet(spark, folder, "customer").select(
        F.col("c_custkey").alias("site"),
        scalars.to_number(F.substring("c_name", 10, 20)).alias("code"),
        scalars.to_number(F.col("c_mktsegment")).alias("segment"),
    )


@query("""SELECT o_orderkey AS survey, CAST(o_orderdate AS DATE) AS day,
                 CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS dom,
                 CAST(NULL AS DATE) AS bad
          FROM orders""")
def date_parse_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Dates written as text with one-digit parts, parsed back; other text gives NULL."""
    text = F.date_format("o_orderdate", "M/d/yyyy")
    day = scalars.parse_day(text)
    return tables.read_parquet(spark, folder, "orders").select(
        F.col("o_orderkey").alias("survey"),
        day.alias("day"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("dom"),
        scalars.parse_day(F.col("o_orderpriority")).alias("bad"),
    )


@query("""SELECT l_returnflag AS flag, max(CASE WHEN l_discount > 0 THEN l_quantity END) AS most,
       count(CASE WHEN l_discount > 0 THEN l_quantity END) AS known FROM lineitem GROUP BY 1""")
def scan_parquet_nan(spark: SparkSession, folder: str) -> DataFrame:
    """A Parquet table with NaN in it: they are missing values once read."""
    gaps = F.when(F.col("l_discount") > 0, F.col("l_quantity")).otherwise(F.lit(float("nan")))
    path = scratch_path(spark, "gaps")
    tables.write_panel(
        tables.read_parquet(spark, folder, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("year"), gaps.alias("x")), path
    )
    back = tables.read_panel(spark, path)
    return back.groupBy(F.col("l_returnflag").alias("flag")).agg(F.max("x").alias("most"), F.count("x").alias("known"))


@query("""SELECT l_returnflag AS flag, year(l_shipdate) AS year, min(l_quantity) AS least, count(*) AS n
       FROM lineitem WHERE l_discount > 0 AND l_quantity >= 30 AND year(l_shipdate) > 1994 GROUP BY ALL""")
def scan_parquet_range(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges on stored numbers, tested in the scan although the column holds NaN."""
    gaps = F.when(F.col("l_discount") > 0, F.col("l_quantity")).otherwise(F.lit(float("nan")))
    path = scratch_path(spark, "ranges")
    tables.write_panel(
        tables.read_parquet(spark, folder, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("year"), gaps.alias("x")), path
    )
    back = tables.read_panel(spark, path, where=[("x", ">=", 30.0), ("year", ">", 1994)])
    return back.groupBy(F.col("l_returnflag").alias("flag"), F.col("year").cast("long").alias("year")).agg(F.min("x").alias("least"), F.count("x").alias("n"))


_REPLICATES = """replicates AS (
  SELECT l_orderkey AS survey,
         max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS q1,
         max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS q2,
         max(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS q3,
         max(CASE WHEN l_linenumber = 4 THEN l_quantity END) AS q4,
         max(CASE WHEN l_linenumber = 5 THEN l_quantity END) AS q5,
         max(CASE WHEN l_linenumber = 6 THEN l_quantity END) AS q6,
         max(CASE WHEN l_linenumber = 7 THEN l_quantity END) AS q7
  FROM lineitem GROUP BY l_orderkey)"""


def _replicates(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered replicate columns per survey, some of them missing."""
    return (
        tables.read_parquet(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("survey"))
        .agg(*[F.max(F.when(F.col("l_linenumber") == k, F.col("l_quantity"))).alias(f"q{k}") for k in range(1, 8)])
    )


@query(f"""WITH {_REPLICATES}
SELECT survey, q1 + q2 + q3 + q4 + q5 + q6 + q7 AS total,
       CASE WHEN q1 + q2 + q3 + q4 + q5 + q6 + q7 IS NOT NULL THEN least(q1, q2, q3, q4, q5, q6, q7) END AS smallest
FROM replicates""")
def row_sum_min(spark: SparkSession, folder: str) -> DataFrame:
    cells = [F.col(f"q{k}") for k in range(1, 8)]
    return _replicates(spark, folder).select(
        "survey", nulls.row_sum(cells).alias("total"), nulls.row_min(cells).alias("smallest")
    )


@query(f"""WITH {_REPLICATES}
SELECT survey, round(list_avg([q1, q2, q3, q4, q5, q6, q7]), 6) AS cover
FROM replicates""")
def replicate_means(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the known replicates, found by name prefix and numeric type."""
    named = _replicates(spark, folder).withColumn("q_note", F.lit("text"))
    return rounded(panel.replicate_means(named, ["survey"], {"cover": "q"}), "cover")


@query("""SELECT l_orderkey AS survey, l_linenumber AS plot,
       round(l_quantity + l_discount * 100 + l_tax * 100 + l_linenumber + l_extendedprice / 2000, 6) AS five,
       round(l_quantity + l_discount * 100 + l_tax * 100 + l_linenumber + l_extendedprice / 2000
             + l_quantity / 10 + l_extendedprice / 10000, 6) AS seven
       FROM lineitem""")
def cover_total(spark: SparkSession, folder: str) -> DataFrame:
    """Cover totals over five classes, and over seven with the ground layer."""
    lines = tables.read_parquet(spark, folder, "lineitem")
    five = [
        F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100,
        F.col("l_linenumber").cast("double"), F.col("l_extendedprice") / 2000,
    ]
    ground = [F.col("l_quantity") / 10, F.col("l_extendedprice") / 10000]
    return rounded(
        lines.select(
            F.col("l_orderkey").alias("survey"),
            F.col("l_linenumber").alias("plot"),
            nulls.row_sum(five).alias("five"),
            nulls.row_sum(five + ground).alias("seven"),
        ),
        "five", "seven",
    )


_SPANS = """spans AS (
  SELECT o_custkey AS site, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year,
         CAST(max(year(o_orderdate)) AS INTEGER) AS last_year
  FROM orders GROUP BY o_custkey)"""


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return (
        tables.read_parquet(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("site"))
        .agg(F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year"))
    )


@query(f"""WITH {_SPANS} SELECT * FROM spans WHERE last_year - first_year >= 5""")
def span_filter(spark: SparkSession, folder: str) -> DataFrame:
    return panel.keep_long_span(_spans(spark, folder), "first_year", "last_year", 5)


@query(f"""WITH {READINGS}
SELECT site, year, month, day, pr FROM readings WHERE year > 1996 AND year < 2000""")
def year_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    rows = readings(spark, folder).select("site", "year", "month", "day", "pr")
    return panel.year_between(rows, "year", 1996, 2000)


@query(f"""WITH {READINGS}
SELECT site, year, sum(CASE WHEN month = 3 AND day BETWEEN 21 AND 31 THEN soil_c END) / 100.0 AS late_march,
       sum(CASE WHEN month = 4 THEN soil_c END) / 100.0 AS april
FROM (SELECT *, CAST(round(soil * 100) AS BIGINT) AS soil_c FROM readings)
GROUP BY site, year""")
def month_day_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Several month and day predicates inside one aggregate, not one scan each."""
    month, day = F.col("month"), F.col("day")
    hundredths = F.round(F.col("soil") * 100).cast("long")
    return (
        readings(spark, folder)
        .groupBy("site", "year")
        .agg(
            (nulls.na_sum(hundredths, (month == 3) & day.between(21, 31)) / 100.0).alias("late_march"),
            (nulls.na_sum(hundredths, month == 4) / 100.0).alias("april"),
        )
    )


@query(f"""WITH {READINGS}
SELECT site, year, month, day, pr, tmax FROM readings WHERE pr IS NOT NULL""")
def complete_cases(spark: SparkSession, folder: str) -> DataFrame:
    return readings(spark, folder).select("site", "year", "month", "day", "pr", "tmax").dropna(how="any")


@query(f"""WITH {READINGS}
SELECT site, CAST(sum(CASE WHEN pr IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing,
       CAST(sum(CASE WHEN pr IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS known
FROM readings GROUP BY site""")
def missing_counts(spark: SparkSession, folder: str) -> DataFrame:
    present = scalars.presence(F.col("pr"))
    return (
        readings(spark, folder)
        .groupBy("site")
        .agg(F.sum(1 - present).alias("missing"), F.sum(present).alias("known"))
    )


@query("""SELECT c_custkey AS site, c_name AS name, c_mktsegment AS segment FROM customer
          WHERE c_mktsegment NOT IN ('HOUSEHOLD', 'MACHINERY')""")
def exclude_sites(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.read_parquet(spark, folder, "customer").select(
        F.col("c_custkey").alias("site"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    return joins.drop_members(rows, "segment", ["HOUSEHOLD", "MACHINERY"])


@query("""SELECT o_custkey AS site, o_orderkey AS survey, o_totalprice AS stems FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) >= 5)""")
def min_monitored_years(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.read_parquet(spark, folder, "orders").withColumnRenamed("o_custkey", "site")
    years = orders.select("site", F.year("o_orderdate").alias("year"))
    kept = panel.well_monitored(years, "site", "year", 5)
    rows = orders.select("site", F.col("o_orderkey").alias("survey"), F.col("o_totalprice").alias("stems"))
    return joins.keep_members(rows, kept, ["site"])


@query("""SELECT DISTINCT o_custkey AS site, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""")
def distinct_site_years(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.read_parquet(spark, folder, "orders")
    return orders.select(F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("year")).dropDuplicates()


@query("""SELECT o_custkey AS site, count(DISTINCT year(o_orderdate)) AS years_monitored
FROM orders GROUP BY o_custkey""")
def monitored_year_counts(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.read_parquet(spark, folder, "orders")
    rows = orders.select(F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("year"))
    return panel.monitored_years(rows, "site", "year")


@query("""SELECT c_custkey AS site, c_name AS name, release_year
FROM customer LEFT JOIN (SELECT o_custkey, CAST(min(year(o_orderdate)) AS INTEGER) AS release_year
                         FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def earliest_release(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.read_parquet(spark, folder, "orders")
    releases = orders.select(F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("year"))
    named = tables.read_parquet(spark, folder, "customer").select(
        F.col("c_custkey").alias("site"), F.col("c_name").alias("name")
    )
    return named.join(panel.earliest_release(releases, "site", "year"), ["site"], "left")


@query("""SELECT o_custkey AS site, o_orderdate AS day, o_orderkey AS survey, o_totalprice AS stems
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
WHERE k = 1""")
def first_release_row(spark: SparkSession, folder: str) -> DataFrame:
    """The whole earliest row per site."""
    rows = tables.read_parquet(spark, folder, "orders").select(
        F.col("o_custkey").alias("site"), F.col("o_orderdate").alias("day"),
        F.col("o_orderkey").alias("survey"), F.col("o_totalprice").alias("stems"),
    )
    return panel.first_row(rows, "site", ["day", "survey"])


@query("""SELECT o_orderkey AS survey, CAST(year(o_orderdate) - release_year AS DOUBLE) AS years_after_release
FROM orders JOIN (SELECT o_custkey AS site, min(year(o_orderdate)) AS release_year FROM orders GROUP BY 1)
  ON o_custkey = site""")
def years_after_release(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.read_parquet(spark, folder, "orders").select(
        F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("survey"), F.year("o_orderdate").alias("year")
    )
    released = lookup_join(rows, durable(panel.earliest_release(rows, "site", "year")), ["site"], "inner")
    return panel.years_after(released, "year", "release_year").select("survey", "years_after_release")


@query("""SELECT CAST(max(age) AS DOUBLE) AS oldest, round(avg(age), 6) AS mean_age
FROM (SELECT year(o_orderdate) - min(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS age FROM orders)""")
def release_age_scalars(spark: SparkSession, folder: str) -> DataFrame:
    ages = years_after_release(spark, folder)
    whole = ages.agg(
        F.max("years_after_release").alias("oldest"), F.avg("years_after_release").alias("mean_age")
    )
    return rounded(whole, "mean_age")


@query("""SELECT DISTINCT c_mktsegment AS segment FROM customer""")
def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read_parquet(spark, folder, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()


def _places(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Readings by coordinate and sites in pairs that share one; the doubles differ in the last bits."""
    pair = F.floor(F.col("l_suppkey") / 2)
    taken = tables.read_parquet(spark, folder, "lineitem").select(
        (pair * 0.1 + pair * 0.2 - 117.04).alias("lon"),
        (pair * 0.001 + 42.411).alias("lat"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        F.dayofmonth("l_shipdate").alias("day"),
        F.col("l_quantity").alias("pr"),
        (F.col("l_extendedprice") / 1000).alias("tmax"),
    )
    place = F.floor((F.col("s_suppkey") + 10) / 2)
    listed = tables.read_parquet(spark, folder, "supplier").select(
        F.col("s_name").alias("site"),
        (place * 0.3 - 117.04).alias("site_lon"),
        (place * 0.001 + 42.411).alias("site_lat"),
    )
    return (
        joins.with_coordinate_keys(taken, "lon", "lat"),
        joins.with_coordinate_keys(listed, "site_lon", "site_lat"),
    )


_PLACES = """taken AS (
  SELECT CAST(round(floor(l_suppkey / 2) * 0.3 - 117.04, 3) AS DECIMAL(9,3)) AS lon_key,
         CAST(round(floor(l_suppkey / 2) * 0.001 + 42.411, 3) AS DECIMAL(9,3)) AS lat_key,
         CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
         CAST(day(l_shipdate) AS INTEGER) AS day, l_quantity AS pr, l_extendedprice / 1000 AS tmax
  FROM lineitem),
listed AS (
  SELECT s_name AS site,
         CAST(round(floor((s_suppkey + 10) / 2) * 0.3 - 117.04, 3) AS DECIMAL(9,3)) AS lon_key,
         CAST(round(floor((s_suppkey + 10) / 2) * 0.001 + 42.411, 3) AS DECIMAL(9,3)) AS lat_key
  FROM supplier)"""


@query(f"""WITH {_PLACES}
SELECT site, year, month, day, pr FROM taken LEFT JOIN listed USING (lon_key, lat_key)""")
def coordinate_join_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading, with each site at its coordinate."""
    taken, listed = _places(spark, folder)
    joined = joins.coordinate_join(taken, listed.select("site", "lon_key", "lat_key"), keep="readings")
    return joined.select("site", "year", "month", "day", "pr")


@query(f"""WITH {_PLACES}
SELECT site, year, month, day, pr FROM listed LEFT JOIN taken USING (lon_key, lat_key)""")
def coordinate_join_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Every site, with each reading at its coordinate."""
    taken, listed = _places(spark, folder)
    joined = joins.coordinate_join(taken, listed.select("site", "lon_key", "lat_key"), keep="sites")
    return joined.select("site", "year", "month", "day", "pr")


@query(f"""WITH {_PLACES}
SELECT site, year, month, day, pr, tmax FROM taken JOIN listed USING (lon_key, lat_key)""")
def joined_daily_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The joined daily table written as CSV and read back."""
    taken, listed = _places(spark, folder)
    joined = joins.lookup_join(taken, listed.select("site", "lon_key", "lat_key"), ["lon_key", "lat_key"], "inner")
    columns = ["site", "year", "month", "day", "pr", "tmax"]
    path = scratch_path(spark, "daily-csv")
    tables.write_csv(joined.select(*columns), path)
    return tables.read_csv(spark, path, joined.select(*columns).schema)


_YEARLY = """yearly AS (SELECT site, year, max(tmax) AS warmest FROM readings GROUP BY site, year),
monthly AS (SELECT site, year, month, min(tmin) AS coldest FROM readings GROUP BY site, year, month)"""


def _yearly(spark: SparkSession, folder: str) -> DataFrame:
    return readings(spark, folder).groupBy("site", "year").agg(F.max("tmax").alias("warmest"))


def _monthly(spark: SparkSession, folder: str) -> DataFrame:
    return readings(spark, folder).groupBy("site", "year", "month").agg(F.min("tmin").alias("coldest"))


@query(f"""WITH {READINGS}, {GAPPY_PANEL}, {_YEARLY}
SELECT g.site, g.year, g.stems, y.warmest FROM gappy_panel g LEFT JOIN yearly y ON g.site = y.site AND g.year = y.year""")
def annual_join(spark: SparkSession, folder: str) -> DataFrame:
    left = gappy_panel(spark, folder).select("site", "year", "stems")
    return left.join(_yearly(spark, folder), ["site", "year"], "left")


@query(f"""WITH {READINGS}, {_YEARLY},
seen AS (SELECT DISTINCT o_custkey AS site, CAST(year(o_orderdate) AS INTEGER) AS year,
                CAST(month(o_orderdate) AS INTEGER) AS month FROM orders)
SELECT s.site, s.year, s.month, m.coldest
FROM seen s LEFT JOIN monthly m ON s.site = m.site AND s.year = m.year AND s.month = m.month""")
def monthly_join(spark: SparkSession, folder: str) -> DataFrame:
    seen = tables.read_parquet(spark, folder, "orders").select(
        F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    ).distinct()
    return seen.join(_monthly(spark, folder), ["site", "year", "month"], "left")


@query(f"""WITH {READINGS}, {_YEARLY}
SELECT y.site, y.year, y.warmest, m.month, m.coldest
FROM yearly y LEFT JOIN monthly m ON y.site = m.site AND y.year = m.year""")
def fanout_join(spark: SparkSession, folder: str) -> DataFrame:
    """Annual rows fanned out to their months: twelve times the rows."""
    return _yearly(spark, folder).join(_monthly(spark, folder), ["site", "year"], "left")


@query("""WITH grid AS (SELECT site, CAST(year AS INTEGER) AS year FROM (SELECT DISTINCT o_custkey AS site FROM orders),
                              (SELECT unnest(generate_series(1996, 2003)) AS year)),
seen AS (SELECT o_custkey AS site, CAST(year(o_orderdate) AS INTEGER) AS year,
                CASE WHEN o_orderpriority <> '5-LOW' THEN 1 ELSE 0 END AS flag
         FROM orders)
SELECT coalesce(g.site, s.site) AS site, coalesce(g.year, s.year) AS year, coalesce(s.flag, 0) AS monitored
FROM grid g FULL JOIN seen s ON g.site = s.site AND g.year = s.year""")
def monitoring_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """0/1 flags on the site by year grid; surveys outside its years stay."""
    surveys = tables.read_parquet(spark, folder, "orders").select(
        F.col("o_custkey").alias("site"),
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("cover"),
    )
    return reshape.monitoring_matrix(surveys, "site", "year", F.col("cover"), 1996, 2003)


@query("""SELECT o_orderkey AS survey, o_custkey AS site, o_totalprice AS stems
          FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey LIMIT 20""")
def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Preview of the first rows in key order."""
    return (
        tables.read_parquet(spark, folder, "orders")
        .orderBy("o_custkey", "o_orderdate", "o_orderkey")
        .limit(20)
        .select(F.col("o_orderkey").alias("survey"), F.col("o_custkey").alias("site"), F.col("o_totalprice").alias("stems"))
    )


@query("""SELECT o_custkey AS site, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS surveys
          FROM orders GROUP BY 1, 2 ORDER BY 1, 2""")
def sorted_panel(spark: SparkSession, folder: str) -> DataFrame:
    return (
        tables.read_parquet(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("year"))
        .agg(F.count(F.lit(1)).alias("surveys"))
        .orderBy("site", "year")
    )
