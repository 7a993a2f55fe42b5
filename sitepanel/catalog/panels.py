"""Reshaping, lags, growth and whole analysis frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepanel.catalog.climate import SEASONS, WATER, WINTERS, _ALL_SEASONS, _MAXIMA_SQL, _MONTHS
from sitepanel.catalog.registry import (
    GAPPY_PANEL,
    MEASURES,
    READINGS,
    SITE_PANEL,
    SURVEYS,
    gappy_panel,
    query,
    readings,
    rounded,
    site_panel,
    sites,
    surveys,
)
from sitepanel.functions import scalars
from sitepanel.operators import panel, reshape
from sitepanel.plans.growth import growth_panel as growth_plan
from sitepanel.plans.interactions import interaction_frame as interaction_plan
from sitepanel.plans.rules import GROWN, PanelRules
from sitepanel.plans.seasons import season_cover_frame as season_plan
from sitepanel.plans.seasons import with_cover_growth
from sitepanel.sources.tables import read_parquet


@query(f"""WITH {SITE_PANEL}
SELECT site, year, 'stems' AS variable, stems AS value FROM site_panel
UNION ALL SELECT site, year, 'grass', grass FROM site_panel
UNION ALL SELECT site, year, 'coldest', coldest FROM site_panel""")
def melt(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.melt(site_panel(spark, folder), ["site", "year"], ["stems", "grass", "coldest"])


def _long(spark: SparkSession, folder: str) -> DataFrame:
    """Survey values by priority class: a class without a survey in a year has no rows."""
    rows = read_parquet(spark, folder, "orders").select(
        F.col("o_custkey").alias("site"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderstatus").alias("variable"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.floor("o_totalprice").cast("double")).alias("value"),
    )
    return rows


def _cast_sql(stat: str) -> str:
    cells = ", ".join(
        f"""CASE WHEN count(CASE WHEN variable = '{v}' THEN value END) = count(CASE WHEN variable = '{v}' THEN 1 END)
             THEN {stat}(CASE WHEN variable = '{v}' THEN value END) END AS "{v}" """
        for v in ("F", "O", "P")
    )
    return f"""WITH long AS (
  SELECT o_custkey AS site, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS variable,
         CASE WHEN o_orderpriority <> '5-LOW' THEN floor(o_totalprice) END AS value FROM orders)
SELECT site, year, {cells} FROM long GROUP BY site, year"""


@query(_cast_sql("min"))
def cast_min(spark: SparkSession, folder: str) -> DataFrame:
    """Long to wide by minimum; a cell with a missing value or no rows is NULL."""
    return reshape.cast_wide(_long(spark, folder), ["site", "year"], ["F", "O", "P"], "min")


@query(_cast_sql("sum"))
def cast_sum(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.cast_wide(_long(spark, folder), ["site", "year"], ["F", "O", "P"], "sum")


@query(f"""WITH {SURVEYS}
SELECT site, year, min(target_weed) AS target_weed, min(grass) AS grass, min(stems) AS stems
FROM surveys GROUP BY site, year""")
def collapse_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """One row per site and year without a long form in between."""
    return reshape.collapse(surveys(spark, folder), ["site", "year"], ["target_weed", "grass", "stems"], "min")


_GRID = """grid AS (SELECT site, year FROM (SELECT DISTINCT site FROM gappy_panel),
                              (SELECT DISTINCT year FROM gappy_panel)),
completed AS (SELECT g.site, g.year, p.stems, p.grass, p.insects, p.rain
              FROM grid g LEFT JOIN gappy_panel p ON g.site = p.site AND g.year = p.year)"""


@query(f"""WITH {GAPPY_PANEL}, {_GRID} SELECT * FROM completed""")
def complete_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every site with every observed year, NULL where it was not surveyed."""
    frame = gappy_panel(spark, folder)
    return reshape.complete_years(frame, "site", "year", reshape.observed_years(frame))


@query("""WITH panel AS (SELECT o_custkey AS site, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(year(o_orderdate) AS INTEGER) END AS year,
                      o_orderkey AS survey FROM orders),
empty AS (SELECT site, CAST(y AS INTEGER) AS year FROM (SELECT DISTINCT site FROM panel), range(1997, 2000) t(y)
          EXCEPT SELECT site, year FROM panel)
SELECT site, year, survey FROM panel UNION ALL SELECT site, year, NULL FROM empty""")
def complete_grid_outside(spark: SparkSession, folder: str) -> DataFrame:
    """Completion to fewer years than the surveys have, with several surveys a year and some without a year."""
    orders = read_parquet(spark, folder, "orders")
    year = F.when(F.col("o_orderpriority") != "5-LOW", F.year("o_orderdate"))
    frame = orders.select(F.col("o_custkey").alias("site"), year.alias("year"), F.col("o_orderkey").alias("survey"))
    return reshape.complete_years(frame, "site", "year", [1997, 1998, 1999])


@query("""SELECT site, CAST(year AS INTEGER) AS year FROM (SELECT DISTINCT o_custkey AS site FROM orders),
                 (SELECT unnest(generate_series(1996, 2003)) AS year)""")
def site_year_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every site with every year of a fixed range."""
    orders = read_parquet(spark, folder, "orders").select(F.col("o_custkey").alias("site"))
    return reshape.year_grid(orders, "site", 1996, 2003)


def _lag_sql(table: str) -> str:
    return f"""SELECT site, year, round(ln(stems + 1), 6) AS ln_stems,
  round(lag(ln(stems + 1), 1) OVER w, 6) AS ln_stems_lag1, round(lag(ln(stems + 1), 2) OVER w, 6) AS ln_stems_lag2,
  round(ln(stems + 1) - lag(ln(stems + 1)) OVER w, 6) AS growth_ln_stems,
  lag(rain, 1) OVER w AS rain_lag1, lag(rain, 2) OVER w AS rain_lag2
FROM {table} WINDOW w AS (PARTITION BY site ORDER BY year)"""


_LAGS = {"logs": {"stems": "ln_stems"}, "raw": {"rain": "rain"}, "growth": ["ln_stems"], "depth": 2}
_LAG_COLUMNS = ["ln_stems", "ln_stems_lag1", "ln_stems_lag2", "growth_ln_stems"]


@query(f"""WITH {GAPPY_PANEL} {_lag_sql('gappy_panel')}""")
def observed_lag(spark: SparkSession, folder: str) -> DataFrame:
    """Lags over the surveyed years of a site, whatever lies between."""
    lagged = panel.with_lags(gappy_panel(spark, folder), "site", "year", **_LAGS)
    return rounded(lagged.drop("stems", "grass", "insects", "rain"), *_LAG_COLUMNS)


@query(f"""WITH {GAPPY_PANEL}, {_GRID} {_lag_sql('completed')}""")
def complete_grid_lag(spark: SparkSession, folder: str) -> DataFrame:
    """Lags over the completed grid: a missing year breaks the chain."""
    frame = gappy_panel(spark, folder)
    lagged = panel.calendar_lags(frame, "site", "year", reshape.observed_years(frame), **_LAGS)
    return rounded(lagged.drop("stems", "grass", "insects", "rain"), *_LAG_COLUMNS)


@query(f"""WITH {GAPPY_PANEL}, {_GRID}, counted AS (
  SELECT *, count(stems) OVER (PARTITION BY site) AS seen FROM completed)
SELECT site, year, stems FROM counted WHERE seen >= 5""")
def well_monitored_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Completed rows of sites with five survey years, counted without another shuffle."""
    frame = gappy_panel(spark, folder).select("site", "year", "stems")
    grid = reshape.complete_years(frame, "site", "year", reshape.observed_years(frame))
    return panel.keep_well_monitored(grid, "site", 5, F.col("stems").isNotNull())


@query(f"""WITH {SITE_PANEL}
SELECT site, year, round(ln(stems + 1), 6) AS ln_stems,
       round(lag(ln(stems + 1)) OVER w, 6) AS ln_stems_lag1,
       round(ln(stems + 1) - lag(ln(stems + 1)) OVER w, 6) AS growth_ln_stems
FROM site_panel WINDOW w AS (PARTITION BY site ORDER BY year)""")
def log_growth(spark: SparkSession, folder: str) -> DataFrame:
    frame = site_panel(spark, folder).select("site", "year", "stems")
    lagged = panel.with_lags(frame, "site", "year", logs={"stems": "ln_stems"}, growth=["ln_stems"])
    return rounded(lagged.drop("stems"), "ln_stems", "ln_stems_lag1", "growth_ln_stems")


@query(f"""WITH {SITE_PANEL}, changed AS (
  SELECT site, year, (stems + 1 - (lag(stems) OVER w + 1)) / (lag(stems) OVER w + 1) * 100 AS stems_change
  FROM site_panel WINDOW w AS (PARTITION BY site ORDER BY year))
SELECT site, year, round(stems_change, 6) AS stems_change FROM changed""")
def pct_growth(spark: SparkSession, folder: str) -> DataFrame:
    frame = site_panel(spark, folder).select("site", "year", "stems")
    changed = panel.with_lags(frame, "site", "year", percent={"stems": "stems_change"})
    return rounded(changed.drop("stems"), "stems_change")


@query(f"""WITH {SITE_PANEL}
SELECT site, year, round(CASE WHEN coldest + 92 > 0 THEN ln(coldest + 92) END, 6) AS ln_shifted,
       round(CASE WHEN coldest + 1 > 0 THEN ln(coldest + 1) END, 6) AS ln_plain, abs(coldest) AS size
FROM site_panel""")
def shifted_log(spark: SparkSession, folder: str) -> DataFrame:
    """Shifted logs of a column with values below the shift, which become NULL."""
    cold = F.col("coldest")
    frame = site_panel(spark, folder).select(
        "site",
        "year",
        scalars.shifted_log(cold, 92).alias("ln_shifted"),
        scalars.shifted_log(cold).alias("ln_plain"),
        F.abs(cold).alias("size"),
    )
    return rounded(frame, "ln_shifted", "ln_plain")


# ---------------------------------------------------------------------------
# Whole frames

_COLLAPSED = "collapsed AS (SELECT site, year, " + ", ".join(
    f"min({m}) AS {m}" for m in MEASURES
) + " FROM surveys GROUP BY site, year)"


def _growth_columns(lags: int, digits: int | None) -> str:
    def shown(text: str) -> str:
        return text if digits is None else f"round({text}, {digits})"

    parts = []
    for m in MEASURES:
        parts.append(f"{shown(f'ln({m} + 1)')} AS ln_{m}")
        parts += [f"{shown(f'lag(ln({m} + 1), {k}) OVER w')} AS ln_{m}_lag{k}" for k in range(1, lags + 1)]
        parts.append(f"{shown(f'ln({m} + 1) - lag(ln({m} + 1)) OVER w')} AS growth_ln_{m}")
    for column, name in (("water_year_pr", "rain"), ("coldest", "coldest")):
        parts += [f"lag({column}, {k}) OVER w AS {name}_lag{k}" for k in range(1, lags + 1)]
    return ", ".join(parts)


def _log_columns(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c.startswith(("ln_", "growth_"))]


def growth_ctes(digits: int | None = None) -> str:
    """SQL of the growth panel as ``growth_frame``."""
    return f"""{READINGS}, {WATER}, {WINTERS}, {SURVEYS}, {_COLLAPSED},
features AS (
  SELECT a.site, a.year, a.water_year_pr, w.coldest FROM water a JOIN winters w ON a.site = w.site AND a.year = w.year
  WHERE a.water_year_pr IS NOT NULL AND w.coldest IS NOT NULL),
joined AS (SELECT c.*, f.water_year_pr, f.coldest FROM collapsed c LEFT JOIN features f
           ON c.site = f.site AND c.year = f.year),
grid AS (SELECT s.site, y.year FROM (SELECT DISTINCT site FROM joined) s, (SELECT DISTINCT year FROM joined) y),
completed AS (SELECT g.site, g.year, {", ".join(MEASURES)}, water_year_pr, coldest
              FROM grid g LEFT JOIN joined j ON g.site = j.site AND g.year = j.year),
lagged AS (SELECT *, {_growth_columns(1, digits)} FROM completed WINDOW w AS (PARTITION BY site ORDER BY year)),
kept AS (SELECT site FROM collapsed GROUP BY site HAVING count(*) >= 5),
growth_frame AS (SELECT l.*, s.s_name AS site_name, s.s_nationkey AS county
  FROM lagged l LEFT JOIN supplier s ON l.site = s.s_suppkey WHERE l.site IN (SELECT site FROM kept))"""


def growth_rows(spark: SparkSession, folder: str) -> DataFrame:
    return growth_plan(readings(spark, folder), surveys(spark, folder), sites(spark, folder), MEASURES)


@query(f"WITH {growth_ctes(6)} SELECT * FROM growth_frame")
def growth_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Daily weather and surveys to the lagged panel of well-monitored sites."""
    frame = growth_rows(spark, folder)
    return rounded(frame, *_log_columns(frame))


def season_ctes(digits: int | None = None) -> str:
    """SQL of the season and cover rows as ``season_frame``."""
    total = "target_weed + other_weed + forbs + grass + bare_ground"
    total = total if digits is None else f"round({total}, {digits})"
    return f"""{READINGS}, {SEASONS}, {SURVEYS}, maxima AS (
  SELECT site, year, {_MAXIMA_SQL} FROM readings GROUP BY site, year
  HAVING count(CASE WHEN month = 1 THEN 1 END) > 0),
spans AS (SELECT site, min(year) AS first_year, max(year) AS last_year FROM surveys GROUP BY site),
season_frame AS (
  SELECT v.*, {total} AS total_cover,
         s.winter_pr, s.spring_pr, s.summer_pr, s.autumn_pr, {", ".join(f"{n}_max" for n in _MONTHS.values())}
  FROM surveys v JOIN (SELECT * FROM seasons WHERE {_ALL_SEASONS}) s ON v.site = s.site AND v.year = s.year
  LEFT JOIN maxima m ON v.site = m.site AND v.year = m.year
  WHERE v.site IN (SELECT site FROM spans WHERE last_year - first_year >= 5))"""


def season_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = surveys(spark, folder)
    listed = rows.groupBy("site").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return season_plan(readings(spark, folder), rows, listed)


@query(f"WITH {season_ctes(6)} SELECT * FROM season_frame")
def season_cover_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Survey rows of long-running sites with cover total, season rain and monthly maxima."""
    return rounded(season_rows(spark, folder), "total_cover")


_CHANGED = ", ".join(f"({c} - lag({c}) OVER w) / (lag({c}) OVER w + 1) * 100 AS {c}_change" for c in GROWN)
_SEASON_RAIN = [f"{s}_pr" for s in ("spring", "summer", "autumn", "winter")]
_LOGGED = [*[f"{c}_change" for c in GROWN], *_SEASON_RAIN]


def cover_growth_ctes() -> str:
    """SQL of the cover growth rows, with the shifted logs, as ``grown``."""
    logs = ", ".join(f"CASE WHEN {c} + 92 > 0 THEN ln({c} + 92) END AS ln_{c}" for c in _LOGGED)
    return f"""{READINGS}, {SEASONS}, {SURVEYS}, {_COLLAPSED},
maxima AS (SELECT site, year, {_MAXIMA_SQL} FROM readings GROUP BY site, year
           HAVING count(CASE WHEN month = 1 THEN 1 END) > 0),
joined AS (SELECT c.*, s.winter_pr, s.spring_pr, s.summer_pr, s.autumn_pr, {", ".join(f"{n}_max" for n in _MONTHS.values())}
           FROM collapsed c JOIN (SELECT * FROM seasons WHERE {_ALL_SEASONS}) s ON c.site = s.site AND c.year = s.year
           LEFT JOIN maxima m ON c.site = m.site AND c.year = m.year
           WHERE COLUMNS(c.*) IS NOT NULL),
changed AS (SELECT *, {_CHANGED} FROM joined WINDOW w AS (PARTITION BY site ORDER BY year)),
grown AS (SELECT *, {logs} FROM changed WHERE COLUMNS(*) IS NOT NULL)"""


def cover_growth_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = reshape.collapse(surveys(spark, folder), ["site", "year"], MEASURES, "min")
    listed = rows.groupBy("site").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    frame = season_plan(
        readings(spark, folder), rows.select("site", "year", *MEASURES), listed, rules=PanelRules(min_span=0)
    )
    return with_cover_growth(frame, GROWN)


@query(f"""WITH {cover_growth_ctes()}
SELECT site, year, {", ".join(f"round({c}_change, 5) AS {c}_change, round(ln_{c}_change, 5) AS ln_{c}_change" for c in GROWN)},
       round(ln_spring_pr, 6) AS ln_spring_pr, round(ln_winter_pr, 6) AS ln_winter_pr
FROM grown""")
def cover_growth_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Percent change of each cover class with the shifted logs its models use."""
    changes = [f"{c}_change" for c in GROWN]
    changes += [f"ln_{c}" for c in changes]
    picked = cover_growth_rows(spark, folder).select("site", "year", *changes, "ln_spring_pr", "ln_winter_pr")
    return rounded(rounded(picked, *changes, digits=5), "ln_spring_pr", "ln_winter_pr")


_INTERACTION_EXCLUDED = ["3", "7"]


def interaction_ctes(digits: int | None = None) -> str:
    """SQL of the monthly interaction rows as ``interaction_frame``."""
    mean_pr = "CASE WHEN count(pr) = count(*) THEN sum(pr) / count(*) / 10 END"
    means = {f"mean_{v}": f"avg({v})" for v in ("srad", "swe", "soil")}
    if digits is not None:
        mean_pr, means = f"round({mean_pr}, 9)", {name: f"round({mean}, 9)" for name, mean in means.items()}
    means = ", ".join(f"{mean} AS {name}" for name, mean in means.items())
    return f"""{READINGS}, {WATER}, {WINTERS}, {SURVEYS}, {_COLLAPSED},
joined AS (SELECT c.*, a.water_year_pr / 10 AS water_year_pr, w.coldest FROM collapsed c
           LEFT JOIN water a ON c.site = a.site AND c.year = a.year
           LEFT JOIN winters w ON c.site = w.site AND c.year = w.year),
kept AS (SELECT * FROM joined WHERE site IN (SELECT site FROM collapsed GROUP BY site HAVING count(*) >= 5)),
lagged AS (SELECT *, {_growth_columns(2, digits)} FROM kept WINDOW w AS (PARTITION BY site ORDER BY year)),
released AS (SELECT o_custkey AS site, CAST(min(year(o_orderdate)) AS INTEGER) AS release_year FROM orders GROUP BY 1),
monthly AS (SELECT site, year, month, max(tmax) AS tmax, min(tmin) AS tmin, {mean_pr} AS mean_pr, {means}
            FROM readings GROUP BY site, year, month),
fanned AS (
  SELECT l.*, s.s_name AS site_name, s.s_nationkey AS county, r.release_year, m.month, m.tmax, m.tmin, m.mean_pr,
         m.mean_srad, m.mean_swe, m.mean_soil, CAST(l.year - r.release_year AS DOUBLE) AS years_after_release
  FROM lagged l JOIN supplier s ON l.site = s.s_suppkey JOIN released r ON l.site = r.site
  JOIN monthly m ON l.site = m.site AND l.year = m.year
  WHERE l.site NOT IN (3, 7)),
interaction_frame AS (SELECT * FROM fanned WHERE COLUMNS(*) IS NOT NULL)"""


def interaction_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_parquet(spark, folder, "orders")
    releases = orders.select(F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("release_year"))
    return interaction_plan(
        readings(spark, folder),
        surveys(spark, folder),
        sites(spark, folder),
        releases,
        MEASURES,
        PanelRules(lag_mode="observed", rain_scale=10.0, excluded_sites=_INTERACTION_EXCLUDED),
        means=("srad", "swe", "soil"),
    )


@query(f"WITH {interaction_ctes(6)} SELECT * FROM interaction_frame")
def interaction_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly rows of well-monitored sites with lags, metadata and years since release."""
    frame = interaction_rows(spark, folder)
    return rounded(rounded(frame, *_log_columns(frame)), "mean_pr", "mean_srad", "mean_swe", "mean_soil", digits=9)
