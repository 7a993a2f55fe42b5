"""Long and wide forms, and completion of a site by year grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitepanel.functions.nulls import na_max, na_mean, na_min, na_sum

_STATS = {"sum": na_sum, "min": na_min, "max": na_max, "mean": na_mean}


def melt(df: DataFrame, ids: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Wide to long: one row per id and measure."""
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(
        list(ids), list(measures), "variable", "value"
    )


def cast_wide(
    long: DataFrame, keys: Sequence[str], variables: Sequence[str], stat: str, na_rm: bool = False
) -> DataFrame:
    """Long to wide with an aggregate; a combination without rows is NULL."""
    combine = _STATS[stat]
    return (
        long.groupBy(*keys)
        .pivot("variable", list(variables))
        .agg(combine(F.col("value"), na_rm=na_rm))
    )


def collapse(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str], stat: str = "min", na_rm: bool = False
) -> DataFrame:
    """One row per key: the result of ``melt`` and ``cast_wide`` without the long form."""
    combine = _STATS[stat]
    return df.groupBy(*keys).agg(*[combine(F.col(m), na_rm=na_rm).alias(m) for m in measures])


def observed_years(df: DataFrame, year: str = "year") -> list[int]:
    """Years in which any site was seen: a handful of calendar years, like a pivot's values."""
    return [r[0] for r in df.select(year).where(F.col(year).isNotNull()).distinct().orderBy(year).collect()]


def complete_years(
    panel: DataFrame, site: str, year: str, years: Sequence[int]
) -> DataFrame:
    """Add a row of NULLs for each year of ``years`` that a site misses.

    Every row of ``panel`` stays: years outside ``years``, several rows of one
    year, rows without a year (they fill no place of the grid).  Each row emits
    itself and the missing years up to the site's next row, so the grid needs
    one shuffle by site and neither a cross join nor a join back.
    """
    w = Window.partitionBy(site).orderBy(F.col(year).asc_nulls_last())
    grid = F.array(*[F.lit(int(y)).cast(panel.schema[year].dataType) for y in years])
    measures = [c for c in panel.columns if c not in (site, year)]
    own, after = F.col(year), F.col("_after")
    placed = panel.withColumns({"_first": F.row_number().over(w) == 1, "_after": F.lead(year).over(w)})
    missing = F.filter(
        grid,
        lambda y: (F.col("_first") | (y > own)) & (own.isNull() | (y != own)) & (after.isNull() | (y < after)),
    )
    none = F.array().cast(f"array<{panel.schema[year].dataType.simpleString()}>")
    missing = F.when(own.isNotNull() | F.col("_first"), missing).otherwise(none)
    emitted = F.concat(
        F.array(F.struct(own.alias("year"), F.lit(True).alias("own"))),
        F.transform(missing, lambda y: F.struct(y.alias("year"), F.lit(False).alias("own"))),
    )
    rows = placed.select("*", F.explode(emitted).alias("_cell"))
    return rows.select(
        site,
        F.col("_cell.year").alias(year),
        *[F.when(F.col("_cell.own"), F.col(m)).alias(m) for m in measures],
    )


def year_grid(df: DataFrame, site: str, first: int, last: int, year: str = "year") -> DataFrame:
    """Every site with every year of a fixed range."""
    years = F.sequence(F.lit(first), F.lit(last))
    return df.select(site).distinct().select(site, F.explode(years).alias(year))


def monitoring_matrix(
    rows: DataFrame, site: str, year: str, seen: Column, first: int, last: int
) -> DataFrame:
    """0/1 flag for every survey and for every grid cell without one.

    The result is the full join of the site by year grid and the surveys:
    surveys outside the year range stay, a grid cell without a survey gets 0.
    The surveys are only projected; the empty cells follow from the distinct
    survey years of each site, a list as short as the calendar.
    """
    surveys = rows.select(site, year, seen.isNotNull().cast("int").alias("monitored"))
    grid = F.sequence(F.lit(first), F.lit(last))
    empty = (
        rows.select(site, year)
        .distinct()
        .groupBy(site)
        .agg(F.collect_set(year).alias("_years"))
        .select(site, F.explode(F.array_except(grid, F.col("_years"))).alias(year), F.lit(0).alias("monitored"))
    )
    return surveys.unionByName(empty)
