"""Lags, growth rates and eligibility rules of a site by year panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitepanel.functions.nulls import row_mean
from sitepanel.functions.scalars import percent_change, shifted_log
from sitepanel.operators.reshape import complete_years


def with_lags(
    panel: DataFrame,
    site: str,
    year: str,
    logs: Mapping[str, str] | None = None,
    raw: Mapping[str, str] | None = None,
    growth: Sequence[str] = (),
    percent: Mapping[str, str] | None = None,
    depth: int = 1,
) -> DataFrame:
    """Add lagged and growth columns, all from one window and one sort.

    ``logs`` maps a column to the name of its ln(x+1) form, which gets ``_lag1``
    to ``_lag{depth}`` columns; names in ``growth`` also get a ``growth_`` column,
    the difference to the previous row.  ``raw`` lags a column as it is.
    ``percent`` maps a column to the name of its percent change.  The previous
    row is the previous row of the same site: complete the panel first if a
    missing year should break the chain.
    """
    w = Window.partitionBy(site).orderBy(year)
    logs, raw, percent = dict(logs or {}), dict(raw or {}), dict(percent or {})
    logged = panel.withColumns({name: shifted_log(F.col(c)) for c, name in logs.items()})
    added: list[Column] = []
    for name in logs.values():
        added += [F.lag(name, k).over(w).alias(f"{name}_lag{k}") for k in range(1, depth + 1)]
        if name in growth:
            added.append((F.col(name) - F.lag(name, 1).over(w)).alias(f"growth_{name}"))
    for source, name in raw.items():
        added += [F.lag(source, k).over(w).alias(f"{name}_lag{k}") for k in range(1, depth + 1)]
    for source, name in percent.items():
        added.append(percent_change(F.col(source), F.lag(source, 1).over(w)).alias(name))
    return logged.select("*", *added)


def calendar_lags(
    panel: DataFrame, site: str, year: str, years: Sequence[int], **lags
) -> DataFrame:
    """``with_lags`` over the completed grid: a lag across a missing year is NULL."""
    return with_lags(complete_years(panel, site, year, years), site, year, **lags)


def monitored_years(surveys: DataFrame, site: str, year: str) -> DataFrame:
    """Number of distinct survey years per site."""
    return surveys.groupBy(site).agg(F.countDistinct(year).alias("years_monitored"))


def well_monitored(surveys: DataFrame, site: str, year: str, at_least: int = 5) -> DataFrame:
    """Sites with enough distinct survey years."""
    return monitored_years(surveys, site, year).where(F.col("years_monitored") >= at_least)


def keep_well_monitored(
    panel: DataFrame, site: str, at_least: int = 5, seen: Column | None = None
) -> DataFrame:
    """Rows of well-monitored sites, for a panel with one row per site and year.

    Counts over the same site partitioning as the lags, so it adds no shuffle.
    ``seen`` says which rows are surveys when the panel was completed.
    """
    count = F.count(F.when(F.lit(True) if seen is None else seen, F.lit(1)))
    return (
        panel.withColumn("_years", count.over(Window.partitionBy(site)))
        .where(F.col("_years") >= at_least)
        .drop("_years")
    )


def keep_long_span(sites: DataFrame, first: str, last: str, at_least: int = 5) -> DataFrame:
    """Sites whose first and last year lie far enough apart."""
    return sites.where(F.col(last) - F.col(first) >= at_least)


def year_between(df: DataFrame, year: str, after: int | None, before: int | None) -> DataFrame:
    """Exclusive integer cut-offs."""
    if after is not None:
        df = df.where(F.col(year) > after)
    if before is not None:
        df = df.where(F.col(year) < before)
    return df


def earliest_release(releases: DataFrame, site: str, year: str) -> DataFrame:
    """First release year per site; a plain minimum combines inside the map tasks."""
    return releases.groupBy(site).agg(F.min(year).alias("release_year"))


def first_row(df: DataFrame, site: str, order: Sequence[str]) -> DataFrame:
    """First whole row per site by an order that breaks ties.

    ``min_by`` keeps one candidate per task where ``row_number`` would sort a site's rows.
    Rows without a value in the first order column come last.
    """
    others = [c for c in df.columns if c != site]
    rank = F.struct(F.col(order[0]).isNull(), *[F.col(c) for c in order])
    return (
        df.groupBy(site)
        .agg(F.min_by(F.struct(*others), rank).alias("_row"))
        .select(site, "_row.*")
    )


def years_after(df: DataFrame, year: str, release_year: str) -> DataFrame:
    """Survey year minus release year, whatever text or number the release year is."""
    release = F.col(release_year).cast("string").try_cast("double")
    return df.withColumn("years_after_release", F.col(year).cast("double") - release)


_NUMERIC = (T.NumericType,)


def numeric_columns(df: DataFrame, prefix: str) -> list[str]:
    """Numeric columns whose name starts with a prefix."""
    return [
        f.name
        for f in df.schema.fields
        if f.name.startswith(prefix) and isinstance(f.dataType, _NUMERIC)
    ]


def replicate_means(df: DataFrame, ids: Sequence[str], prefixes: Mapping[str, str]) -> DataFrame:
    """Mean of the known replicates of each measure, row by row."""
    return df.select(
        *ids,
        *[
            row_mean([F.col(c).cast("double") for c in numeric_columns(df, prefix)]).alias(name)
            for name, prefix in prefixes.items()
        ],
    )
