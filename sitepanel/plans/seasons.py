"""Season and cover analysis: seasonal rain and monthly maxima against plant cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitepanel.functions.nulls import row_sum
from sitepanel.functions.scalars import shifted_log
from sitepanel.operators import climate, linear, mixed, panel
from sitepanel.operators.joins import keep_members, lookup_join
from sitepanel.plans.rules import COVER, PanelRules
from sitepanel.session import durable

# Shift that keeps the log of a percent change defined.
LOG_SHIFT = 92.0


def season_cover_frame(
    readings: DataFrame,
    surveys: DataFrame,
    sites: DataFrame,
    cover: Sequence[str] = COVER,
    rain: str = "pr",
    warm: str = "tmax",
    rules: PanelRules = PanelRules(),
) -> DataFrame:
    """Complete survey rows of long-running sites with total cover, season rain and maxima.

    ``sites`` has ``site``, ``first_year`` and ``last_year``.
    """
    kept = panel.keep_long_span(sites, "first_year", "last_year", rules.min_span)
    rows = keep_members(surveys, kept, ["site"]).withColumn(
        "total_cover", row_sum([F.col(c) for c in cover])
    )
    pieces = climate.month_pieces(readings, ["site"], [rain, warm])
    if rules.winter_season == "calendar":
        features = climate.season_and_maxima(pieces, ["site"], rain, warm)
    else:
        # the two features count December towards different years, so they are joined
        pieces = durable(pieces)
        features = climate.seasonal_totals(pieces, ["site"], rain, rules.winter_season).join(
            climate.monthly_maxima(pieces, ["site"], warm), ["site", "year"], "left"
        )
    # a site and year may hold a large part of the surveys: no plain join with an aggregate
    joined = lookup_join(rows, durable(features), ["site", "year"], "inner")
    return joined.dropna(how="any", subset=rows.columns)


def with_cover_growth(frame: DataFrame, cover: Sequence[str], rain: str = "pr") -> DataFrame:
    """Percent change of each cover class per site, with shifted logs for the models.

    ``frame`` has one row per site and year.  The change is from the previous
    row, whole or not; then rows with any missing value are dropped.
    """
    percent = {c: f"{c}_change" for c in cover}
    changed = panel.with_lags(frame, "site", "year", percent=percent).dropna(how="any")
    logs = {f"ln_{c}": shifted_log(F.col(c), LOG_SHIFT) for c in percent.values()}
    logs |= {
        f"ln_{s}_{rain}": shifted_log(F.col(f"{s}_{rain}"), LOG_SHIFT)
        for s in ("spring", "summer", "autumn", "winter")
    }
    return changed.withColumns(logs)


def cover_growth_models(grown: DataFrame, cover: Sequence[str], rain: str = "pr") -> dict[str, DataFrame]:
    """Mixed models of the growth of every cover class on season rain, plain and as shifted logs.

    ``grown`` comes from ``with_cover_growth``; each form reads it once for all classes.
    """
    seasons = [f"{s}_{rain}" for s in ("spring", "summer", "autumn", "winter")]
    changes = [f"{c}_change" for c in cover]
    grown = durable(grown.select("site", *changes, *seasons, *[f"ln_{c}" for c in [*changes, *seasons]]))
    plain = mixed.fit_mixed_many(grown, changes, seasons, "site", na="fail")
    logged = mixed.fit_mixed_many(grown, [f"ln_{c}" for c in changes], [f"ln_{s}" for s in seasons], "site")
    return {
        "growth_fits": plain.summary(),
        "growth_coefficients": plain.coefficients(),
        "growth_anova": plain.anova(),
        "log_growth_fits": logged.summary(),
        "log_growth_coefficients": logged.coefficients(),
        "log_growth_anova": logged.anova(),
    }


def season_models(
    frame: DataFrame, responses: Sequence[str], rain: str = "pr"
) -> dict[str, DataFrame]:
    """Mixed and linear models of cover on season rain, and linear ones on monthly maxima.

    All responses of a linear model share one pass over the frame.
    """
    seasons = [f"{s}_{rain}" for s in ("spring", "summer", "autumn", "winter")]
    maxima = [c for c in frame.columns if c.endswith("_max")]
    frame = durable(frame.select("site", "total_cover", *responses, *seasons, *maxima))
    whole = mixed.fit_mixed(frame, "total_cover", seasons, "site", reml=False, na="fail")
    by_season = linear.fit_linear(frame, ["total_cover", *responses], seasons)
    by_month = linear.fit_linear(frame, responses, maxima)
    return {
        "cover_mixed": whole.coefficients(),
        "cover_mixed_anova": whole.anova(),
        "season_coefficients": by_season.coefficients(),
        "season_anova": by_season.anova(),
        "month_coefficients": by_month.coefficients(),
        "month_anova": by_month.anova(),
    }
