"""Interaction analysis: winter-shifted panel with monthly climate and interaction models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitepanel.operators import climate, mixed, moments, panel, reshape, selection
from sitepanel.operators.joins import drop_members
from sitepanel.plans.growth import panel_features
from sitepanel.plans.rules import PanelRules
from sitepanel.session import durable


def interaction_frame(
    readings: DataFrame,
    surveys: DataFrame,
    sites: DataFrame,
    releases: DataFrame,
    measures: Sequence[str],
    rules: PanelRules = PanelRules(lag_mode="observed", rain_scale=10.0),
    rain: str = "pr",
    cold: str = "tmin",
    warm: str = "tmax",
    means: Sequence[str] = ("srad",),
) -> DataFrame:
    """Complete monthly rows of well-monitored sites with lags, site columns and years since release.

    The monthly summary fans each site and year out to twelve rows, as the
    models want it.  Two features need the month pieces, so those are written
    once and the daily readings are scanned once.
    """
    variables = list(dict.fromkeys([rain, cold, warm, *means]))
    pieces = durable(climate.month_pieces(readings, ["site"], variables))
    annual = climate.annual_climate(
        pieces, ["site"], rain, cold, rules.winter_shift, rules.rain_scale, rules.min_year, rules.max_year
    )
    monthly = climate.monthly_summary(
        pieces, ["site"], [warm], [cold], [rain, *means], {rain: rules.rain_scale}
    )
    observed = reshape.collapse(surveys, ["site", "year"], measures, rules.collapse)
    joined = observed.join(annual, ["site", "year"], "left")
    featured = panel_features(
        joined.withColumn("surveyed", F.lit(1)), sites, measures, f"water_year_{rain}", None, rules, 2
    )
    kept = drop_members(featured, "site", rules.excluded_sites) if rules.excluded_sites else featured
    released = kept.join(panel.earliest_release(releases, "site", "release_year"), ["site"], "left")
    fanned = released.join(monthly, ["site", "year"], "left").dropna(how="any")
    return panel.years_after(fanned, "year", "release_year")


# Terms of the interaction models.
RESPONSE = "growth_ln_stems"
SHORT_TERMS = (
    "ln_stems_lag1", "ln_insects_lag1", "ln_grass_lag1", "ln_bare_ground_lag1", "water_year_pr",
    "water_year_pr*ln_grass_lag1", "water_year_pr*ln_insects_lag1",
)
COLD_TERMS = (*SHORT_TERMS, "coldest")
INSECT_TERMS = ("ln_insects_lag1*rain_lag1",)
WIDE_TERMS = (
    "ln_insects_lag1", "ln_grass_lag1", "ln_other_weed_lag1", "ln_bare_ground_lag1", "rain_lag1",
    "coldest_lag1", "water_year_pr*coldest", "water_year_pr*ln_stems_lag1",
    "coldest*ln_stems_lag1", "coldest*ln_insects_lag1",
)
PLANT_TERMS = ("ln_insects_lag1", "rain_lag1", "coldest_lag1")
AVERAGED_WITHIN = 2.0


def interaction_models(
    frame: DataFrame, formula: Sequence[str] = WIDE_TERMS, reml: bool = False, delta: float = AVERAGED_WITHIN
) -> dict[str, DataFrame]:
    """Fit, variance components, selection, averaging and effect lines of one interaction model."""
    terms = moments.expand_terms(formula)
    # read for the moments and for the ranges of the effect lines
    complete = durable(moments.model_frame(frame, [RESPONSE], terms, keep=["site"]))
    table = moments.site_moments(complete, "site", [*terms, RESPONSE])
    fit = mixed.fit_on_moments(table, RESPONSE, terms, reml)
    chosen = selection.model_selection(table, RESPONSE, terms, reml)
    mains = [t for t in fit.terms if ":" not in t]
    ranges = complete.agg(*[f(F.col(t)) for t in mains for f in (F.min, F.max)]).first()
    lines = {
        f"effect_{t}": fit.effect_line(t, ranges[2 * i], ranges[2 * i + 1])
        for i, t in enumerate(mains)
    }
    return {
        "variances": fit.variances(),
        "coefficients": fit.coefficients(),
        "anova": fit.anova(),
        "selection": chosen,
        "average": selection.model_average(chosen, delta),
        **lines,
    }
