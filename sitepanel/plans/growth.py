"""Growth panel: climate and surveys to lags, log growth and model frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitepanel.operators import climate, missing, mixed, moments, panel, reshape, selection
from sitepanel.plans.rules import PanelRules
from sitepanel.session import durable


def growth_panel(
    readings: DataFrame,
    surveys: DataFrame,
    sites: DataFrame,
    measures: Sequence[str],
    years: Sequence[int] | None = None,
    rain: str = "pr",
    cold: str = "tmin",
    rules: PanelRules = PanelRules(),
    depth: int = 1,
) -> DataFrame:
    """One row per well-monitored site and year with lags, growth and site columns.

    ``years`` are the years of the completed grid, by default those with any survey.

    ``readings`` are daily rows with a ``site``; ``surveys`` have ``site``,
    ``year`` and the measures, several rows per year allowed.  Daily rows and
    survey rows are each aggregated before anything is joined, so both joins
    and the windows see one row per site and year.
    """
    pieces = climate.month_pieces(readings, ["site"], [rain, cold])
    features = climate.annual_climate(
        pieces, ["site"], rain, cold, rules.winter_shift, rules.rain_scale, rules.min_year, rules.max_year
    ).dropna(how="any")
    if years is None and rules.lag_mode == "calendar":
        years = reshape.observed_years(surveys)
    observed = reshape.collapse(surveys, ["site", "year"], measures, rules.collapse)
    joined = observed.join(features, ["site", "year"], "left").withColumn("surveyed", F.lit(1))
    return panel_features(joined, sites, measures, f"water_year_{rain}", years, rules, depth)


def panel_features(
    joined: DataFrame,
    sites: DataFrame,
    measures: Sequence[str],
    rain: str,
    years: Sequence[int] | None,
    rules: PanelRules,
    depth: int = 1,
) -> DataFrame:
    """Lags, growth, the survey-year rule and site columns for one row per site and year.

    Completion, lags and the survey-year count all work per site, so one
    shuffle serves the three.  ``surveyed`` marks rows that stand for a survey;
    ``years`` are only needed for calendar lags.
    """
    logs = {m: f"ln_{m}" for m in measures}
    lags = {"logs": logs, "raw": {rain: "rain", "coldest": "coldest"}, "growth": list(logs.values())}
    if rules.lag_mode == "calendar":
        frame = reshape.complete_years(joined, "site", "year", years)
    elif rules.lag_mode in ("observed", "complete"):
        frame = panel.keep_well_monitored(joined, "site", rules.min_years)
        if rules.lag_mode == "complete":
            frame = frame.dropna(how="any")
    else:
        raise ValueError(f"unknown lag mode {rules.lag_mode!r}")
    frame = panel.with_lags(frame, "site", "year", depth=depth, **lags)
    if rules.lag_mode == "calendar":
        frame = panel.keep_well_monitored(
            frame, "site", rules.min_years, F.col("surveyed").isNotNull()
        )
    return frame.drop("surveyed").join(sites, ["site"], "left")


# Terms of the growth models.
RESPONSE = "growth_ln_stems"
DENSITY_TERMS = ("ln_stems_lag1", "ln_insects_lag1", "rain_lag1")
VEGETATION_TERMS = (
    "ln_stems_lag1", "ln_other_weed_lag1", "ln_grass_lag1", "ln_forbs_lag1", "ln_bare_ground_lag1",
)
# What the density term leaves of the vegetation model's fit is regressed on each of these.
VEGETATION_LEFT_TERMS = ("ln_grass_lag1", "ln_forbs_lag1", "ln_grass")
FULL_TERMS = (
    "ln_stems_lag1", "ln_insects_lag1", "ln_insects", "coldest", "water_year_pr", "rain_lag1",
)
AVERAGED_WITHIN = 7.0
# Models that are fitted on the rows without any missing value in the whole frame.
WHOLE_FRAME = ("vegetation",)


def growth_models(
    frame: DataFrame, catalogue: Mapping[str, Sequence[str]] | None = None, delta: float = AVERAGED_WITHIN
) -> dict[str, DataFrame]:
    """The growth analysis: residual chains, then fit, selection and averaging per model.

    The frame is computed once; each model reduces its own complete cases, or
    those of the whole frame, to site moments and everything else comes from those.
    """
    catalogue = catalogue or {"vegetation": VEGETATION_TERMS, "full": FULL_TERMS}
    frame = durable(frame)
    results = {
        "chain": mixed.residual_chain(
            frame, RESPONSE, DENSITY_TERMS, "site", DENSITY_TERMS[0], DENSITY_TERMS[1:], reml=True
        ),
        "residual_first": mixed.residual_first_chain(frame, RESPONSE, DENSITY_TERMS[:1], "site", DENSITY_TERMS[1:]),
        "complete_cases": missing.rows_kept(
            missing.missing_patterns(frame), {name: moments.factors(f) for name, f in catalogue.items()} | {"whole": frame.columns}
        ),
    }
    if "vegetation" in catalogue:
        results["vegetation_chain"] = mixed.residual_chain(
            frame.dropna(how="any"), RESPONSE, VEGETATION_TERMS, "site", VEGETATION_TERMS[0], VEGETATION_LEFT_TERMS, reml=True
        )
    for name, formula in catalogue.items():
        terms = moments.expand_terms(formula)
        rows = frame.dropna(how="any") if name in WHOLE_FRAME else frame
        complete = moments.model_frame(rows, [RESPONSE], terms, keep=["site"])
        table = moments.site_moments(complete, "site", [*terms, RESPONSE])
        fit = mixed.fit_on_moments(table, RESPONSE, terms, reml=True)
        chosen = selection.model_selection(table, RESPONSE, terms, reml=True)
        results |= {
            f"{name}_coefficients": fit.coefficients(),
            f"{name}_anova": fit.anova(),
            f"{name}_selection": chosen,
            f"{name}_average": selection.model_average(chosen, delta),
        }
    return results
