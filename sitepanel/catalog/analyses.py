"""The model stages of the three analyses, on their own frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepanel.catalog.models import _chain_step, _linear_coefficients, _shown
from sitepanel.catalog.modelsql import fixed_part, linear_ctes, mixed_ctes, names_cte, tree_ctes
from sitepanel.catalog.panels import (
    cover_growth_ctes,
    cover_growth_rows,
    growth_ctes,
    growth_rows,
    interaction_ctes,
    interaction_rows,
    season_ctes,
    season_rows,
)
from sitepanel.catalog.registry import query, rounded
from sitepanel.functions.calendar import MONTH_NAMES
from sitepanel.operators import linear, missing, mixed, selection
from sitepanel.operators.moments import expand_terms, model_frame, site_moments
from sitepanel.plans import growth, interactions
from sitepanel.plans.rules import GROWN, RESPONSES
from sitepanel.session import durable


def _complete(frame: str, columns: list[str]) -> str:
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"model_rows AS (SELECT * FROM {frame} WHERE {known})"


def _sql_term(term: str) -> str:
    return "(" + " * ".join(term.split(":")) + ")" if ":" in term else term


def _subset_rule(terms: list[str]) -> str:
    """Bit sets in which every product comes with its factors."""
    rules = []
    for j, term in enumerate(terms):
        if ":" in term:
            mask = sum(1 << terms.index(f) for f in term.split(":"))
            rules.append(f"((k & {1 << j}) = 0 OR (k & {mask}) = {mask})")
    return f"SELECT k AS subset FROM range(0, {2 ** len(terms)}) t(k) WHERE {' AND '.join(rules) or 'true'}"


_WHOLE = "model_rows AS (SELECT * FROM {} WHERE COLUMNS(*) IS NOT NULL)"


def _selection_sql(ctes: str, frame: str, response: str, terms: list[str], reml: bool, whole: bool = False) -> str:
    """``whole`` takes the rows without any missing value instead of those complete in the model's columns."""
    mains = [t for t in terms if ":" not in t]
    rows = _WHOLE.format(frame) if whole else _complete(frame, [response, *mains])
    fits = mixed_ctes("model_rows", "site", [_sql_term(t) for t in terms], response, reml, subsets=_subset_rule(terms))
    return f"""WITH RECURSIVE {ctes}, {rows}, {fits},
scored AS (SELECT *, -2 * ll + 2 * (p + 2) + 2.0 * (p + 2) * (p + 3) / (n - p - 3) AS aicc FROM vars),
ranked AS (SELECT *, aicc - min(aicc) OVER () AS delta, exp(-(aicc - min(aicc) OVER ()) / 2) AS relative FROM scored),
weighted AS (SELECT *, relative / sum(relative) OVER () AS weight FROM ranked)"""


_RANKING = """SELECT CAST(subset AS BIGINT) AS subset, CAST(p AS INTEGER) AS rank, round(ll, 4) AS log_lik,
  round(delta, 4) AS delta, round(weight, 5) AS weight FROM weighted"""


def _averages(terms: list[str], delta: float) -> str:
    return f""", {names_cte(['(Intercept)', *terms])},
chosen AS (SELECT subset, relative / sum(relative) OVER () AS w FROM weighted WHERE delta < {delta}),
cells AS (SELECT c.w, t.k, t.term, e.b, e.se FROM chosen c CROSS JOIN names t
          LEFT JOIN coef e ON e.subset = c.subset AND e.k = t.k),
means AS (SELECT k, term, count(b) AS models, sum(CASE WHEN b IS NOT NULL THEN w END) AS importance, sum(w * b) AS full_average
          FROM cells GROUP BY k, term HAVING count(b) > 0)
SELECT m.term, m.models, round(m.importance, 5) AS importance, round(full_average, 5) AS full_average,
       round(sqrt(sum(w * (coalesce(se, 0) ** 2 + (coalesce(b, 0) - full_average) ** 2))), 5) AS full_error,
       round(sqrt(sum(CASE WHEN b IS NOT NULL THEN w * (se ** 2 + (b - full_average / importance) ** 2) END) / importance), 5)
         AS conditional_error
FROM means m JOIN cells c ON c.k = m.k GROUP BY m.term, m.models, importance, full_average"""


def _ranked(frame: DataFrame, response: str, formula, reml: bool) -> DataFrame:
    terms = expand_terms(formula)
    complete = model_frame(frame, [response], terms, keep=["site"])
    moments = site_moments(complete, "site", [*terms, response])
    return selection.model_selection(moments, response, terms, reml)


def _shown_ranking(table: DataFrame) -> DataFrame:
    picked = table.select("subset", "rank", "log_lik", "delta", "weight")
    return rounded(rounded(picked, "log_lik", "delta", digits=4), "weight", digits=5)


def _shown_averages(table: DataFrame) -> DataFrame:
    shown = ["importance", "full_average", "full_error", "conditional_error"]
    return rounded(table.select("term", "models", *shown), *shown, digits=5)


_VEGETATION = list(growth.VEGETATION_TERMS)
_VEGETATION_SQL = _selection_sql(growth_ctes(), "growth_frame", growth.RESPONSE, _VEGETATION, reml=True)
_VEGETATION_WHOLE_SQL = _selection_sql(growth_ctes(), "growth_frame", growth.RESPONSE, _VEGETATION, reml=True, whole=True)


@query(f"{_VEGETATION_SQL} {_RANKING}")
def vegetation_selection(spark: SparkSession, folder: str) -> DataFrame:
    """All subsets of the vegetation model of stem growth."""
    return _shown_ranking(_ranked(growth_rows(spark, folder), growth.RESPONSE, _VEGETATION, reml=True))


@query(f"{_VEGETATION_WHOLE_SQL} {_RANKING}")
def vegetation_whole_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The same on the rows without any missing value."""
    whole = growth_rows(spark, folder).dropna(how="any")
    return _shown_ranking(_ranked(whole, growth.RESPONSE, _VEGETATION, reml=True))


_LEFT_TERMS = list(growth.VEGETATION_LEFT_TERMS)
_VEGETATION_CHAIN = ",\n".join([
    mixed_ctes("model_rows", "site", _VEGETATION, growth.RESPONSE, True, "a_"),
    f"""fitted AS (SELECT f.*, {fixed_part(_VEGETATION, 'a_')} + u AS fitted FROM model_rows f JOIN a_effects e ON f.site = e.site)""",
    mixed_ctes("fitted", "site", _VEGETATION[:1], "fitted", True, "d_"),
    f"""left_over AS (SELECT f.*, fitted - ({fixed_part(_VEGETATION[:1], 'd_')} + u) AS rest
              FROM fitted f JOIN d_effects e ON f.site = e.site)""",
    *[mixed_ctes("left_over", "site", [t], "rest", True, f"t{k}_") for k, t in enumerate(_LEFT_TERMS)],
])
_LEFT_STEPS = "\n".join(
    f"UNION ALL {_chain_step(3 + k, 'density_residual', f't{k}_', ['(Intercept)', t], 'left_over', [t])}"
    for k, t in enumerate(_LEFT_TERMS)
)


@query(f"""WITH RECURSIVE {growth_ctes()}, {_WHOLE.format('growth_frame')}, {_VEGETATION_CHAIN}
{_chain_step(1, growth.RESPONSE, 'a_', ['(Intercept)', *_VEGETATION], 'model_rows', _VEGETATION)}
UNION ALL {_chain_step(2, 'full_fitted', 'd_', ['(Intercept)', _VEGETATION[0]], 'fitted', _VEGETATION[:1])}
{_LEFT_STEPS}""")
def vegetation_chain(spark: SparkSession, folder: str) -> DataFrame:
    """What density leaves of the vegetation model's fit, on each kind of cover, on the rows without any missing value."""
    whole = growth_rows(spark, folder).dropna(how="any")
    chain = mixed.residual_chain(whole, growth.RESPONSE, _VEGETATION, "site", _VEGETATION[0], _LEFT_TERMS, reml=True)
    return rounded(chain, "estimate", "std_error", "r2_marginal", "r2_conditional")


_PATTERN_COLUMNS = sorted(
    ["site", "year", *[f"{p}{m}{q}" for m in ("stems", "grass", "insects") for p, q in (("", ""), ("ln_", "_lag1"), ("growth_ln_", ""))],
     "water_year_pr", "coldest", "rain_lag1", "coldest_lag1", "county"]
)
_MISSING_SQL = "list_filter([" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _PATTERN_COLUMNS) + "], lambda c: c IS NOT NULL)"


@query(f"""WITH {growth_ctes()}, marked AS (SELECT {_MISSING_SQL} AS m FROM growth_frame)
SELECT array_to_string(m, ',') AS missing, CAST(len(m) AS INTEGER) AS n_missing, count(*) AS rows FROM marked GROUP BY m""")
def missing_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Which columns of the growth panel are missing together, and in how many rows."""
    table = missing.missing_patterns(growth_rows(spark, folder), _PATTERN_COLUMNS)
    return table.withColumn("missing", F.array_join("missing", ","))


_CHOICES = {
    "survey": ["site", "year", "stems"], "density": [growth.RESPONSE, *growth.DENSITY_TERMS], "climate": ["water_year_pr", "coldest"],
    "whole": _PATTERN_COLUMNS,
}
_KEPT_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS choice, count(*) FILTER ({" AND ".join(f"{c} IS NOT NULL" for c in columns)}) AS kept,
  count(*) FILTER (NOT ({" AND ".join(f"{c} IS NOT NULL" for c in columns)})) AS dropped,
  array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN count({c}) < count(*) THEN '{c}' END" for c in columns)}],
    lambda c: c IS NOT NULL)), ',') AS at_fault,
  count(*) FILTER (NOT ({" AND ".join(f"{c} IS NOT NULL" for c in columns)})) > 0 AS fails FROM growth_frame"""
    for name, columns in _CHOICES.items()
)


@query(f"WITH {growth_ctes()} {_KEPT_SQL}")
def complete_case_choices(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that each model's columns would keep of the growth panel, and what a strict fit would report."""
    used = sorted({c for columns in _CHOICES.values() for c in columns})
    return missing.rows_kept(missing.missing_patterns(growth_rows(spark, folder), used), _CHOICES)


_FULL = list(growth.FULL_TERMS)
_FULL_SQL = _selection_sql(growth_ctes(), "growth_frame", growth.RESPONSE, _FULL, reml=True)


@query(f"{_FULL_SQL} {_averages(_FULL, growth.AVERAGED_WITHIN)}")
def full_model_average(spark: SparkSession, folder: str) -> DataFrame:
    """Averages over the good subsets of the full model of stem growth."""
    table = _ranked(growth_rows(spark, folder), growth.RESPONSE, _FULL, reml=True)
    return _shown_averages(selection.model_average(table, growth.AVERAGED_WITHIN))


_DENSITY = list(growth.DENSITY_TERMS)
_GROWTH_CHAIN = f"""{mixed_ctes('model_rows', 'site', _DENSITY, growth.RESPONSE, True, 'a_')},
fitted AS (SELECT f.*, {fixed_part(_DENSITY, 'a_')} + u AS fitted FROM model_rows f JOIN a_effects e ON f.site = e.site),
{mixed_ctes('fitted', 'site', _DENSITY[:1], 'fitted', True, 'd_')},
left_over AS (SELECT f.*, fitted - ({fixed_part(_DENSITY[:1], 'd_')} + u) AS rest
              FROM fitted f JOIN d_effects e ON f.site = e.site),
{mixed_ctes('left_over', 'site', _DENSITY[1:2], 'rest', True, 'i_')},
{mixed_ctes('left_over', 'site', _DENSITY[2:], 'rest', True, 'r_')}"""


@query(f"""WITH RECURSIVE {growth_ctes()}, {_complete('growth_frame', [growth.RESPONSE, *_DENSITY])}, {_GROWTH_CHAIN}
{_chain_step(1, growth.RESPONSE, 'a_', ['(Intercept)', *_DENSITY], 'model_rows', _DENSITY)}
UNION ALL {_chain_step(2, 'full_fitted', 'd_', ['(Intercept)', _DENSITY[0]], 'fitted', _DENSITY[:1])}
UNION ALL {_chain_step(3, 'density_residual', 'i_', ['(Intercept)', _DENSITY[1]], 'left_over', _DENSITY[1:2])}
UNION ALL {_chain_step(4, 'density_residual', 'r_', ['(Intercept)', _DENSITY[2]], 'left_over', _DENSITY[2:])}""")
def growth_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Partial-residual analysis of stem growth."""
    chain = mixed.residual_chain(
        growth_rows(spark, folder), growth.RESPONSE, _DENSITY, "site", _DENSITY[0], _DENSITY[1:], reml=True
    )
    return rounded(chain, "estimate", "std_error", "r2_marginal", "r2_conditional")


_SEASON_TERMS = ["spring_pr", "summer_pr", "autumn_pr", "winter_pr"]
_COVER = list(RESPONSES)
_MONTH_TERMS = [f"{m}_max" for m in MONTH_NAMES]


@query(f"""WITH RECURSIVE {season_ctes()}, {linear_ctes('season_frame', _SEASON_TERMS, ['total_cover', *_COVER])},
{names_cte(['(Intercept)', *_SEASON_TERMS])} {_linear_coefficients(5, ['total_cover', *_COVER])}""")
def season_cover_models(spark: SparkSession, folder: str) -> DataFrame:
    """Cover total and each cover class on season rain."""
    fit = linear.fit_linear(season_rows(spark, folder), ["total_cover", *_COVER], _SEASON_TERMS)
    return _shown(fit.coefficients())


@query(f"""WITH RECURSIVE {season_ctes()}, {mixed_ctes('season_frame', 'site', _SEASON_TERMS, 'total_cover', reml=False)},
{names_cte(['(Intercept)', *_SEASON_TERMS])}
SELECT 'total_cover' AS response, term, round(b, 6) AS estimate, round(se, 6) AS std_error FROM coef JOIN names USING (k)""")
def season_cover_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Cover total on season rain with a random intercept per site."""
    fit = mixed.fit_mixed(season_rows(spark, folder), "total_cover", _SEASON_TERMS, "site", na="fail")
    return rounded(fit.coefficients().drop("df", "t_value", "p_value"), "estimate", "std_error")


@query(f"""WITH RECURSIVE {season_ctes()}, {_complete('season_frame', [*_MONTH_TERMS, *_COVER])},
{linear_ctes('model_rows', _MONTH_TERMS, _COVER)},
{names_cte(['(Intercept)', *_MONTH_TERMS])} {_linear_coefficients(13, _COVER)}""")
def month_cover_models(spark: SparkSession, folder: str) -> DataFrame:
    """Each cover class on twelve monthly maxima."""
    return _shown(linear.fit_linear(season_rows(spark, folder), _COVER, _MONTH_TERMS).coefficients())


_CHANGES = [f"{c}_change" for c in GROWN]


def _many_mixed_sql(ctes: str, frame: str, terms: list[str], responses: list[str]) -> str:
    """Coefficients of one random-intercept model per response."""
    fits = ",\n".join(mixed_ctes(frame, "site", terms, y, False, f"y{k}_") for k, y in enumerate(responses))
    tables = " UNION ALL ".join(
        f"""SELECT '{y}' AS response, term, round(b, 5) AS estimate, round(se, 5) AS std_error, CAST(n - g - p + 1 AS DOUBLE) AS df,
  round(b / se, 3) AS t_value, round(theta, 4) AS theta, round(ll, 3) AS log_lik
FROM y{k}_coef JOIN names USING (k), y{k}_vars"""
        for k, y in enumerate(responses)
    )
    return f"WITH RECURSIVE {ctes}, {fits}, {names_cte(['(Intercept)', *terms])} {tables}"


def _shown_many(fits: mixed.MixedFits) -> DataFrame:
    table = fits.coefficients().drop("p_value").join(fits.summary().select("response", "theta", "log_lik"), "response")
    table = rounded(rounded(table, "estimate", "std_error", digits=5), "t_value", "log_lik", digits=3)
    return rounded(table, "theta", digits=4)


@query(_many_mixed_sql(cover_growth_ctes(), "grown", _SEASON_TERMS, _CHANGES))
def cover_growth_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Growth of four cover classes on season rain, with a random intercept per site, from one pass."""
    rows = cover_growth_rows(spark, folder)
    return _shown_many(mixed.fit_mixed_many(rows, _CHANGES, _SEASON_TERMS, "site", na="fail"))


_LOG_CHANGES, _LOG_SEASONS = [f"ln_{c}" for c in _CHANGES], [f"ln_{t}" for t in _SEASON_TERMS]


@query(_many_mixed_sql(
    f"{cover_growth_ctes()}, {_complete('grown', [*_LOG_CHANGES, *_LOG_SEASONS])}", "model_rows", _LOG_SEASONS, _LOG_CHANGES
))
def cover_growth_log_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """The same on shifted logs; changes below the shift are missing."""
    rows = cover_growth_rows(spark, folder)
    return _shown_many(mixed.fit_mixed_many(rows, _LOG_CHANGES, _LOG_SEASONS, "site"))


@query(f"""WITH RECURSIVE {cover_growth_ctes()},
{mixed_ctes('grown', 'site', _SEASON_TERMS, 'target_weed_change', reml=False)}
SELECT f.site, f.year, round({fixed_part(_SEASON_TERMS)} + u, 4) AS fitted,
       round(target_weed_change - ({fixed_part(_SEASON_TERMS)} + u), 4) AS residual
FROM grown f JOIN effects e ON f.site = e.site""")
def cover_growth_residuals(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted values and residuals of the target weed's growth: the rows behind its diagnostic plots."""
    rows = durable(cover_growth_rows(spark, folder).select("site", "year", *_CHANGES, *_SEASON_TERMS))
    fit = mixed.fit_mixed_many(rows, _CHANGES, _SEASON_TERMS, "site")["target_weed_change"]
    return rounded(fit.score(rows).select("site", "year", "fitted", "residual"), "fitted", "residual", digits=4)


@query(_many_mixed_sql(
    f"{season_ctes()}, {_complete('season_frame', [*_MONTH_TERMS, *_COVER])}", "model_rows", _MONTH_TERMS[:4], _COVER
))
def month_cover_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Six cover classes on the maxima of the first four months, with a random intercept per site."""
    rows = season_rows(spark, folder).dropna(how="any", subset=_MONTH_TERMS)
    return _shown_many(mixed.fit_mixed_many(rows, _COVER, _MONTH_TERMS[:4], "site"))


_SHORT = expand_terms(interactions.SHORT_TERMS)
_SHORT_SQL = _selection_sql(interaction_ctes(), "interaction_frame", interactions.RESPONSE, _SHORT, reml=False)


@query(f"{_SHORT_SQL} {_RANKING}")
def interaction_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Allowed subsets of a model with two products."""
    return _shown_ranking(
        _ranked(interaction_rows(spark, folder), interactions.RESPONSE, interactions.SHORT_TERMS, reml=False)
    )


@query(f"{_SHORT_SQL} {_averages(_SHORT, interactions.AVERAGED_WITHIN)}")
def interaction_average(spark: SparkSession, folder: str) -> DataFrame:
    table = _ranked(interaction_rows(spark, folder), interactions.RESPONSE, interactions.SHORT_TERMS, reml=False)
    return _shown_averages(selection.model_average(table, interactions.AVERAGED_WITHIN))


_INSECT = expand_terms(interactions.INSECT_TERMS)
_PLANT = expand_terms(interactions.PLANT_TERMS)
_COLD = expand_terms(interactions.COLD_TERMS)


@query(f"{_selection_sql(interaction_ctes(), 'interaction_frame', interactions.RESPONSE, _INSECT, reml=False)} {_RANKING}")
def insect_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Allowed subsets of insects, rain and their product."""
    return _shown_ranking(
        _ranked(interaction_rows(spark, folder), interactions.RESPONSE, interactions.INSECT_TERMS, reml=False)
    )


@query(f"{_selection_sql(interaction_ctes(), 'interaction_frame', interactions.RESPONSE, _PLANT, reml=False)} {_RANKING}")
def plant_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Subsets of last year's insects, rain and cold."""
    return _shown_ranking(
        _ranked(interaction_rows(spark, folder), interactions.RESPONSE, interactions.PLANT_TERMS, reml=False)
    )


@query(f"""WITH RECURSIVE {interaction_ctes()},
{_complete('interaction_frame', [interactions.RESPONSE, *[t for t in _COLD if ':' not in t]])},
{mixed_ctes('model_rows', 'site', [_sql_term(t) for t in _COLD], interactions.RESPONSE, reml=True)},
{names_cte(['(Intercept)', *_COLD])}
SELECT '{interactions.RESPONSE}' AS response, term, round(b, 5) AS estimate, round(se, 5) AS std_error
FROM coef JOIN names USING (k)""")
def cold_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    """The two-product model with the coldest day, by restricted likelihood."""
    fit = mixed.fit_mixed(
        interaction_rows(spark, folder), interactions.RESPONSE, interactions.COLD_TERMS, "site", reml=True
    )
    return rounded(fit.coefficients().drop("df", "t_value", "p_value"), "estimate", "std_error", digits=5)


_WIDE = expand_terms(interactions.WIDE_TERMS)
_WIDE_NEEDS = [sum(1 << _WIDE.index(f) for f in t.split(":")) if ":" in t else 0 for t in _WIDE]
_WIDE_FITS = tree_ctes("model_rows", "site", [_sql_term(t) for t in _WIDE], interactions.RESPONSE, _WIDE_NEEDS)
_WIDE_SQL = f"""WITH RECURSIVE {interaction_ctes()},
{_complete("interaction_frame", [interactions.RESPONSE, *[t for t in _WIDE if ":" not in t]])}, {_WIDE_FITS},
scored AS (SELECT *, -2 * ll + 2 * (p + 2) + 2.0 * (p + 2) * (p + 3) / (n - p - 3) AS aicc FROM vars),
ranked AS (SELECT *, aicc - min(aicc) OVER () AS delta, exp(-(aicc - min(aicc) OVER ()) / 2) AS relative FROM scored)"""


@query(f"""{_WIDE_SQL}, weighted AS (SELECT *, relative / sum(relative) OVER () AS weight FROM ranked) {_RANKING}""")
def wide_interaction_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Allowed subsets of thirteen terms, of which four are products."""
    return _shown_ranking(
        _ranked(interaction_rows(spark, folder), interactions.RESPONSE, interactions.WIDE_TERMS, reml=False)
    )


@query(f"""{_WIDE_SQL}, weighted AS (
  SELECT *, relative / sum(relative) OVER () AS weight FROM ranked WHERE delta <= {interactions.AVERAGED_WITHIN}) {_RANKING}""")
def wide_good_models(spark: SparkSession, folder: str) -> DataFrame:
    """The subsets of thirteen terms close to the best, found without fitting the others."""
    terms = expand_terms(interactions.WIDE_TERMS)
    complete = model_frame(interaction_rows(spark, folder), [interactions.RESPONSE], terms, keep=["site"])
    moments = site_moments(complete, "site", [*terms, interactions.RESPONSE])
    return _shown_ranking(
        selection.model_selection(moments, interactions.RESPONSE, terms, within=interactions.AVERAGED_WITHIN)
    )
