"""Linear and mixed models, selection, averaging, influence and effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepanel.catalog.modelsql import (
    f_tail, fixed_part, linear_ctes, mixed_ctes, names_cte, t_quantile_cte, t_tail,
)
from sitepanel.catalog.registry import (
    GAPPY_PANEL,
    READINGS,
    SITE_PANEL,
    gappy_panel,
    query,
    readings,
    rounded,
    site_panel,
)
from sitepanel.functions.calendar import MONTH_NAMES
from sitepanel.operators import climate, linear, mixed, panel, selection
from sitepanel.operators.joins import lookup_join
from sitepanel.operators.moments import SiteMoments, expand_terms, model_frame, site_moments
from sitepanel.sources.tables import read_parquet

# The model frame: yearly growth per customer, with the account balance as a true site effect.
TERMS = ["stems_lag1", "insects", "rain"]
LABELS = ["(Intercept)", *TERMS]
FRAME = f"""{GAPPY_PANEL},
lagged AS (SELECT site, year, ln(stems + 1) - lag(ln(stems + 1)) OVER w AS growth,
                  lag(ln(stems + 1)) OVER w AS stems_lag1, insects, rain / 100 AS rain, ln(grass + 1) AS ln_grass
           FROM gappy_panel WINDOW w AS (PARTITION BY site ORDER BY year)),
frame AS (SELECT l.site, l.year, l.growth + c.c_acctbal / 5000 AS response, stems_lag1, insects, rain, ln_grass
          FROM lagged l JOIN customer c ON l.site = c.c_custkey WHERE l.growth IS NOT NULL)"""


def frame(spark: SparkSession, folder: str) -> DataFrame:
    lagged = panel.with_lags(
        gappy_panel(spark, folder), "site", "year",
        logs={"stems": "ln_stems", "grass": "ln_grass"}, growth=["ln_stems"],
    )
    balance = read_parquet(spark, folder, "customer").select(
        F.col("c_custkey").alias("site"), (F.col("c_acctbal") / 5000).alias("vigour")
    )
    return lagged.join(balance, ["site"]).select(
        "site",
        "year",
        (F.col("growth_ln_stems") + F.col("vigour")).alias("response"),
        F.col("ln_stems_lag1").alias("stems_lag1"),
        "insects",
        (F.col("rain") / 100).alias("rain"),
        "ln_grass",
    )


def _moments(spark: SparkSession, folder: str, terms: list[str]) -> SiteMoments:
    complete = model_frame(frame(spark, folder), ["response"], terms, keep=["site"])
    return site_moments(complete, "site", [*terms, "response"])


def _fit_with_rows(
    spark: SparkSession, folder: str, formula: list[str], reml: bool
) -> tuple[mixed.MixedFit, DataFrame]:
    """A fit and the complete rows behind it, which are computed once for both."""
    terms = expand_terms(formula)
    complete = model_frame(frame(spark, folder), ["response"], terms, keep=["site", "year"])
    moments = site_moments(complete, "site", [*terms, "response"])
    return mixed.fit_on_moments(moments, "response", terms, reml), complete


_COEFFICIENT_COLUMNS = ["estimate", "std_error", "t_value", "p_value"]


# ---------------------------------------------------------------------------
# Linear models


def _linear_coefficients(p: int, responses: list[str]) -> str:
    labels = names_cte(responses, "ys")
    return f""", {labels},
est AS (SELECT y.term AS response, t.term, a.v AS estimate, sqrt(-c.v * r.v / (n - p)) AS std_error,
               CAST(n - p AS DOUBLE) AS df
        FROM swept a JOIN names t ON a.i = t.k JOIN ys y ON a.j = y.k + {p}
        JOIN swept c ON c.step = {p} AND c.i = a.i AND c.j = a.i
        JOIN swept r ON r.step = {p} AND r.i = a.j AND r.j = a.j, dims
        WHERE a.step = {p})
SELECT response, term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, df,
       round(estimate / std_error, 4) AS t_value, round({t_tail('(estimate / std_error)', 'df')}, 5) AS p_value
FROM est"""


def _shown(coefficients: DataFrame) -> DataFrame:
    return rounded(
        rounded(rounded(coefficients, "estimate", "std_error"), "t_value", digits=4), "p_value", digits=5
    )


@query(f"""WITH RECURSIVE {FRAME}, {linear_ctes('frame', TERMS, ['response'])}, {names_cte(LABELS)}
{_linear_coefficients(4, ['response'])}""")
def lm_fit(spark: SparkSession, folder: str) -> DataFrame:
    fit = linear.fit_linear(frame(spark, folder), ["response"], TERMS)
    return _shown(fit.coefficients())


_ANOVA_SQL = """SELECT 'response' AS response, CAST(s.step AS INTEGER) AS position, t.term, CAST(1 AS DOUBLE) AS df,
  round(s.v * s.v / d.v, 4) AS sum_sq, round(s.v * s.v / d.v, 4) AS mean_sq,
  round(s.v * s.v / d.v / (r.v / (n - p)), 4) AS f_value,
  round({tail}, 5) AS p_value
FROM swept s JOIN swept d ON d.step = s.step AND d.i = s.step AND d.j = s.step JOIN names t ON t.k = s.step,
     (SELECT v FROM swept WHERE step = {p} AND i = {p} AND j = {p}) r, dims
WHERE s.step BETWEEN 1 AND {p} - 1 AND s.i = s.step AND s.j = {p}
UNION ALL
SELECT 'response', {p}, 'Residuals', n - p, round(v, 4), round(v / (n - p), 4), NULL, NULL
FROM swept, dims WHERE step = {p} AND i = {p} AND j = {p}"""


@query(f"""WITH RECURSIVE {FRAME}, {linear_ctes('frame', TERMS, ['response'])}, {names_cte(LABELS)}
{_ANOVA_SQL.format(p=4, tail=t_tail('(s.v / sqrt(d.v * r.v / (n - p)))', '(n - p)'))}""")
def lm_anova(spark: SparkSession, folder: str) -> DataFrame:
    """Sequential sums of squares in term order."""
    fit = linear.fit_linear(frame(spark, folder), ["response"], TERMS)
    return rounded(rounded(fit.anova(), "sum_sq", "mean_sq", "f_value", digits=4), "p_value", digits=5)


@query(f"""WITH RECURSIVE {FRAME}, {linear_ctes('frame', TERMS, ['response'])},
parts AS (SELECT n, 4 AS rank, max(CASE WHEN step = 4 THEN v END) AS rss, max(CASE WHEN step = 1 THEN v END) AS tss
          FROM swept, dims WHERE i = 4 AND j = 4 GROUP BY n)
SELECT 'response' AS response, n, rank, round(sqrt(rss / (n - 4)), 6) AS sigma, round(1 - rss / tss, 6) AS r_squared,
       round(1 - rss / tss * (n - 1) / (n - 4), 6) AS adj_r_squared,
       round((tss - rss) / 3 / (rss / (n - 4)), 4) AS f_value,
       round({f_tail('((tss - rss) / 3 / (rss / (n - 4)))', '3', '(n - 4)')}, 5) AS p_value
FROM parts""")
def lm_summary(spark: SparkSession, folder: str) -> DataFrame:
    fit = linear.fit_linear(frame(spark, folder), ["response"], TERMS)
    table = rounded(rounded(fit.summary(), "sigma", "r_squared", "adj_r_squared"), "f_value", digits=4)
    return rounded(table, "p_value", digits=5)


_INTERACTION = ["insects", "rain", "(insects * rain)"]


@query(f"""WITH RECURSIVE {FRAME}, {linear_ctes('frame', _INTERACTION, ['response'])},
{names_cte(['(Intercept)', 'insects', 'rain', 'insects:rain'])}
{_linear_coefficients(4, ['response'])}""")
def lm_interaction(spark: SparkSession, folder: str) -> DataFrame:
    """Main effects and their product from one crossed term."""
    fit = linear.fit_linear(frame(spark, folder), ["response"], ["insects*rain"])
    return _shown(fit.coefficients())


_MAXIMA = list(MONTH_NAMES)
_MAXIMA_SQL = ", ".join(f"max(CASE WHEN month = {m} THEN tmax END) AS {n}_max" for m, n in enumerate(_MAXIMA, 1))
_MAXIMA_COLUMNS = [f"{n}_max" for n in _MAXIMA]
_MANY = ["stems", "grass", "coldest"]


@query(f"""WITH RECURSIVE {SITE_PANEL},
wide AS (SELECT site, year, {_MAXIMA_SQL} FROM readings GROUP BY site, year),
whole AS (SELECT p.*, {", ".join(_MAXIMA_COLUMNS)} FROM site_panel p JOIN wide w ON p.site = w.site AND p.year = w.year
          WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _MAXIMA_COLUMNS)}),
{linear_ctes('whole', _MAXIMA_COLUMNS, _MANY)}, {names_cte(['(Intercept)', *_MAXIMA_COLUMNS])}
{_linear_coefficients(13, _MANY)}""")
def lm_multi_response(spark: SparkSession, folder: str) -> DataFrame:
    """Three responses on twelve monthly maxima, from one pass."""
    pieces = climate.month_pieces(readings(spark, folder), ["site"], ["tmax"])
    wide = climate.monthly_maxima(pieces, ["site"], "tmax")
    whole = site_panel(spark, folder).join(wide, ["site", "year"])
    return _shown(linear.fit_linear(whole, _MANY, _MAXIMA_COLUMNS).coefficients())


# ---------------------------------------------------------------------------
# Random-intercept models

_ML = mixed_ctes("frame", "site", TERMS, "response", reml=False)
_REML = mixed_ctes("frame", "site", TERMS, "response", reml=True)
_FIT_SQL = """SELECT 'response' AS response, '{method}' AS method, CAST(n AS DOUBLE) AS n, CAST(g AS DOUBLE) AS sites,
  CAST(p AS INTEGER) AS rank, round(theta, 6) AS theta, round(theta * s2, 6) AS var_site, round(s2, 6) AS var_resid,
  round(ll, 4) AS log_lik,
  round(-2 * ll + 2 * (p + 2) + 2.0 * (p + 2) * (p + 3) / (n - p - 3), 4) AS aicc
FROM vars"""


def _fit(spark: SparkSession, folder: str, reml: bool) -> mixed.MixedFit:
    return mixed.fit_mixed(frame(spark, folder), "response", TERMS, "site", reml=reml)


def _shown_fit(fit: mixed.MixedFit) -> DataFrame:
    table = rounded(fit.summary(), "theta", "var_site", "var_resid")
    return rounded(table, "log_lik", "aicc", digits=4)


@query(f"WITH RECURSIVE {FRAME}, {_ML} {_FIT_SQL.format(method='ML')}")
def lmm_fit_ml(spark: SparkSession, folder: str) -> DataFrame:
    """Variance components and likelihood, maximum likelihood."""
    return _shown_fit(_fit(spark, folder, reml=False))


@query(f"WITH RECURSIVE {FRAME}, {_REML} {_FIT_SQL.format(method='REML')}")
def lmm_fit_reml(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_fit(_fit(spark, folder, reml=True))


_LMM_COEFFICIENTS = f""", {names_cte(LABELS)},
est AS (SELECT t.term, c.b, c.se, v.n - v.g - v.p + 1 AS df FROM coef c JOIN names t ON c.k = t.k, vars v)
SELECT 'response' AS response, term, round(b, 6) AS estimate, round(se, 6) AS std_error, CAST(df AS DOUBLE) AS df,
       round(b / se, 5) AS t_value, round({t_tail('(b / se)', 'df')}, 6) AS p_value FROM est"""


def _shown_mixed(coefficients: DataFrame) -> DataFrame:
    table = rounded(coefficients, "estimate", "std_error")
    return rounded(rounded(table, "t_value", digits=5), "p_value")


@query(f"WITH RECURSIVE {FRAME}, {_REML} {_LMM_COEFFICIENTS}")
def lmm_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_mixed(_fit(spark, folder, reml=True).coefficients())


@query(f"""WITH RECURSIVE {FRAME}, {_REML}
SELECT 'site' AS component, round(theta * s2, 6) AS variance, round(sqrt(theta * s2), 6) AS std_dev FROM vars
UNION ALL SELECT 'residual', round(s2, 6), round(sqrt(s2), 6) FROM vars""")
def lmm_variances(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_fit(spark, folder, reml=True).variances(), "variance", "std_dev")


@query(f"""WITH RECURSIVE {FRAME}, {_REML}, {names_cte(LABELS)}
SELECT 'response' AS response, CAST(s.step AS INTEGER) AS position, t.term, CAST(1 AS DOUBLE) AS df,
       round(s.v * s.v / d.v, 4) AS sum_sq, round(s.v * s.v / d.v / s2, 3) AS f_value,
       round({t_tail('(s.v / sqrt(d.v * s2))', '(n - g - p + 1)')}, 5) AS p_value
FROM w4 s JOIN best b ON s.theta = b.theta JOIN w4 d ON d.theta = s.theta AND d.step = s.step AND d.i = s.step AND d.j = s.step
JOIN names t ON t.k = s.step, vars
WHERE s.step BETWEEN 1 AND 3 AND s.i = s.step AND s.j = 4
UNION ALL SELECT 'response', 4, 'Residuals', CAST(n - g - p + 1 AS DOUBLE), NULL, NULL, NULL FROM vars""")
def lmm_anova(spark: SparkSession, folder: str) -> DataFrame:
    """Sequential tests of the fixed effects, given the variance ratio."""
    table = _fit(spark, folder, reml=True).anova().drop("mean_sq", "df_den")
    return rounded(rounded(rounded(table, "sum_sq", digits=4), "f_value", digits=3), "p_value", digits=5)


@query(f"""WITH RECURSIVE {FRAME}, {_ML}, {names_cte(LABELS)},
est AS (SELECT t.term, c.b, c.se * sqrt(v.n / (v.n - v.p)) AS se, v.n - v.g - v.p + 1 AS df
        FROM coef c JOIN names t ON c.k = t.k, vars v)
SELECT 'response' AS response, term, round(b, 6) AS estimate, round(se, 6) AS std_error, CAST(df AS DOUBLE) AS df,
       round(b / se, 5) AS t_value, round({t_tail('(b / se)', 'df')}, 6) AS p_value FROM est""")
def lmm_coefficients_ml(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed effects of a maximum-likelihood fit with the residual variance rescaled by n/(n-p)."""
    return _shown_mixed(_fit(spark, folder, reml=False).coefficients(adjust_sigma=True))


@query(f"""WITH RECURSIVE {FRAME}, {_ML}, {names_cte(LABELS)},
lines AS (SELECT s.step, t.term, s.v * s.v / d.v AS ss, s2 * n / (n - p) AS s2, n - g - p + 1 AS df
  FROM w4 s JOIN best b ON s.theta = b.theta
  JOIN w4 d ON d.theta = s.theta AND d.step = s.step AND d.i = s.step AND d.j = s.step
  JOIN names t ON t.k = s.step, vars WHERE s.step BETWEEN 0 AND 3 AND s.i = s.step AND s.j = 4)
SELECT 'response' AS response, CAST(step AS INTEGER) AS position, term, CAST(1 AS DOUBLE) AS df, round(ss, 4) AS sum_sq,
       round(ss / s2, 3) AS f_value, round({t_tail('sqrt(ss / s2)', 'df')}, 5) AS p_value FROM lines
UNION ALL SELECT 'response', 4, 'Residuals', CAST(n - g - p + 1 AS DOUBLE), NULL, NULL, NULL FROM vars""")
def lmm_anova_ml(spark: SparkSession, folder: str) -> DataFrame:
    """Sequential tests of a maximum-likelihood fit, with the intercept's line and the rescaled variance."""
    table = _fit(spark, folder, reml=False).anova(adjust_sigma=True, intercept=True).drop("mean_sq", "df_den")
    return rounded(rounded(rounded(table, "sum_sq", digits=4), "f_value", digits=3), "p_value", digits=5)


@query(f"""WITH RECURSIVE {FRAME}, {_REML},
spread AS (SELECT var_samp({fixed_part(TERMS)}) AS f FROM frame)
SELECT 'response' AS response, round(f / (f + theta * s2 + s2), 6) AS r2_marginal,
       round((f + theta * s2) / (f + theta * s2 + s2), 6) AS r2_conditional FROM spread, vars""")
def lmm_r2(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_fit(spark, folder, reml=True).r_squared(), "r2_marginal", "r2_conditional")


_THETAS = [0.0, 0.01, 0.1, 0.5, 1.0, 2.0, 10.0]


@query(f"""WITH RECURSIVE {FRAME}, {_ML},
given(theta) AS (VALUES {", ".join(f"(CAST({t} AS DOUBLE))" for t in _THETAS)}),
gg AS (SELECT 7 AS subset, theta, i, j, sum(s - theta / (1 + n * theta) * b) AS v FROM pool, given GROUP BY theta, i, j),
ww AS (SELECT 0 AS step, theta, i, j, v FROM gg UNION ALL
  SELECT step + 1, theta, i, j, CASE WHEN i = step AND j = step THEN -1 / pv WHEN i = step OR j = step THEN v / pv
    ELSE v - rv * cv / pv END
  FROM (SELECT *, max(CASE WHEN i = step AND j = step THEN v END) OVER (PARTITION BY theta) AS pv,
               max(CASE WHEN i = step THEN v END) OVER (PARTITION BY theta, j) AS rv,
               max(CASE WHEN j = step THEN v END) OVER (PARTITION BY theta, i) AS cv FROM ww WHERE step < 4))
SELECT theta, round(-0.5 * (n * ln(2 * pi() * v / n) + (SELECT sum(sites * ln(1 + n * theta)) FROM sizes) + n), 4) AS log_lik
FROM ww, dims WHERE step = 4 AND i = 4 AND j = 4""")
def lmm_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Profile log-likelihood at given variance ratios."""
    grid = mixed.likelihood_grid(_moments(spark, folder, TERMS), "response", TERMS, _THETAS)
    return rounded(grid, "log_lik", digits=4)


@query(f"""WITH RECURSIVE {FRAME}, {_REML}
SELECT f.site, f.year, round({fixed_part(TERMS)} + u, 5) AS fitted,
       round(response - ({fixed_part(TERMS)} + u), 5) AS residual
FROM frame f JOIN effects e ON f.site = e.site""")
def lmm_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted values with the site effect, and residuals, row by row."""
    fit, rows = _fit_with_rows(spark, folder, TERMS, reml=True)
    return rounded(fit.score(rows).select("site", "year", "fitted", "residual"), "fitted", "residual", digits=5)


@query(f"""WITH RECURSIVE {FRAME}, {_REML}
SELECT site, CAST(rows AS DOUBLE) AS rows, round(u, 6) AS site_effect FROM effects""")
def lmm_site_effects(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_fit(spark, folder, reml=True).site_effects(), "site_effect")


_PLOTS = """plots AS (SELECT l_suppkey AS site, l_extendedprice / 10000 + s_acctbal / 20000 AS cover,
                             l_quantity / 10 AS density, CAST(l_linenumber AS DOUBLE) AS plot
                      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


@query(f"""WITH RECURSIVE {_PLOTS}, {mixed_ctes('plots', 'site', ['density', 'plot'], 'cover', reml=False)}
{_FIT_SQL.format(method='ML').replace("'response' AS response", "'cover' AS response")}""")
def lmm_plots(spark: SparkSession, folder: str) -> DataFrame:
    """Plot-level rows with hundreds per site: large sites share interpolation classes."""
    balance = read_parquet(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") / 20000).alias("vigour")
    )
    plots = lookup_join(read_parquet(spark, folder, "lineitem"), balance, ["l_suppkey"], "inner").select(
        F.col("l_suppkey").alias("site"),
        (F.col("l_extendedprice") / 10000 + F.col("vigour")).alias("cover"),
        (F.col("l_quantity") / 10).alias("density"),
        F.col("l_linenumber").cast("double").alias("plot"),
    )
    fit = mixed.fit_mixed(plots, "cover", ["density", "plot"], "site")
    return _shown_fit(fit)


# ---------------------------------------------------------------------------
# Selection and averaging

_SELECTED = ["stems_lag1", "insects", "rain", "insects*rain"]
_SELECTED_SQL = ["stems_lag1", "insects", "rain", "(insects * rain)"]
_SELECTED_NAMES = ["stems_lag1", "insects", "rain", "insects:rain"]
# the product (bit 3) needs both its factors (bits 1 and 2)
_SUBSETS = "SELECT k AS subset FROM range(0, 16) t(k) WHERE (k & 8) = 0 OR (k & 6) = 6"
_SELECTION = f"""{mixed_ctes('frame', 'site', _SELECTED_SQL, 'response', reml=False, subsets=_SUBSETS)},
{names_cte(['(Intercept)', *_SELECTED_NAMES])},
scored AS (SELECT *, -2 * ll + 2 * (p + 2) + 2.0 * (p + 2) * (p + 3) / (n - p - 3) AS aicc FROM vars),
ranked AS (SELECT *, aicc - min(aicc) OVER () AS delta,
                  exp(-(aicc - min(aicc) OVER ()) / 2) AS relative FROM scored),
weighted AS (SELECT *, relative / sum(relative) OVER () AS weight FROM ranked)"""


def _selection(spark: SparkSession, folder: str) -> DataFrame:
    terms = expand_terms(_SELECTED)
    return selection.model_selection(_moments(spark, folder, terms), "response", terms)


@query(f"""WITH RECURSIVE {FRAME}, {_SELECTION}
SELECT CAST(subset AS BIGINT) AS subset,
       (SELECT string_agg(term, ' + ' ORDER BY k) FROM names
        WHERE k = 0 OR (subset >> (k - 1)) & 1 = 1) AS model,
       CAST(p AS INTEGER) AS rank, round(ll, 4) AS log_lik, round(aicc, 4) AS aicc, round(delta, 4) AS delta,
       round(weight, 6) AS weight
FROM weighted""")
def model_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Every allowed subset of four terms, with AICc, difference to the best and weight."""
    table = _selection(spark, folder).drop("theta", "terms", "estimates", "std_errors")
    return rounded(rounded(table, "weight"), "log_lik", "aicc", "delta", digits=4)


@query(f"""WITH RECURSIVE {FRAME}, {_SELECTION}
SELECT CAST(subset AS BIGINT) AS subset, round(aicc, 4) AS aicc FROM weighted ORDER BY aicc LIMIT 3""")
def best_models(spark: SparkSession, folder: str) -> DataFrame:
    top = selection.best_models(_selection(spark, folder), 3)
    return rounded(top.select("subset", "aicc"), "aicc", digits=4)


@query(f"""WITH RECURSIVE {FRAME}, {_SELECTION},
chosen AS (SELECT subset, relative / sum(relative) OVER () AS w FROM weighted WHERE delta < 7),
cells AS (SELECT c.w, t.k, t.term, e.b, e.se FROM chosen c CROSS JOIN names t
          LEFT JOIN coef e ON e.subset = c.subset AND e.k = t.k),
means AS (SELECT k, term, count(b) AS models, sum(CASE WHEN b IS NOT NULL THEN w END) AS importance, sum(w * b) AS full_average
          FROM cells GROUP BY k, term)
SELECT m.term, m.models, round(m.importance, 6) AS importance, round(full_average, 6) AS full_average,
       round(sqrt(sum(w * (coalesce(se, 0) ** 2 + (coalesce(b, 0) - full_average) ** 2))), 6) AS full_error,
       round(full_average / importance, 6) AS conditional_average,
       round(sqrt(sum(CASE WHEN b IS NOT NULL THEN w * (se ** 2 + (b - full_average / importance) ** 2) END) / importance), 6)
         AS conditional_error,
       round(sum(w * sqrt(coalesce(se, 0) ** 2 + (coalesce(b, 0) - full_average) ** 2)), 6) AS full_error_plain,
       round(sum(CASE WHEN b IS NOT NULL THEN w * sqrt(se ** 2 + (b - full_average / importance) ** 2) END) / importance, 6)
         AS conditional_error_plain
FROM means m JOIN cells c ON m.k = c.k WHERE models > 0 GROUP BY m.term, m.models, importance, full_average""")
def model_average(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients averaged over the models within seven units of the best."""
    ranked = _selection(spark, folder)
    plain = selection.model_average(ranked, 7.0, revised=False).select(
        "term", F.col("full_error").alias("full_error_plain"), F.col("conditional_error").alias("conditional_error_plain")
    )
    table = selection.model_average(ranked, 7.0).join(plain, "term")
    return rounded(
        table, "importance", "full_average", "full_error", "conditional_average", "conditional_error",
        "full_error_plain", "conditional_error_plain",
    )


# ---------------------------------------------------------------------------
# Chains, influence, effects


def _chain_step(number: int, response: str, prefix: str, names: list[str], frame_name: str, xs: list[str]) -> str:
    labels = "CASE c.k " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"
    return f"""SELECT {number} AS step, '{response}' AS response, {labels} AS term, round(c.b, 6) AS estimate,
  round(c.se, 6) AS std_error, round(f / (f + theta * s2 + s2), 6) AS r2_marginal,
  round((f + theta * s2) / (f + theta * s2 + s2), 6) AS r2_conditional
FROM {prefix}coef c, {prefix}vars, (SELECT var_samp({fixed_part(xs, prefix)}) AS f FROM {frame_name})"""


_CHAIN = f"""{mixed_ctes('frame', 'site', TERMS, 'response', True, 'a_')},
fitted AS (SELECT f.*, {fixed_part(TERMS, 'a_')} + u AS fitted FROM frame f JOIN a_effects e ON f.site = e.site),
{mixed_ctes('fitted', 'site', ['stems_lag1'], 'fitted', True, 'd_')},
left_over AS (SELECT f.*, fitted - ({fixed_part(['stems_lag1'], 'd_')} + u) AS rest
              FROM fitted f JOIN d_effects e ON f.site = e.site),
{mixed_ctes('left_over', 'site', ['insects'], 'rest', True, 'i_')},
{mixed_ctes('left_over', 'site', ['rain'], 'rest', True, 'r_')}"""


@query(f"""WITH RECURSIVE {FRAME}, {_CHAIN}
{_chain_step(1, 'response', 'a_', LABELS, 'frame', TERMS)}
UNION ALL {_chain_step(2, 'full_fitted', 'd_', ['(Intercept)', 'stems_lag1'], 'fitted', ['stems_lag1'])}
UNION ALL {_chain_step(3, 'density_residual', 'i_', ['(Intercept)', 'insects'], 'left_over', ['insects'])}
UNION ALL {_chain_step(4, 'density_residual', 'r_', ['(Intercept)', 'rain'], 'left_over', ['rain'])}""")
def residual_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Full fit, fitted values on density, what is left on the other terms."""
    chain = mixed.residual_chain(
        frame(spark, folder), "response", TERMS, "site", "stems_lag1", ["insects", "rain"]
    )
    return rounded(chain, "estimate", "std_error", "r2_marginal", "r2_conditional")


_INFLUENCE = f"""wide AS (
  SELECT f.site, f.year, response - ({fixed_part(TERMS)} + u) AS residual, theta / (1 + e.rows * theta) AS kk,
         [1.0, stems_lag1, insects, rain] AS x, site_sums
  FROM frame f JOIN effects e ON f.site = e.site
  JOIN (SELECT site, list(v ORDER BY k) AS site_sums FROM s0 WHERE k < 4 GROUP BY site) q ON q.site = f.site, best),
hats AS (
  SELECT w.site, w.year, residual, kk + sum(-f.v * (x[i + 1] - kk * site_sums[i + 1]) * (x[j + 1] - kk * site_sums[j + 1])) AS h
  FROM wide w, final f WHERE f.i < 4 AND f.j < 4 GROUP BY w.site, w.year, residual, kk)"""


@query(f"""WITH RECURSIVE {FRAME}, {_ML}, {_INFLUENCE}
SELECT site, year, round(residual, 5) AS residual, round(h, 5) AS leverage,
       round(residual ** 2 * h / (s2 * p * (1 - h) ** 2), 5) AS cook, h > 2.0 * p / n AS high_leverage
FROM hats, vars""")
def influence(spark: SparkSession, folder: str) -> DataFrame:
    """Leverage and Cook's distance of every row."""
    fit, rows = _fit_with_rows(spark, folder, TERMS, reml=False)
    table = fit.influence(rows).drop("response", *TERMS)
    return rounded(table, "residual", "leverage", "cook", digits=5)


_FIXED_HATS = f"""WITH RECURSIVE {FRAME}, {linear_ctes('frame', TERMS, ['response'])},
wide AS (SELECT site, year, [1.0, stems_lag1, insects, rain] AS x FROM frame),
hats AS (SELECT w.site, w.year, sum(-f.v * x[i + 1] * x[j + 1]) AS h
         FROM wide w, swept f WHERE f.step = 4 AND f.i < 4 AND f.j < 4 GROUP BY w.site, w.year)"""


def _fixed_influence(spark: SparkSession, folder: str) -> DataFrame:
    rows = frame(spark, folder)
    fit = mixed.fit_mixed(rows, "response", TERMS, "site", theta=0.0)
    return fit.influence(model_frame(rows, ["response"], TERMS, keep=["site", "year"]))


@query(f"{_FIXED_HATS} SELECT site, year, round(h, 6) AS leverage, h > 8.0 / n AS high_leverage FROM hats, dims")
def fixed_leverage(spark: SparkSession, folder: str) -> DataFrame:
    """Leverage without a site effect: some rows lie above 2p/n, most below."""
    return rounded(_fixed_influence(spark, folder).select("site", "year", "leverage", "high_leverage"), "leverage")


@query(f"""WITH RECURSIVE {FRAME}, {_ML}, {_INFLUENCE}
SELECT site, year, round(h, 6) AS leverage FROM hats, vars WHERE h > 2.0 * p / n""")
def high_leverage(spark: SparkSession, folder: str) -> DataFrame:
    """The rows above 2p/n of the mixed model, site effect included."""
    fit, rows = _fit_with_rows(spark, folder, TERMS, reml=False)
    flagged = fit.influence(rows).where("high_leverage")
    return rounded(flagged.select("site", "year", "leverage"), "leverage")


_CROSSED = ["stems_lag1", "insects*rain"]


@query(f"""WITH RECURSIVE {FRAME},
{mixed_ctes('frame', 'site', ['stems_lag1', 'insects', 'rain', '(insects * rain)'], 'response', reml=False)},
every AS (SELECT l.site, l.year, l.growth + c.c_acctbal / 5000 AS response, stems_lag1, insects, rain
          FROM lagged l JOIN customer c ON l.site = c.c_custkey),
scored AS (SELECT f.site, f.year, response,
             CASE WHEN response IS NOT NULL THEN {fixed_part(['stems_lag1', 'insects', 'rain', '(insects * rain)'])} + u END AS fitted
           FROM every f LEFT JOIN effects e ON f.site = e.site)
SELECT site, year, round(fitted, 5) AS fitted, round(response - fitted, 5) AS residual FROM scored""")
def lmm_scored_raw(spark: SparkSession, folder: str) -> DataFrame:
    """An interaction model scored on the rows as they came: those without a response keep NULL."""
    rows = frame(spark, folder)
    fit = mixed.fit_mixed(rows, "response", _CROSSED, "site")
    return rounded(fit.score(rows).select("site", "year", "fitted", "residual"), "fitted", "residual", digits=5)


@query(f"""WITH RECURSIVE {FRAME},
{mixed_ctes('frame', 'site', ['stems_lag1', 'insects', 'rain', '(insects * rain)'], 'response', reml=False)},
centre AS (SELECT avg(stems_lag1) AS s, avg(insects) AS i, min(rain) AS lo, max(rain) AS hi FROM frame),
points AS (SELECT lo + k * (hi - lo) / 49 AS rain, [1.0, s, i, lo + k * (hi - lo) / 49, i * (lo + k * (hi - lo) / 49)] AS x
           FROM centre, range(0, 50) t(k)),
lines AS (SELECT q.rain, sum(-f.v * x[f.i + 1] * x[f.j + 1]) AS shape FROM points q, final f
          WHERE f.i < 5 AND f.j < 5 GROUP BY q.rain),
fits AS (SELECT q.rain, sum(c.b * x[c.k + 1]) AS fit FROM points q, coef c GROUP BY q.rain),
{t_quantile_cte('n - g - p + 1', 'vars')}
SELECT round(f.rain, 6) AS rain, round(fit, 6) AS fit, round(sqrt(shape * s2), 6) AS std_error,
       round(fit - t * sqrt(shape * s2), 6) AS lower, round(fit + t * sqrt(shape * s2), 6) AS upper
FROM fits f JOIN lines l ON f.rain = l.rain, vars, quantiles""")
def effect_line(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction along one term at the mean of the others; its interaction moves along."""
    fit, rows = _fit_with_rows(spark, folder, _CROSSED, reml=False)
    low, high = rows.agg(F.min("rain"), F.max("rain")).first()
    return rounded(fit.effect_line("rain", low, high), "rain", "fit", "std_error", "lower", "upper")


_SITED = f"""{FRAME},
sited AS (SELECT f.*, CAST(c_nationkey AS DOUBLE) AS nation FROM frame f JOIN customer ON site = c_custkey)"""
_SITE_TERMS = ["stems_lag1", "nation", "insects"]


def _sited_fit(spark: SparkSession, folder: str) -> mixed.MixedFit:
    nations = read_parquet(spark, folder, "customer").select(
        F.col("c_custkey").alias("site"), F.col("c_nationkey").cast("double").alias("nation")
    )
    return mixed.fit_mixed(frame(spark, folder).join(nations, ["site"]), "response", _SITE_TERMS, "site", reml=True)


_DEN = "CASE WHEN k = 2 THEN g - 1 - 1 ELSE n - g - 2 END"  # one term of the sites, two inside them


@query(f"""WITH RECURSIVE {_SITED}, {mixed_ctes('sited', 'site', _SITE_TERMS, 'response', reml=True)},
{names_cte(['(Intercept)', *_SITE_TERMS])},
est AS (SELECT t.term, c.b, c.se, {_DEN.replace('k =', 'c.k =')} AS df FROM coef c JOIN names t ON c.k = t.k, vars v)
SELECT 'response' AS response, term, round(b, 6) AS estimate, round(se, 6) AS std_error, CAST(df AS DOUBLE) AS df,
       round(b / se, 5) AS t_value, round({t_tail('(b / se)', 'df')}, 6) AS p_value FROM est""")
def lmm_site_term(spark: SparkSession, folder: str) -> DataFrame:
    """A term that is constant within every site is tested with the sites' degrees of freedom."""
    return _shown_mixed(_sited_fit(spark, folder).coefficients())


@query(f"""WITH RECURSIVE {_SITED}, {mixed_ctes('sited', 'site', _SITE_TERMS, 'response', reml=True)},
{names_cte(['(Intercept)', *_SITE_TERMS])},
lines AS (SELECT s.step AS k, t.term, s.v * s.v / d.v AS ss, s2, CAST({_DEN.replace('k =', 's.step =')} AS DOUBLE) AS df
  FROM w4 s JOIN best b ON s.theta = b.theta
  JOIN w4 d ON d.theta = s.theta AND d.step = s.step AND d.i = s.step AND d.j = s.step
  JOIN names t ON t.k = s.step, vars WHERE s.step BETWEEN 1 AND 3 AND s.i = s.step AND s.j = 4)
SELECT 'response' AS response, CAST(k AS INTEGER) AS position, term, CAST(1 AS DOUBLE) AS df, df AS df_den, round(ss, 4) AS sum_sq,
       round(ss / s2, 3) AS f_value, round({t_tail('sqrt(ss / s2)', 'df')}, 5) AS p_value FROM lines
UNION ALL SELECT 'response', 4, 'Residuals', CAST(n - g - 2 AS DOUBLE), NULL, NULL, NULL, NULL FROM vars""")
def lmm_site_term_anova(spark: SparkSession, folder: str) -> DataFrame:
    table = _sited_fit(spark, folder).anova().drop("mean_sq")
    return rounded(rounded(rounded(table, "sum_sq", digits=4), "f_value", digits=3), "p_value", digits=5)


_FIRST = f"""{mixed_ctes('frame', 'site', ['stems_lag1'], 'response', False, 'a_')},
left_over AS (SELECT f.*, response - ({fixed_part(['stems_lag1'], 'a_')} + u) AS rest
              FROM frame f JOIN a_effects e ON f.site = e.site),
{mixed_ctes('left_over', 'site', ['rain'], 'rest', False, 'r_')},
{mixed_ctes('left_over', 'site', ['ln_grass'], 'rest', False, 'g_')}"""


@query(f"""WITH RECURSIVE {FRAME}, {_FIRST}
{_chain_step(1, 'response', 'a_', ['(Intercept)', 'stems_lag1'], 'frame', ['stems_lag1'])}
UNION ALL {_chain_step(2, 'first_residual', 'r_', ['(Intercept)', 'rain'], 'left_over', ['rain'])}
UNION ALL {_chain_step(3, 'first_residual', 'g_', ['(Intercept)', 'ln_grass'], 'left_over', ['ln_grass'])}""")
def residual_first_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Residuals of the density model on terms outside it."""
    chain = mixed.residual_first_chain(frame(spark, folder), "response", ["stems_lag1"], "site", ["rain", "ln_grass"])
    return rounded(chain, "estimate", "std_error", "r2_marginal", "r2_conditional")
