"""Diagnostic and trend tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepanel.catalog.models import FRAME, frame
from sitepanel.catalog.modelsql import t_quantile_cte
from sitepanel.catalog.registry import GAPPY_PANEL, SITE_PANEL, gappy_panel, query, rounded, site_panel
from sitepanel.functions.normal import PROBIT_A, PROBIT_B, PROBIT_C, PROBIT_D, PROBIT_TAIL
from sitepanel.operators import linear, plotdata, reshape
from sitepanel.session import durable
from sitepanel.sources.tables import read_parquet

RESIDUALS = f"""{FRAME},
line AS (SELECT regr_slope(response, stems_lag1) AS slope, regr_intercept(response, stems_lag1) AS intercept FROM frame),
scored AS (SELECT site, year, intercept + slope * stems_lag1 AS fitted,
                  response - (intercept + slope * stems_lag1) AS residual FROM frame, line)"""


def residuals(spark: SparkSession, folder: str) -> DataFrame:
    """Residuals of a linear model of growth on density."""
    rows = frame(spark, folder)
    b = linear.fit_linear(rows, ["response"], ["stems_lag1"]).estimates("response")
    fitted = F.lit(b["(Intercept)"]) + F.lit(b["stems_lag1"]) * F.col("stems_lag1")
    scored = rows.select("site", "year", fitted.alias("fitted"), (F.col("response") - fitted).alias("residual"))
    # the figures read their input several times
    return durable(scored.where(F.col("residual").isNotNull()))


_BREAKS = f"""WITH {RESIDUALS},
ends AS (SELECT count(*) AS n, min(residual) AS lo, max(residual) AS hi FROM scored),
raw AS (SELECT *, (hi - lo) / ceil(log2(n) + 1) AS cell FROM ends),
base AS (SELECT *, pow(10.0, floor(log10(cell))) AS b FROM raw),
two AS (SELECT *, 2 * b - cell < 1.5 * (cell - b) AS is2 FROM base),
five AS (SELECT *, is2 AND 5 * b - cell < 2.75 * (cell - 2 * b) AS is5 FROM two),
ten AS (SELECT *, is5 AND 10 * b - cell < 1.5 * (cell - 5 * b) AS is10 FROM five),
widths AS (SELECT *, b * CASE WHEN is10 THEN 10 WHEN is5 THEN 5 WHEN is2 THEN 2 ELSE 1 END AS w FROM ten),
edges AS (SELECT *, floor(lo / w + 1e-7) * w AS first, CAST(ceil(hi / w - 1e-7) - floor(lo / w + 1e-7) AS INTEGER) AS bins
          FROM widths)"""


@query(f"""{_BREAKS},
bins AS (SELECT k AS bin, first + k * w AS low, first + (k + 1) * w AS high, n, w FROM edges, range(0, 200) t(k) WHERE k < bins)
SELECT CAST(bin AS INTEGER) AS bin, round(low, 6) AS low, round(high, 6) AS high, count(residual) AS count,
       round(count(residual) / (any_value(n) * any_value(w)), 6) AS density
FROM bins LEFT JOIN scored ON residual > low + 1e-7 * w AND residual <= high + 1e-7 * w
     OR (bin = 0 AND residual <= low + 1e-7 * w)
GROUP BY bin, low, high""")
def resid_hist(spark: SparkSession, folder: str) -> DataFrame:
    """Residual histogram on round break points."""
    return rounded(plotdata.histogram(residuals(spark, folder), "residual"), "low", "high", "density")


@query("""WITH bins(bin, low, high) AS (VALUES (0, 0.0, 1.0), (1, 1.0, 10.0), (2, 10.0, 25.0), (3, 25.0, 60.0)),
total AS (SELECT CAST(count(l_quantity) AS DOUBLE) AS n FROM lineitem)
SELECT CAST(bin AS INTEGER) AS bin, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, count(l_quantity) AS count,
       round(count(l_quantity) / (any_value(n) * any_value(high - low)), 9) AS density
FROM bins CROSS JOIN total LEFT JOIN lineitem ON l_quantity <= high AND (l_quantity > low OR (bin = 0 AND l_quantity = 0))
GROUP BY bin, low, high""")
def hist_given_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram on uneven breaks."""
    rows = read_parquet(spark, folder, "lineitem").select("l_quantity")
    return rounded(plotdata.histogram(rows, "l_quantity", [0, 1, 10, 25, 60]), "density", digits=9)


@query(f"""WITH {RESIDUALS} SELECT site, year, round(fitted, 6) AS fitted, round(residual, 6) AS residual FROM scored""")
def resid_vs_fitted(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(residuals(spark, folder), "fitted", "residual")


@query(f"""WITH {RESIDUALS}
SELECT CAST(floor(fitted / 0.25) AS BIGINT) AS cell_x, CAST(floor(residual / 0.25) AS BIGINT) AS cell_y, count(*) AS count
FROM scored GROUP BY 1, 2""")
def resid_vs_fitted_binned(spark: SparkSession, folder: str) -> DataFrame:
    """The same scatter as counts on a grid, for frames too long to draw."""
    return plotdata.binned_points(residuals(spark, folder), "fitted", "residual", 0.25, 0.25)


def _polynomial(coefficients: tuple[float, ...], x: str) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r})"
    return text


def _probit_sql(p: str) -> str:
    q, r = f"({p} - 0.5)", f"pow({p} - 0.5, 2)"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"""CASE WHEN {p} < {PROBIT_TAIL} THEN {_polynomial(PROBIT_C, low)} / {_polynomial(PROBIT_D, low)}
  WHEN {p} > {1 - PROBIT_TAIL} THEN -{_polynomial(PROBIT_C, high)} / {_polynomial(PROBIT_D, high)}
  ELSE {_polynomial(PROBIT_A, r)} * {q} / {_polynomial(PROBIT_B, r)} END"""


@query(f"""WITH {RESIDUALS}, ranked AS (SELECT residual, row_number() OVER (ORDER BY residual) AS k FROM scored),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM scored)
SELECT k AS position, round({_probit_sql('((k - 0.5) / n)')}, 6) AS theoretical, round(residual, 6) AS sample
FROM ranked, total""")
def resid_qq(spark: SparkSession, folder: str) -> DataFrame:
    """Quantile plot with a point per residual, ranked without one global sort."""
    return rounded(plotdata.qq_points(residuals(spark, folder), "residual"), "theoretical", "sample")


@query(f"""WITH {GAPPY_PANEL}, ranked AS (SELECT insects, row_number() OVER (ORDER BY insects) AS r FROM gappy_panel),
total AS (SELECT count(*) AS n FROM gappy_panel)
SELECT k AS position, round({_probit_sql('((k - 0.5) / 200)')}, 6) AS theoretical, insects AS sample
FROM range(1, 201) t(k), total JOIN ranked ON r = CAST(ceil((2 * k - 1) * n / 400) AS BIGINT)""")
def counts_qq(spark: SparkSession, folder: str) -> DataFrame:
    """Quantile plot at 200 positions of a column where a few values hold most rows."""
    panel = durable(gappy_panel(spark, folder).select("insects"))
    return rounded(plotdata.qq_points(panel, "insects", 200), "theoretical")


@query(f"""WITH {RESIDUALS}, quartiles AS (SELECT quantile_cont(residual, 0.25) AS q25, quantile_cont(residual, 0.75) AS q75 FROM scored)
SELECT round(q25, 6) AS q25, round(q75, 6) AS q75, round((q75 - q25) / 1.3489795003921634, 6) AS slope,
       round((q25 + q75) / 2, 6) AS intercept FROM quartiles""")
def resid_qq_line(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(plotdata.qq_line(residuals(spark, folder), "residual"), "q25", "q75", "slope", "intercept")


@query(f"""WITH {RESIDUALS},
stats AS (SELECT count(*) AS n, min(residual) AS lo, max(residual) AS hi,
                 0.9 * least(stddev_samp(residual), (quantile_cont(residual, 0.75) - quantile_cont(residual, 0.25)) / 1.34)
                     * pow(count(*), -0.2) AS bw FROM scored),
grid AS (SELECT n, bw, lo - 3 * bw AS first, (hi - lo + 6 * bw) / 511 AS step FROM stats),
placed AS (SELECT floor((residual - first) / step) AS cell, (residual - first) / step - floor((residual - first) / step) AS share
           FROM scored, grid),
masses AS (SELECT cell, sum(1 - share) AS mass FROM placed GROUP BY cell
           UNION ALL SELECT cell + 1, sum(share) FROM placed GROUP BY cell)
SELECT CAST(k AS INTEGER) AS point, round(first + k * step, 6) AS x,
       round(sum(mass * exp(-0.5 * pow((k - cell) * step / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) AS density
FROM masses, grid, range(0, 512) t(k) GROUP BY k, first, step, n, bw""")
def resid_kde(spark: SparkSession, folder: str) -> DataFrame:
    """Kernel density of the residuals on 512 points."""
    return rounded(plotdata.density(residuals(spark, folder), "residual"), "x", "density")


_TREND = """count(*) AS n, round(regr_slope({y}, {x}), 9) AS slope, round(regr_intercept({y}, {x}), 9) AS intercept,
  round(regr_r2({y}, {x}), 9) AS r_squared, min({x}) AS x_min, max({x}) AS x_max,
  round(CASE WHEN count(*) > 2 THEN sqrt(greatest(regr_syy({y}, {x}) - pow(regr_sxy({y}, {x}), 2)
    / nullif(regr_sxx({y}, {x}), 0), 0) / ((count(*) - 2) * nullif(regr_sxx({y}, {x}), 0))) END, 9) AS slope_error,
  round(regr_avgx({y}, {x}), 9) AS x_mean, round(regr_sxx({y}, {x}), 9) AS sxx,
  round(CASE WHEN count(*) > 2 THEN sqrt(greatest(regr_syy({y}, {x}) - pow(regr_sxy({y}, {x}), 2)
    / nullif(regr_sxx({y}, {x}), 0), 0) / (count(*) - 2)) END, 9) AS sigma"""


@query(f"""WITH {SITE_PANEL} SELECT {_TREND.format(x='grass', y='stems')} FROM site_panel""")
def trend_line(spark: SparkSession, folder: str) -> DataFrame:
    """Least-squares line of one measure on another."""
    return rounded(
        plotdata.trend_line(site_panel(spark, folder), "grass", "stems"),
        "slope", "intercept", "r_squared", "slope_error", "x_mean", "sxx", "sigma",
        digits=9,
    )


@query(f"""WITH {SITE_PANEL} SELECT site, {_TREND.format(x='CAST(year AS DOUBLE)', y='stems')} FROM site_panel GROUP BY site""")
def trend_by_site(spark: SparkSession, folder: str) -> DataFrame:
    """One trend line per site."""
    table = plotdata.trend_line(site_panel(spark, folder), "year", "stems", ["site"])
    return rounded(table, "slope", "intercept", "r_squared", "slope_error", "x_mean", "sxx", "sigma", digits=9)


@query(f"""WITH RECURSIVE {SITE_PANEL},
lines AS (SELECT site, {_TREND.format(x='CAST(year AS DOUBLE)', y='stems')} FROM site_panel GROUP BY site),
exact AS (SELECT site, count(*) AS n, regr_slope(stems, year) AS b, regr_intercept(stems, year) AS a, min(year) AS low,
    max(year) AS high, regr_avgx(stems, year) AS mid, regr_sxx(stems, year) AS sxx,
    sqrt(greatest(regr_syy(stems, year) - pow(regr_sxy(stems, year), 2) / regr_sxx(stems, year), 0) / (count(*) - 2)) AS sigma
  FROM site_panel GROUP BY site HAVING count(*) > 2),
points AS (SELECT e.*, CAST(k AS INTEGER) AS point, low + k * (high - low) / 19.0 AS x FROM exact e, range(0, 20) t(k)),
{t_quantile_cte('n - 2', 'exact')},
errors AS (SELECT *, a + b * x AS fit, sigma * sqrt(1.0 / n + (x - mid) ** 2 / sxx) AS error FROM points)
SELECT site, point, round(x, 4) AS x, round(fit, 4) AS fit, round(error, 4) AS std_error,
       round(fit - t * error, 4) AS lower, round(fit + t * error, 4) AS upper
FROM errors JOIN quantiles ON df = n - 2""")
def trend_band(spark: SparkSession, folder: str) -> DataFrame:
    """Points of each site's trend line with confidence limits."""
    # a site's few years in order: its sums, and so a fit on a rounding limit, don't depend on how the rows come
    panel = site_panel(spark, folder).repartition("site").sortWithinPartitions("site", "year")
    lines = plotdata.trend_line(panel, "year", "stems", ["site"])
    return rounded(plotdata.trend_band(lines, points=20), "x", "fit", "std_error", "lower", "upper", digits=4)


@query(f"""WITH {GAPPY_PANEL}
SELECT site, year, 'ln_stems' AS variable, round(ln(stems + 1), 4) AS value FROM gappy_panel
UNION ALL SELECT site, year, 'ln_insects', round(ln(insects + 1), 4) FROM gappy_panel""")
def trend_series(spark: SparkSession, folder: str) -> DataFrame:
    """Two log series per site in long form."""
    logged = gappy_panel(spark, folder).select(
        "site", "year", F.log1p("stems").alias("ln_stems"), F.log1p("insects").alias("ln_insects")
    )
    return rounded(reshape.melt(logged, ["site", "year"], ["ln_stems", "ln_insects"]), "value", digits=4)
