"""Random-intercept linear models from per-site moments.

With theta = site variance / residual variance, everything the likelihood needs
is a sum over sites of site moments times a function of the site's row count.
The rows are reduced once to one row per site, those to size classes, and the
profile likelihood in theta is then a small matrix computation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepanel.functions.numerics import f_upper, falling_roots, sweep, t_two_sided
from sitepanel.functions.student import t_two_sided_quantile
from sitepanel.operators.joins import BROADCAST_ROWS, lookup_join
from sitepanel.operators.linear import ANOVA, COEFFICIENTS, _number, raw_coefficients
from sitepanel.operators.moments import (
    PooledMoments,
    SiteMoments,
    SizeClasses,
    expand_terms,
    model_frame,
    site_moments,
    term_column,
)

# Search range of theta, in powers of ten, besides zero itself.
THETA_GRID = np.concatenate([[0.0], 10.0 ** np.linspace(-6.0, 6.0, 49)])
ZOOM_ROUNDS = 16
WIDEST = 1e14  # beyond it a double can't tell the site variance from the whole
EXACT = 1e-13

VARIANCES = "component string, variance double, std_dev double"
FIT = (
    "response string, method string, n double, sites double, rank int, theta double, "
    "var_site double, var_resid double, log_lik double, aicc double"
)
MIXED_ANOVA = f"{ANOVA}, df_den double"
# A term that varies less than this share inside the sites is one of the sites.
SITE_CONSTANT = 1e-9
R_SQUARED = "response string, r2_marginal double, r2_conditional double"


def pooled_grams(classes: SizeClasses, thetas: np.ndarray) -> np.ndarray:
    """Cross products with the site effect integrated out, one matrix per theta."""
    k = thetas[:, None] / (1.0 + classes.sizes[None, :] * thetas[:, None])
    return classes.total[None] - np.tensordot(k, classes.outer, axes=1)


def profile(
    classes: SizeClasses, index: Sequence[int], thetas: np.ndarray, reml: bool, grams: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Profile log-likelihood and its slope in theta, for each theta.

    ``index`` lists the constant, the terms and, last, the response.
    """
    index = list(index)
    block = np.ix_(range(len(thetas)), index, index)
    g = (pooled_grams(classes, thetas) if grams is None else grams)[block]
    slope_weight = -1.0 / (1.0 + classes.sizes[None, :] * thetas[:, None]) ** 2
    dg = np.tensordot(slope_weight, classes.outer, axes=1)[block]
    root = np.linalg.cholesky(g)
    n, p = classes.total[0, 0], len(index) - 1
    d = n - p if reml else n
    rss = root[:, -1, -1] ** 2
    log_sites = (classes.weights * np.log1p(classes.sizes * thetas[:, None])).sum(axis=1)
    d_log_sites = (classes.weights * classes.sizes / (1.0 + classes.sizes * thetas[:, None])).sum(axis=1)
    log_lik = -0.5 * (d * np.log(2 * math.pi * rss / d) + log_sites + d)
    a = g[:, :p, :p]
    beta = np.linalg.solve(a, g[:, :p, p:])[..., 0]
    contrast = np.concatenate([-beta, np.ones((len(thetas), 1))], axis=1)
    d_rss = np.einsum("ti,tij,tj->t", contrast, dg, contrast)
    slope = -0.5 * (d * d_rss / rss + d_log_sites)
    if reml:
        log_lik -= np.log(np.diagonal(root, axis1=1, axis2=2)[:, :p]).sum(axis=1)
        slope -= 0.5 * np.trace(np.linalg.solve(a, dg[:, :p, :p]), axis1=1, axis2=2)
    return log_lik, slope


def is_exact(classes: SizeClasses, index: Sequence[int]) -> bool:
    """Whether the terms leave nothing of the response, as with a constant one; no likelihood exists then."""
    gram = classes.total[np.ix_(index, index)]
    return not sweep(gram, len(index) - 1).rss[0, 0] > EXACT * gram[-1, -1]


def best_theta(
    classes: SizeClasses, index: Sequence[int], reml: bool, grams: np.ndarray | None = None
) -> tuple[float, float]:
    """Maximise the profile likelihood: a grid that includes zero, then the root of the slope."""
    if is_exact(classes, index):
        return 0.0, math.nan
    log_lik, slope = profile(classes, index, THETA_GRID, reml, grams)
    best = int(np.argmax(log_lik))
    low = THETA_GRID[best] if slope[best] > 0 else THETA_GRID[max(best - 1, 0)]
    high = THETA_GRID[best] if slope[best] <= 0 else THETA_GRID[min(best + 1, len(THETA_GRID) - 1)]
    if low == high and low > 0:
        # still rising at the end of the grid: widen until the slope turns
        while high < WIDEST and profile(classes, index, np.array([high]), reml)[1][0] > 0:
            low, high = high, high * 100.0
    if low == high:
        return float(low), float(log_lik[best])
    for _ in range(ZOOM_ROUNDS):
        points = np.linspace(low, high, 9)
        _, slopes = profile(classes, index, points, reml)
        rising = int(np.sum(np.cumprod(slopes > 0)))
        low, high = points[max(rising - 1, 0)], points[min(rising, 8)]
        if high - low <= 1e-14 * high:
            break
    theta = 0.5 * (low + high)
    return float(theta), float(profile(classes, index, np.array([theta]), reml)[0][0])


@dataclass
class MixedFit:
    """A fitted random-intercept model.

    ``site_table`` holds the per-site moments that row-level results need.
    """

    spark: SparkSession
    moments: PooledMoments
    response: str
    terms: list[str]
    reml: bool
    theta: float
    log_lik: float
    site_table: SiteMoments | None = None

    def __post_init__(self):
        index = [0, *[self.moments.index(t) for t in self.terms], self.moments.index(self.response)]
        classes = self.moments.classes
        gram = pooled_grams(classes, np.array([self.theta]))[0][np.ix_(index, index)]
        self.swept = sweep(gram, len(index) - 1)
        self._sum_of_weights, self._sum_of_response = float(gram[0, 0]), float(gram[0, -1])
        self.n = float(round(classes.total[0, 0]))
        self.sites = float(round(classes.weights.sum()))
        self.rank = len(self.swept.kept)
        self.var_resid = max(0.0, float(self.swept.rss[0, 0])) / (self.n - self.rank if self.reml else self.n)
        self.var_site = self.theta * self.var_resid
        self._total = classes.total[np.ix_(index, index)]
        self._centred = np.nan_to_num(self.swept.beta[:, 0])

        # what of each term varies inside the sites, from the moments of rows and of site sums
        places = [self.moments.index(t) for t in self.terms]
        rows = np.array([classes.total[j, j] for j in places])
        between = np.array([(classes.outer[:, j, j] / classes.sizes).sum() for j in places])
        self.of_sites = [
            bool(r - b <= SITE_CONSTANT * r) and j + 1 in self.swept.kept
            for j, (r, b) in enumerate(zip(rows, between))
        ]

    @property
    def df_within(self) -> float:
        """Denominator degrees of freedom of the intercept and of terms that vary inside sites."""
        return self.n - self.sites - (self.rank - 1 - sum(self.of_sites))

    @property
    def df_between(self) -> float:
        """Denominator degrees of freedom of terms that are constant within every site."""
        return self.sites - 1.0 - sum(self.of_sites)

    def df_of(self, j: int) -> float:
        """Denominator degrees of freedom of the coefficient at place ``j``, the intercept first."""
        return self.df_between if j and self.of_sites[j - 1] else self.df_within

    def raw(self) -> tuple[np.ndarray, np.ndarray]:
        shift = self.moments.shift
        beta, cov = raw_coefficients(self.swept, self.terms, shift, 0, shift[self.response])
        return beta, cov * self.var_resid

    def estimates(self) -> dict[str, float]:
        beta, _ = self.raw()
        return {n: float(b) for n, b in zip(["(Intercept)", *self.terms], beta) if math.isfinite(b)}

    def coefficients(self, adjust_sigma: bool = False) -> DataFrame:
        """Fixed effects; ``adjust_sigma`` rescales maximum-likelihood errors by n/(n-p)."""
        return self.spark.createDataFrame(self.coefficient_rows(adjust_sigma), COEFFICIENTS)

    def coefficient_rows(self, adjust_sigma: bool = False) -> list[tuple]:
        beta, cov = self.raw()
        factor = self.n / (self.n - self.rank) if adjust_sigma and not self.reml else 1.0
        rows = []
        for j, term in enumerate(["(Intercept)", *self.terms]):
            se = math.sqrt(cov[j, j] * factor) if math.isfinite(cov[j, j]) else math.nan
            t = beta[j] / se if se else math.nan
            rows.append(
                (self.response, term, _number(beta[j]), _number(se), self.df_of(j), _number(t),
                 t_two_sided(t, self.df_of(j)))
            )
        return rows

    def anova(self, adjust_sigma: bool = False, intercept: bool = False) -> DataFrame:
        """Sequential tests in term order, given the estimated variance ratio.

        ``adjust_sigma`` divides by the residual variance rescaled by n/(n-p), as
        is usual for single maximum-likelihood fits; ``intercept`` adds its line.
        ``df_den`` are the denominator degrees of freedom, those of the sites for
        terms that are constant within every site.
        """
        return self.spark.createDataFrame(self.anova_rows(adjust_sigma, intercept), MIXED_ANOVA)

    def anova_rows(self, adjust_sigma: bool = False, intercept: bool = False) -> list[tuple]:
        factor = self.n / (self.n - self.rank) if adjust_sigma and not self.reml else 1.0
        residual = self.var_resid * factor
        rows = []
        if intercept:
            level = self._sum_of_response / self._sum_of_weights + self.moments.shift[self.response]
            ss = float(self._sum_of_weights * level**2)
            f = ss / residual if residual else math.nan
            rows.append((self.response, 0, "(Intercept)", 1.0, ss, ss, _number(f), f_upper(f, 1.0, self.df_within), self.df_within))
        for j, term in enumerate(self.terms, start=1):
            ss = float(self.swept.drop[j, 0])
            if not math.isfinite(ss):
                continue
            f = ss / residual if residual else math.nan
            df = self.df_of(j)
            rows.append((self.response, j, term, 1.0, ss, ss, _number(f), f_upper(f, 1.0, df), df))
        rows.append(
            (self.response, len(self.terms) + 1, "Residuals", self.df_within, None, residual, None, None, None)
        )
        return rows

    def variances(self) -> DataFrame:
        rows = [
            ("site", self.var_site, math.sqrt(self.var_site)),
            ("residual", self.var_resid, math.sqrt(self.var_resid)),
        ]
        return self.spark.createDataFrame(rows, VARIANCES)

    def summary(self) -> DataFrame:
        return self.spark.createDataFrame([self.summary_row()], FIT)

    def summary_row(self) -> tuple:
        k = self.rank + 2
        aicc = aicc_of(self.log_lik, k, self.n)
        return (
            self.response, "REML" if self.reml else "ML", self.n, self.sites, self.rank, self.theta,
            self.var_site, self.var_resid, _number(self.log_lik), _number(aicc),
        )

    def r_squared_values(self) -> tuple[float, float]:
        fixed = float(self._centred[1:] @ self._total[1:-1, 1:-1] @ self._centred[1:])
        spread = self._total[0, 1:-1] @ self._centred[1:]
        var_fixed = (fixed - spread**2 / self.n) / (self.n - 1)
        whole = var_fixed + self.var_site + self.var_resid
        if not whole > 0:
            return math.nan, math.nan
        return float(var_fixed / whole), float((var_fixed + self.var_site) / whole)

    def r_squared(self) -> DataFrame:
        return self.spark.createDataFrame([(self.response, *map(_number, self.r_squared_values()))], R_SQUARED)

    # Row-level results ------------------------------------------------------

    def _sites(self) -> SiteMoments:
        if self.site_table is None:
            raise ValueError("this fit has no site table: fit it with fit_mixed")
        return self.site_table

    def shrinkage(self) -> Column:
        """theta / (1 + rows * theta) of a site."""
        return F.lit(self.theta) / (F.lit(1.0) + self._sites().rows * F.lit(self.theta))

    def site_effect(self) -> Column:
        """Predicted intercept of a site, from its moments."""
        sums = self._sites()
        total = sums.total_of(self.response) - F.lit(float(self._centred[0])) * sums.rows
        for j, term in enumerate(self.terms, start=1):
            total = total - F.lit(float(self._centred[j])) * sums.total_of(term)
        return self.shrinkage() * total

    def site_effects(self) -> DataFrame:
        sums = self._sites()
        return sums.table.select(
            sums.site, sums.rows.alias("rows"), self.site_effect().alias("site_effect")
        )

    def fixed_part(self) -> Column:
        """Prediction without the site effect, from the term columns."""
        estimates = self.estimates()
        value = F.lit(estimates["(Intercept)"])
        for term in self.terms:
            if term in estimates:
                value = value + F.lit(estimates[term]) * term_column(term)
        return value

    def with_fitted(self, fitted: str, residual: str) -> PooledMoments:
        """The moments extended by this model's fitted values and residuals as columns."""
        size = len(self.moments.names) + 1
        fixed, left = np.zeros(size), np.zeros(size)
        for j, term in enumerate(self.terms, start=1):
            fixed[self.moments.index(term)] = self._centred[j]
        # what the fixed part leaves of the response, which the site effect shrinks
        left -= fixed
        left[0] -= self._centred[0]
        left[self.moments.index(self.response)] += 1.0
        level = self.moments.shift[self.response] + float(self._centred[0])
        extended = self.moments.derive(fitted, fixed, left, self.theta, level)
        return extended.derive(
            residual, np.append(left, 0.0), np.append(-left, 0.0), self.theta, 0.0
        )

    def score(self, rows: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
        """Add fitted values and residuals; rows that could not be used keep NULL."""
        scored = lookup_join(
            rows, self.site_effects().drop("rows"), [self._sites().site], "left", bound
        )
        fitted = F.when(
            F.col(f"`{self.response}`").isNotNull(), self.fixed_part() + F.col("site_effect")
        )
        return scored.withColumn("fitted", fitted).withColumn(
            "residual", F.col(f"`{self.response}`") - F.col("fitted")
        )

    def influence(self, rows: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
        """Leverage and Cook's distance per row, and whether leverage exceeds 2p/n."""
        names = ["_const", *self.terms]
        sums = self._sites()
        lookup = sums.table.select(
            sums.site,
            self.site_effect().alias("site_effect"),
            self.shrinkage().alias("_k"),
            sums.rows.alias("_sum0"),
            *[sums.total_of(t).alias(f"_sum{j}") for j, t in enumerate(self.terms, start=1)],
        )
        scored = lookup_join(rows, lookup, [sums.site], "left", bound)
        shift = self.moments.shift
        w = [F.lit(1.0) - F.col("_k") * F.col("_sum0")]
        w += [
            term_column(t) - F.lit(shift[t]) - F.col("_k") * F.col(f"_sum{j}")
            for j, t in enumerate(self.terms, start=1)
        ]
        inverse = np.nan_to_num(self.swept.inverse)
        scored = scored.withColumns({f"_w{j}": value for j, value in enumerate(w)})
        leverage = F.col("_k")
        for i in range(len(names)):
            for j in range(i, len(names)):
                weight = float(inverse[i, j]) * (1.0 if i == j else 2.0)
                leverage = leverage + F.lit(weight) * F.col(f"_w{i}") * F.col(f"_w{j}")
        fitted = self.fixed_part() + F.col("site_effect")
        scored = scored.withColumns(
            {"leverage": leverage, "residual": F.col(f"`{self.response}`") - fitted}
        )
        cook = F.try_divide(
            F.col("residual") * F.col("residual") * F.col("leverage"),
            F.lit(self.var_resid * self.rank) * (1.0 - F.col("leverage")) * (1.0 - F.col("leverage")),
        )
        return scored.select(
            *rows.columns,
            "residual",
            "leverage",
            cook.alias("cook"),
            (F.col("leverage") > 2.0 * self.rank / self.n).alias("high_leverage"),
        )

    def effect_line(self, term: str, low: float, high: float, points: int = 50, level: float = 0.95) -> DataFrame:
        """Prediction, standard error and confidence limits along one column, the other columns at their mean.

        Interactions that contain the column move with it.
        """
        beta, cov = self.raw()
        shift = self.moments.shift
        step = (high - low) / (points - 1)
        grid = self.spark.range(points).select((F.lit(low) + F.col("id") * F.lit(step)).alias(term))
        x = F.col(f"`{term}`")
        values: list[Column] = [F.lit(1.0)]
        for t in self.terms:
            factors = t.split(":")
            if term in factors:
                value = x
                for other in factors:
                    if other != term:
                        value = value * F.lit(shift[other])
            else:
                value = F.lit(math.prod(shift[f] for f in factors) if len(factors) > 1 else shift[t])
            values.append(value)
        beta, cov = np.nan_to_num(beta), np.nan_to_num(cov)
        fit = F.lit(0.0)
        variance = F.lit(0.0)
        for i, a in enumerate(values):
            fit = fit + F.lit(float(beta[i])) * a
            for j, b in enumerate(values):
                variance = variance + F.lit(float(cov[i, j])) * a * b
        line = grid.select(term, fit.alias("fit"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std_error"))
        # the degrees of freedom are one number here: its quantile is computed once, not per point
        quantile = self.spark.range(1).select(t_two_sided_quantile(level, F.lit(self.df_within))).first()[0]
        half = F.lit(quantile).cast("double") * F.col("std_error")
        return line.withColumns({"lower": F.col("fit") - half, "upper": F.col("fit") + half})


def aicc_of(log_lik: float, k: int, n: float) -> float:
    if n - k - 1 <= 0:
        return math.nan
    return -2.0 * log_lik + 2.0 * k + 2.0 * k * (k + 1) / (n - k - 1)


def independent_terms(moments: PooledMoments, terms: Sequence[str]) -> list[str]:
    """Terms that are not linear combinations of earlier ones."""
    index = [0, *[moments.index(t) for t in terms]]
    kept = sweep(moments.classes.total[np.ix_(index, index)], len(index)).kept
    return [t for j, t in enumerate(terms, start=1) if j in kept]


def fit_pooled(
    spark: SparkSession,
    moments: PooledMoments,
    response: str,
    terms: Sequence[str],
    reml: bool = False,
    theta: float | None = None,
    site_table: SiteMoments | None = None,
) -> MixedFit:
    """Fit from pooled moments; a given ``theta`` is used as it is (zero: least squares).

    Terms that depend on earlier ones are left out.
    """
    terms = independent_terms(moments, terms)
    index = [0, *[moments.index(t) for t in terms], moments.index(response)]
    classes = moments.classes
    if theta is None:
        theta, log_lik = best_theta(classes, index, reml)
    elif is_exact(classes, index):
        log_lik = math.nan
    else:
        log_lik = float(profile(classes, index, np.array([theta]), reml)[0][0])
    return MixedFit(spark, moments, response, terms, reml, theta, log_lik, site_table)


def fit_on_moments(
    moments: SiteMoments,
    response: str,
    terms: Sequence[str],
    reml: bool = False,
    theta: float | None = None,
) -> MixedFit:
    """Fit from existing site moments."""
    spark = moments.table.sparkSession
    return fit_pooled(spark, moments.pooled, response, terms, reml, theta, moments)


def fit_mixed(
    df: DataFrame,
    response: str,
    formula: Sequence[str],
    site: str,
    reml: bool = False,
    theta: float | None = None,
    na: str = "omit",
) -> MixedFit:
    """Fit response ~ formula with a random intercept per site."""
    terms = expand_terms(formula)
    frame = model_frame(df, [response], terms, keep=[site], na=na)
    moments = site_moments(frame, site, [*terms, response])
    return fit_on_moments(moments, response, terms, reml, theta)


def best_thetas(classes: SizeClasses, index: Sequence[int], targets: Sequence[int], reml: bool) -> tuple[np.ndarray, np.ndarray]:
    """Variance ratio and log-likelihood of each response in ``targets`` on the same terms, all in one search.

    The terms are eliminated once for a set of ratios; the responses are then a
    vector.  ``index`` lists the constant and the terms.
    """
    index, targets = list(index), list(targets)
    p, n = len(index), classes.total[0, 0]
    d = n - p if reml else n
    total = classes.total[np.ix_(targets, targets)].diagonal()

    def at(thetas: np.ndarray, which: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods and slopes; of all responses at every ratio, or of response ``which[k]`` at the k-th."""
        columns = [*index, *targets]
        g = pooled_grams(classes, thetas)[np.ix_(range(len(thetas)), columns, columns)]
        weight = -1.0 / (1.0 + classes.sizes[None, :] * thetas[:, None]) ** 2
        dg = np.tensordot(weight, classes.outer, axes=1)[np.ix_(range(len(thetas)), columns, columns)]
        a, cross = g[:, :p, :p], g[:, :p, p:]
        own = np.diagonal(g[:, p:, p:], axis1=1, axis2=2)
        d_own = np.diagonal(dg[:, p:, p:], axis1=1, axis2=2)
        d_cross = dg[:, :p, p:]
        if which is not None:
            rows = np.arange(len(thetas))
            cross, d_cross = cross[rows, :, which][..., None], d_cross[rows, :, which][..., None]
            own, d_own = own[rows, which][:, None], d_own[rows, which][:, None]
        beta = np.linalg.solve(a, cross)
        rss = own - np.einsum("tiq,tiq->tq", beta, cross)
        d_rss = d_own - 2 * np.einsum("tiq,tiq->tq", beta, d_cross) + np.einsum("tiq,tij,tjq->tq", beta, dg[:, :p, :p], beta)
        log_sites = (classes.weights * np.log1p(classes.sizes * thetas[:, None])).sum(axis=1)[:, None]
        d_sites = (classes.weights * classes.sizes / (1.0 + classes.sizes * thetas[:, None])).sum(axis=1)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            log_lik = -0.5 * (d * np.log(2 * math.pi * rss / d) + log_sites + d)
            slope = -0.5 * (d * d_rss / rss + d_sites)
        if reml:
            log_lik = log_lik - 0.5 * np.linalg.slogdet(a)[1][:, None]
            slope = slope - 0.5 * np.trace(np.linalg.solve(a, dg[:, :p, :p]), axis1=1, axis2=2)[:, None]
        return log_lik, slope

    exact = np.array([is_exact(classes, [*index, t]) for t in targets])
    log_lik, slope = at(THETA_GRID, None)
    log_lik = np.where(exact[None, :] | ~np.isfinite(log_lik), -math.inf, log_lik)
    start = np.argmax(log_lik, axis=0)
    rising = slope[start, np.arange(len(targets))] > 0
    last = len(THETA_GRID) - 1
    low = np.where(rising, THETA_GRID[start], THETA_GRID[np.maximum(start - 1, 0)])
    high = np.where(rising, THETA_GRID[np.minimum(start + 1, last)], THETA_GRID[start])
    for q in np.flatnonzero(rising & (start == last) & ~exact):
        while high[q] < WIDEST and at(high[[q]], np.array([q]))[1][0, 0] > 0:
            low[q], high[q] = high[q], high[q] * 100.0
    live = np.flatnonzero(~exact)
    theta = np.where(exact, 0.0, THETA_GRID[start])
    if len(live):
        root = falling_roots(lambda which, points: at(points, live[which])[1][:, 0], low[live], high[live])
        theta[live] = np.where(np.isnan(root), theta[live], root)
    best = at(theta, np.arange(len(targets)))[0][:, 0]
    return theta, np.where(exact | ~(total > 0), math.nan, best)


@dataclass
class MixedFits:
    """Random-intercept models of several responses on the same terms."""

    fits: list[MixedFit]

    def __getitem__(self, response: str) -> MixedFit:
        return next(f for f in self.fits if f.response == response)

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.fits[0].spark.createDataFrame(rows, schema)

    def coefficients(self, adjust_sigma: bool = False) -> DataFrame:
        return self._table([row for f in self.fits for row in f.coefficient_rows(adjust_sigma)], COEFFICIENTS)

    def anova(self, adjust_sigma: bool = False, intercept: bool = False) -> DataFrame:
        return self._table([row for f in self.fits for row in f.anova_rows(adjust_sigma, intercept)], MIXED_ANOVA)

    def summary(self) -> DataFrame:
        return self._table([f.summary_row() for f in self.fits], FIT)

    def r_squared(self) -> DataFrame:
        return self._table([(f.response, *map(_number, f.r_squared_values())) for f in self.fits], R_SQUARED)


def fit_mixed_many(
    df: DataFrame, responses: Sequence[str], formula: Sequence[str], site: str, reml: bool = False, na: str = "omit"
) -> MixedFits:
    """Fit every response on the same terms with a random intercept per site, from one pass over the complete cases."""
    terms = expand_terms(formula)
    frame = model_frame(df, responses, terms, keep=[site], na=na)
    table = site_moments(frame, site, [*terms, *responses])
    pooled, spark = table.pooled, df.sparkSession
    kept = independent_terms(pooled, terms)
    thetas, log_liks = best_thetas(
        pooled.classes, [0, *[pooled.index(t) for t in kept]], [pooled.index(r) for r in responses], reml
    )
    return MixedFits(
        [MixedFit(spark, pooled, r, kept, reml, float(t), float(v), table) for r, t, v in zip(responses, thetas, log_liks)]
    )


def likelihood_grid(
    moments: SiteMoments, response: str, terms: Sequence[str], thetas: Sequence[float], reml: bool = False
) -> DataFrame:
    """Profile log-likelihood at given variance ratios."""
    pooled = moments.pooled
    index = [0, *[pooled.index(t) for t in terms], pooled.index(response)]
    log_lik, _ = profile(pooled.classes, index, np.array(thetas, dtype=float), reml)
    return moments.table.sparkSession.createDataFrame(
        [(float(t), float(v)) for t, v in zip(thetas, log_lik)], "theta double, log_lik double"
    )


CHAIN = (
    "step int, response string, term string, estimate double, std_error double, "
    "r2_marginal double, r2_conditional double"
)


def _chain_rows(steps: Sequence[MixedFit]) -> list[tuple]:
    rows = []
    for number, fit in enumerate(steps, start=1):
        beta, cov = fit.raw()
        marginal, conditional = fit.r_squared_values()
        for j, term in enumerate(["(Intercept)", *fit.terms]):
            rows.append(
                (number, fit.response, term, _number(beta[j]), _number(math.sqrt(cov[j, j])),
                 marginal, conditional)
            )
    return rows


def residual_first_chain(
    df: DataFrame, response: str, formula: Sequence[str], site: str, others: Sequence[str], reml: bool = False
) -> DataFrame:
    """Residuals of a first model, site effect included, regressed on terms outside it.

    Every step is a random-intercept fit on the complete cases of all columns.
    The residuals' moments follow from the pooled ones, so no residual is
    computed for a row and the rows are read once.
    """
    spark = df.sparkSession
    terms = expand_terms(formula)
    columns = list(dict.fromkeys([*terms, *others]))
    frame = model_frame(df, [response], columns, keep=[site])
    moments = site_moments(frame, site, [*columns, response]).pooled
    first = fit_pooled(spark, moments, response, terms, reml)
    left = first.with_fitted("first_fitted", "first_residual")
    steps = [first, *[fit_pooled(spark, left, "first_residual", [term], reml) for term in others]]
    return spark.createDataFrame(_chain_rows(steps), CHAIN)


def residual_chain(
    df: DataFrame,
    response: str,
    formula: Sequence[str],
    site: str,
    density: str,
    others: Sequence[str],
    reml: bool = True,
) -> DataFrame:
    """Partial-residual analysis.

    Fit the full model, regress its fitted values on the density term, then
    regress what is left on each other term.  Every step is a random-intercept
    fit on the same complete cases; each one derives its moments from the pooled
    ones, so the rows are read once however long the chain is.
    """
    spark = df.sparkSession
    terms = expand_terms(formula)
    columns = list(dict.fromkeys([*terms, density, *others]))
    frame = model_frame(df, [response], columns, keep=[site])
    moments = site_moments(frame, site, [*columns, response]).pooled
    full = fit_pooled(spark, moments, response, terms, reml)
    fitted = full.with_fitted("full_fitted", "full_residual")
    base = fit_pooled(spark, fitted, "full_fitted", [density], reml)
    left = base.with_fitted("density_fitted", "density_residual")
    steps = [full, base]
    steps += [fit_pooled(spark, left, "density_residual", [term], reml) for term in others]
    return spark.createDataFrame(_chain_rows(steps), CHAIN)
