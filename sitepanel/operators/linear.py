"""Linear models of one or many responses from one moment table."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sitepanel.functions.numerics import Swept, f_upper, sweep, t_two_sided
from sitepanel.operators.moments import Moments, expand_terms, model_frame, total_moments

COEFFICIENTS = (
    "response string, term string, estimate double, std_error double, "
    "df double, t_value double, p_value double"
)
ANOVA = (
    "response string, position int, term string, df double, sum_sq double, "
    "mean_sq double, f_value double, p_value double"
)
SUMMARY = (
    "response string, n double, rank int, sigma double, r_squared double, "
    "adj_r_squared double, f_value double, p_value double"
)


def _number(value: float) -> float | None:
    return float(value) if math.isfinite(value) else None


def uncentre(terms: Sequence[str], shift: dict[str, float], kept: Sequence[int]) -> np.ndarray:
    """Matrix that turns coefficients about the column means into raw ones."""
    t = np.eye(len(terms) + 1)
    for j, name in enumerate(terms, start=1):
        if j in kept:
            t[0, j] = -shift[name]
    return t


def raw_coefficients(
    swept: Swept, terms: Sequence[str], shift: dict[str, float], response: int, response_shift: float
) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and unscaled covariance on the scale of the data; NaN where aliased."""
    t = uncentre(terms, shift, swept.kept)
    filled = np.nan_to_num(swept.beta[:, response])
    beta = t @ filled
    beta[0] += response_shift
    cov = t @ np.nan_to_num(swept.inverse) @ t.T
    for j in range(len(terms) + 1):
        if j not in swept.kept:
            beta[j] = np.nan
            cov[j, :] = cov[:, j] = np.nan
    return beta, cov


@dataclass
class LinearFit:
    """Least-squares fits of several responses on the same terms."""

    spark: SparkSession
    responses: list[str]
    terms: list[str]
    moments: Moments
    swept: Swept

    @property
    def df_residual(self) -> float:
        return self.moments.n - len(self.swept.kept)

    def estimates(self, response: str) -> dict[str, float]:
        """Raw-scale coefficients by term, without aliased ones."""
        q = self.responses.index(response)
        beta, _ = raw_coefficients(
            self.swept, self.terms, self.moments.shift, q, self.moments.shift[response]
        )
        names = ["(Intercept)", *self.terms]
        return {n: float(b) for n, b in zip(names, beta) if math.isfinite(b)}

    def coefficients(self) -> DataFrame:
        rows = []
        for q, response in enumerate(self.responses):
            beta, cov = raw_coefficients(
                self.swept, self.terms, self.moments.shift, q, self.moments.shift[response]
            )
            sigma2 = self.swept.rss[q, q] / self.df_residual if self.df_residual > 0 else math.nan
            for j, term in enumerate(["(Intercept)", *self.terms]):
                se = math.sqrt(max(sigma2 * cov[j, j], 0.0)) if math.isfinite(cov[j, j] * sigma2) else math.nan
                t = beta[j] / se if se else math.nan
                rows.append(
                    (response, term, _number(beta[j]), _number(se), float(self.df_residual),
                     _number(t), t_two_sided(t, self.df_residual))
                )
        return self.spark.createDataFrame(rows, COEFFICIENTS)

    def anova(self) -> DataFrame:
        """Sequential sums of squares in term order, and the residual line."""
        rows = []
        df2 = float(self.df_residual)
        for q, response in enumerate(self.responses):
            rss = float(self.swept.rss[q, q])
            mse = rss / df2 if df2 > 0 else math.nan
            for j, term in enumerate(self.terms, start=1):
                ss = float(self.swept.drop[j, q])
                if not math.isfinite(ss):
                    continue
                f = ss / mse if mse else math.nan
                rows.append((response, j, term, 1.0, ss, ss, _number(f), f_upper(f, 1.0, df2)))
            rows.append((response, len(self.terms) + 1, "Residuals", df2, rss, _number(mse), None, None))
        return self.spark.createDataFrame(rows, ANOVA)

    def summary(self) -> DataFrame:
        rows = []
        n, df2 = float(self.moments.n), float(self.df_residual)
        rank = len(self.swept.kept)
        for q, response in enumerate(self.responses):
            rss = float(self.swept.rss[q, q])
            tss = rss + float(np.nansum(self.swept.drop[1:, q]))
            r2 = 1.0 - rss / tss if tss > 0 else math.nan
            sigma2 = rss / df2 if df2 > 0 else math.nan
            f = (tss - rss) / (rank - 1) / sigma2 if rank > 1 and sigma2 else math.nan
            adjusted = 1.0 - (1.0 - r2) * (n - 1) / df2 if df2 > 0 else math.nan
            rows.append(
                (response, n, rank, _number(math.sqrt(sigma2)) if sigma2 >= 0 else None, _number(r2),
                 _number(adjusted), _number(f), f_upper(f, rank - 1.0, df2))
            )
        return self.spark.createDataFrame(rows, SUMMARY)


def fit_linear(
    df: DataFrame, responses: Sequence[str], formula: Sequence[str], na: str = "omit"
) -> LinearFit:
    """Fit every response on the same terms in one pass over the complete cases."""
    terms = expand_terms(formula)
    frame = model_frame(df, responses, terms, na=na)
    moments = total_moments(frame, [*terms, *responses])
    return LinearFit(
        df.sparkSession, list(responses), terms, moments, sweep(moments.total, len(terms) + 1)
    )
