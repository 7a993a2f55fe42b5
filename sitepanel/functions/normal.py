"""Inverse of the standard normal distribution as a column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A published rational approximation (relative error below 1.2e-9).
PROBIT_A = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
PROBIT_B = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
PROBIT_C = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
PROBIT_D = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
)
PROBIT_TAIL = 0.02425


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def probit(p: Column) -> Column:
    """Standard normal quantile of a probability strictly between 0 and 1."""
    q = p - 0.5
    r = q * q
    middle = _horner(PROBIT_A, r) * q / _horner(PROBIT_B, r)

    def tail(probability: Column) -> Column:
        t = F.sqrt(F.lit(-2.0) * F.ln(probability))
        return _horner(PROBIT_C, t) / _horner(PROBIT_D, t)

    return (
        F.when(p < PROBIT_TAIL, tail(p))
        .when(p > 1 - PROBIT_TAIL, -tail(1 - p))
        .otherwise(middle)
    )
