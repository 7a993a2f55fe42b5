"""Inverse of Student's t distribution as a column expression.

With t = sqrt(df) * tan(angle), the probability of |T| < t is the integral of
cos(angle)^(df - 1) up to the angle over the integral up to a right angle.
Both are Gauss-Legendre sums.  The share is concave in the angle, so Newton
steps from zero rise to the root without passing it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = 64
STEPS = 40
# Angles beyond this many standard deviations hold no mass that a double could show.
REACH = 12.0


def t_two_sided_quantile(level: float, df: Column) -> Column:
    """The t that |T| stays below with probability ``level``, with ``df`` degrees of freedom per row.

    NULL for degrees of freedom that are NULL or less than one.
    """
    if not 0.0 < level < 1.0:
        raise ValueError(f"a confidence level lies between 0 and 1, not at {level}")
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    rule = F.array(*[F.struct(F.lit((x + 1) / 2).alias("x"), F.lit(w / 2).alias("w")) for x, w in zip(nodes.tolist(), weights.tolist())])
    nu = F.when(df >= 1, df.cast("double"))

    def density(angle: Column) -> Column:
        # cosines of small angles are too near one for a power of them
        return F.exp((nu - 1.0) / 2.0 * F.log1p(-F.sin(angle) * F.sin(angle)))

    def integral(limit: Column) -> Column:
        return limit * F.aggregate(rule, F.lit(0.0), lambda total, node: total + node["w"] * density(limit * node["x"]))

    wanted = F.lit(level) * integral(F.least(F.lit(math.pi / 2), F.lit(REACH) / F.sqrt(nu)))
    # the whole is computed once a row and carried along with the angle
    start = F.struct(F.lit(0.0).alias("angle"), wanted.alias("wanted"))

    def newton(state: Column, _: Column) -> Column:
        angle = state["angle"]
        better = angle + (state["wanted"] - integral(angle)) / density(angle)
        return F.struct(F.least(F.greatest(better, angle), F.lit(math.pi / 2)).alias("angle"), state["wanted"].alias("wanted"))

    angle = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, newton, lambda state: state["angle"])
    return F.when(df >= 1, F.sqrt(nu) * F.tan(angle))
