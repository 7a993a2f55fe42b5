"""Several responses at once against one fit each; terms of sites; residuals on other terms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitepanel.functions.numerics import falling_roots, t_two_sided
from sitepanel.operators import mixed


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(8)
    frames = []
    for g in range(40):
        n = 120 if g == 0 else int(rng.integers(2, 12))
        x, z = rng.normal(size=n), rng.normal(size=n) + 20
        made = {"site": g, "x": x, "z": z, "soil": float(g % 7)}
        for k, spread in enumerate((0.0, 0.5, 3.0)):
            made[f"y{k}"] = 1 + 0.3 * x - 0.1 * z + 0.2 * (g % 7) + spread * rng.normal() + rng.normal(size=n)
        frames.append(pd.DataFrame(made))
    return spark.createDataFrame(pd.concat(frames, ignore_index=True)).withColumn("flat", F.lit(2.5))


@pytest.mark.parametrize("reml", [False, True])
def test_each_response_equals_its_own_fit(df, reml):
    responses = ["y0", "y1", "y2"]
    fits = mixed.fit_mixed_many(df, responses, ["x*z"], "site", reml)
    for y in responses:
        alone = mixed.fit_mixed(df, y, ["x*z"], "site", reml)
        assert fits[y].theta == pytest.approx(alone.theta, rel=1e-7, abs=1e-12)
        assert fits[y].log_lik == pytest.approx(alone.log_lik, rel=1e-10)
        assert fits[y].estimates() == pytest.approx(alone.estimates(), rel=1e-7)
    assert fits.coefficients().count() == 12 and fits.summary().count() == 3
    assert fits.anova().count() == 12 and fits.r_squared().count() == 3


def test_a_constant_response_has_no_likelihood(df):
    fits = mixed.fit_mixed_many(df, ["y1", "flat"], ["x"], "site")
    assert math.isnan(fits["flat"].log_lik) and fits["flat"].theta == 0
    assert fits["y1"].log_lik == pytest.approx(mixed.fit_mixed(df, "y1", ["x"], "site").log_lik)


def test_terms_of_sites_have_their_own_degrees(df):
    fit = mixed.fit_mixed(df, "y1", ["x", "soil", "z"], "site", reml=True)
    n = df.count()
    inside, between = n - 40 - 2, 40 - 1 - 1
    rows = {r.term: r for r in fit.coefficients().collect()}
    assert {t: r.df for t, r in rows.items()} == {"(Intercept)": inside, "x": inside, "z": inside, "soil": between}
    assert rows["soil"].p_value == pytest.approx(t_two_sided(rows["soil"].t_value, between))
    lines = {r.term: r for r in fit.anova().collect()}
    assert lines["soil"].df_den == between and lines["x"].df_den == inside and lines["Residuals"].df == inside


def test_residuals_on_outside_terms(df):
    """The chain without rows equals scoring, then fitting the residual column."""
    chain = mixed.residual_first_chain(df, "y2", ["x"], "site", ["z", "soil"])
    first = mixed.fit_mixed(df, "y2", ["x"], "site")
    scored = first.score(df).withColumnRenamed("residual", "first_residual")
    for step, term in ((2, "z"), (3, "soil")):
        alone = mixed.fit_mixed(scored, "first_residual", [term], "site")
        rows = {r.term: r.estimate for r in chain.where(F.col("step") == step).collect()}
        assert rows == pytest.approx(alone.estimates(), rel=1e-6, abs=1e-9)


def test_effect_limits_are_quantiles_of_the_error(df):
    fit = mixed.fit_mixed(df, "y1", ["x", "z"], "site")
    for row in fit.effect_line("x", -1.0, 1.0, points=3, level=0.9).collect():
        assert row.upper - row.fit == pytest.approx(row.fit - row.lower)
        assert t_two_sided((row.upper - row.fit) / row.std_error, fit.df_within) == pytest.approx(0.1, abs=1e-9)


def test_falling_roots():
    c = np.array([0.5, 2.0, 3.0, -1.0, 4.0])
    roots = falling_roots(lambda which, at: c[which] - at**3, np.zeros(5), np.array([1.0, 2.0, 1.0, 1.0, 1e9]))
    assert roots[[0, 1, 4]] == pytest.approx(np.cbrt(c[[0, 1, 4]]), rel=1e-12)
    assert np.isnan(roots[[2, 3]]).all()
