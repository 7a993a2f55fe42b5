import random
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitepanel.functions.normal import probit
from sitepanel.functions.numerics import f_upper, incomplete_beta, pretty_breaks, sweep, t_two_sided


@pytest.mark.parametrize(
    "t, df, p",
    [(12.706204736, 1, 0.05), (2.228138852, 10, 0.05), (3.169272673, 10, 0.01), (1.959963985, 1e9, 0.05), (0.0, 5, 1.0)],
)
def test_t_tail_against_published_quantiles(t, df, p):
    assert t_two_sided(t, df) == pytest.approx(p, rel=1e-6)


@pytest.mark.parametrize("f, df1, df2, p", [(4.102821015, 2, 10, 0.05), (4.964602744, 1, 10, 0.05), (3.105875239, 5, 12, 0.05)])
def test_f_tail_against_published_quantiles(f, df1, df2, p):
    assert f_upper(f, df1, df2) == pytest.approx(p, rel=1e-5)


def test_tails_without_degrees_of_freedom():
    assert t_two_sided(1.0, 0) is None and f_upper(1.0, 1, 0) is None and t_two_sided(float("nan"), 3) is None


@settings(deadline=None, max_examples=100)
@given(st.floats(0.1, 300), st.floats(0.1, 300), st.floats(0.001, 0.999))
def test_incomplete_beta_reflects(a, b, x):
    assert incomplete_beta(a, b, x) + incomplete_beta(b, a, 1 - x) == pytest.approx(1.0, abs=1e-9)


def test_sweep_is_least_squares_and_skips_dependent_columns():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    x = np.column_stack([np.ones(60), x, x[:, 0] - 2 * x[:, 1]])
    y = rng.normal(size=(60, 2))
    z = np.column_stack([x, y])
    got = sweep(z.T @ z, 5)
    beta, rss, _, _ = np.linalg.lstsq(x[:, :4], y, rcond=None)
    assert got.kept == [0, 1, 2, 3]
    assert np.allclose(got.beta[:4], beta) and np.isnan(got.beta[4]).all()
    assert np.allclose(np.diag(got.rss), rss)
    assert np.allclose(got.inverse[:4, :4], np.linalg.inv(x[:, :4].T @ x[:, :4]))
    assert got.log_det == pytest.approx(np.linalg.slogdet(x[:, :4].T @ x[:, :4])[1])


def test_breaks_are_round_and_cover_the_data():
    assert pretty_breaks(0.0, 10.0, 5) == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0]
    assert pretty_breaks(-2.3, 2.7, 8) == [-2.5, -2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0]
    rng = random.Random(3)
    for _ in range(200):
        low = rng.uniform(-1e4, 1e4)
        high = low + 10 ** rng.uniform(-6, 6)
        breaks = pretty_breaks(low, high, rng.randrange(2, 40))
        step = breaks[1] - breaks[0]
        assert breaks[0] <= low + 1e-6 * step and breaks[-1] >= high - 1e-6 * step


def test_probit_matches_the_normal_quantile(spark):
    ps = [1e-12, 1e-6, 0.01, 0.02425, 0.1, 0.5, 0.77, 0.98, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(probit(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=2e-9, abs=1e-9)
