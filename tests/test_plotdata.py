import math

import numpy as np
import pytest

from sitepanel.operators import plotdata


@pytest.fixture(scope="module")
def values():
    """Normal values, with one value that fills a third of the rows."""
    rng = np.random.default_rng(5)
    return np.concatenate([rng.normal(size=400) * 2 + 1, np.full(200, 0.5)])


@pytest.fixture(scope="module")
def df(spark, values):
    return spark.createDataFrame([(float(v),) for v in values] + [(None,)], "r double").repartition(6)


def test_ranks_are_exact(df, values):
    got = {r["r"]: (r["count"], r["upto"]) for r in plotdata.cumulative_counts(df, "r").collect()}
    for v in np.unique(values):
        assert got[v] == ((values == v).sum(), (values <= v).sum())


def test_quantiles_interpolate(df, values):
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = plotdata.exact_quantiles(plotdata.cumulative_counts(df, "r"), "r", len(values), probabilities)
    assert got == pytest.approx(list(np.quantile(values, probabilities)))


def test_full_quantile_plot_has_every_row(df, values):
    got = plotdata.qq_points(df, "r").orderBy("position").toPandas()
    assert list(got["position"]) == list(range(1, len(values) + 1))
    assert np.array_equal(got["sample"], np.sort(values))
    assert got["theoretical"].is_monotonic_increasing


@pytest.mark.parametrize("points", [7, 50, 599])
def test_thinned_quantile_plot_takes_order_statistics(df, values, points):
    got = plotdata.qq_points(df, "r", points).orderBy("position").toPandas()
    ordered = np.sort(values)
    want = [ordered[math.ceil((2 * k - 1) * len(values) / (2 * points)) - 1] for k in range(1, points + 1)]
    assert list(got["position"]) == list(range(1, points + 1))
    assert list(got["sample"]) == want


def test_quartile_line(df, values):
    row = plotdata.qq_line(df, "r").first()
    q25, q75 = np.quantile(values, [0.25, 0.75])
    assert row["slope"] == pytest.approx((q75 - q25) / 1.3489795003921634)
    assert row["intercept"] == pytest.approx((q25 + q75) / 2)


def test_histogram_counts_right_closed_bins(df, values):
    got = plotdata.histogram(df, "r").orderBy("bin").toPandas()
    edges = [*got["low"], got["high"].iloc[-1]]
    inside = [((values > a) & (values <= b)).sum() for a, b in zip(edges, edges[1:])]
    assert list(got["count"]) == inside
    assert (got["density"] * (got["high"] - got["low"])).sum() == pytest.approx(1.0)


def test_histogram_puts_edge_values_left(spark):
    df = spark.createDataFrame([(v / 10,) for v in range(0, 11)], "r double")
    got = plotdata.histogram(df, "r", [k / 10 for k in range(0, 11, 2)]).orderBy("bin")
    assert [r["count"] for r in got.collect()] == [3, 2, 2, 2, 2]


def test_density_is_close_to_the_plain_kernel_sum(df, values):
    got = plotdata.density(df, "r").orderBy("point").toPandas()
    q25, q75 = np.quantile(values, [0.25, 0.75])
    width = 0.9 * min(values.std(ddof=1), (q75 - q25) / 1.34) * len(values) ** -0.2
    z = (got["x"].to_numpy()[:, None] - values[None, :]) / width
    plain = np.exp(-0.5 * z**2).sum(axis=1) / (len(values) * width * math.sqrt(2 * math.pi))
    assert len(got) == plotdata.DENSITY_POINTS
    assert np.abs(got["density"] - plain).max() < 2e-3 * plain.max()
    step = got["x"].iloc[1] - got["x"].iloc[0]
    assert got["density"].sum() * step == pytest.approx(1.0, abs=5e-3)


def test_trend_lines_match_polyfit(spark):
    rng = np.random.default_rng(8)
    data = [(s, float(x), float(2 * x + s + rng.normal())) for s in range(3) for x in range(8)] + [(9, 1.0, 2.0), (9, 2.0, None)]
    df = spark.createDataFrame(data, "site int, x double, y double")
    got = {r["site"]: r for r in plotdata.trend_line(df, "x", "y", ["site"]).collect()}
    for s in range(3):
        x, y = zip(*[(a, b) for k, a, b in data if k == s])
        (slope, intercept), cov = np.polyfit(x, y, 1, cov=True)
        assert (got[s]["slope"], got[s]["intercept"]) == pytest.approx((slope, intercept))
        assert got[s]["slope_error"] == pytest.approx(math.sqrt(cov[0, 0]))
        assert (got[s]["x_min"], got[s]["x_max"]) == (0.0, 7.0)
    assert got[9]["n"] == 1 and got[9]["slope"] is None and got[9]["slope_error"] is None
