"""Cases that once lost rows, crashed or gave another result on a second path."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitepanel.operators import joins, linear, mixed, plotdata, reshape, selection
from sitepanel.sources import tables


def test_completion_keeps_every_row(spark, rows):
    panel = spark.createDataFrame(
        [("a", 2007, 1), ("a", 2007, 2), ("a", 2012, 3), ("a", None, 4), ("b", None, 5), ("c", 2008, 6)], "site string, year int, v int"
    )
    got = rows(reshape.complete_years(panel, "site", "year", [2007, 2008, 2009]))
    kept = [r for r in got if r[2] is not None]
    assert sorted(r[2] for r in kept) == [1, 2, 3, 4, 5, 6]
    filled = {(r[0], r[1]) for r in got if r[2] is None}
    assert filled == {("a", 2008), ("a", 2009), ("b", 2007), ("b", 2008), ("b", 2009), ("c", 2007), ("c", 2009)}


def test_histogram_uses_all_breaks(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (5.0,), (10.0,), (None,)], "x double")
    got = [tuple(r) for r in plotdata.histogram(df, "x", [0, 1, 10]).orderBy("bin").collect()]
    assert got == [(0, 0.0, 1.0, 2, 0.5), (1, 1.0, 10.0, 2, pytest.approx(2 / 36))]
    with pytest.raises(ValueError):
        plotdata.histogram(df, "x", [0, 1, 5])


def test_density_of_a_constant_column(spark):
    df = spark.createDataFrame([(4.0,)] * 7, "x double")
    table = plotdata.density(df, "x", 101).orderBy("point").collect()
    assert sum(r.density for r in table) * (table[1].x - table[0].x) == pytest.approx(1, abs=0.02)
    with pytest.raises(ValueError):
        plotdata.density(df.where("x is null"), "x")


def test_quantile_plot_unfolds_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(plotdata, "RUN", 7)
    df = spark.createDataFrame([(2.0,)] * 50 + [(1.0,), (3.0,)], "x double")
    got = plotdata.qq_points(df, "x").orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 53)) and [r["sample"] for r in got] == [1.0] + [2.0] * 50 + [3.0]


@pytest.mark.parametrize("how", joins.SPLIT_JOINS)
@pytest.mark.parametrize("bound", [1000, 10, 0])
def test_split_join_with_hot_and_missing_keys(spark, rows, monkeypatch, how, bound):
    monkeypatch.setattr(joins, "HOT_KEYS", 10)
    random.seed(1)
    fact = [(k, random.choice([1, 1, 1, None, *range(2, 60)])) for k in range(300)]
    fact = spark.createDataFrame(fact, "id int, k int")
    lookup = spark.createDataFrame([(k, f"v{k}") for k in [1, 1, *range(1, 50)]], "k int, v string")
    want = fact.join(lookup, ["k"], how)
    assert rows(joins.lookup_join(fact, lookup, ["k"], how, bound), *want.columns) == rows(want)


def test_hot_keys_by_sketch_in_any_type(spark, rows):
    fact = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("int").alias("k"))
    hot = joins.hot_hashes(fact, F.xxhash64("k"))
    assert hot == [fact.where("k = 7").select(F.xxhash64("k")).first()[0]]
    lookup = spark.range(0, 30_000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for bound in (100, 0):
        assert rows(joins.lookup_join(fact, lookup, ["k"], "inner", bound)) == rows(fact.join(lookup, ["k"]))


def test_split_join_reads_the_rows_twice_after_the_sketch(spark, tmp_path):
    path = str(tmp_path / "fact")
    spark.range(5000).select((F.col("id") % 3 * F.col("id")).alias("k"), "id").write.parquet(path)
    lookup = spark.range(200).select(F.col("id").alias("k"))
    joined = joins.lookup_join(spark.read.parquet(path), lookup, ["k"], "inner", 10)
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2


def test_split_join_refuses_other_kinds(spark):
    df = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        joins.lookup_join(df, df, ["k"], "right")


def sample(spark, response=None, n=240, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        x, z, site = float(rng.normal()), float(rng.normal()), k % 12
        y = 1 + 2 * x - z + 0.5 * x * z + (site - 6) * 0.3 + float(rng.normal()) if response is None else response(x, z, site)
        out.append((f"s{site}", k, x if k % 40 else None, z, y))
    return spark.createDataFrame(out, "site string, row int, x double, z double, y double")


def test_scoring_raw_rows_of_an_interaction_model(spark):
    df = sample(spark)
    fit = mixed.fit_mixed(df, "y", ["x*z"], "site", reml=True)
    scored = fit.score(df).collect()
    assert len(scored) == 240
    assert all((r.fitted is None) == (r.x is None) for r in scored)
    assert abs(sum(r.residual for r in scored if r.residual is not None)) < 1e-6 * 240 + 30
    assert fit.influence(df).where("leverage is not null").count() == 234


@pytest.mark.parametrize("response", [lambda x, z, s: 4.0, lambda x, z, s: 2.0 * x - z + 1])
def test_constant_and_exact_responses(spark, response):
    df = sample(spark, response)
    fit = mixed.fit_mixed(df, "y", ["x", "z"], "site")
    assert fit.theta == 0 and fit.summary().first().log_lik is None
    assert fit.anova().count() == 3 and fit.coefficients().count() == 3 and fit.r_squared().count() == 1
    frame = df.dropna()
    table = selection.model_selection(mixed.site_moments(frame, "site", ["x", "z", "y"]), "y", ["x", "z"])
    assert table.count() == 4


def test_variance_ratio_beyond_the_grid(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{k % 8}", 1e3 * (k % 8) + float(rng.normal()) * 0.1, float(rng.normal())) for k in range(160)]
    df = spark.createDataFrame(rows, "site string, y double, x double")
    fit = mixed.fit_mixed(df, "y", ["x"], "site")
    between = np.var([1e3 * k for k in range(8)])
    assert fit.theta > 1e6 and fit.var_site == pytest.approx(between, rel=0.05)


def test_sigma_rule_of_maximum_likelihood_tests(spark):
    df = sample(spark).dropna()
    fit = mixed.fit_mixed(df, "y", ["x", "z"], "site")
    plain, scaled = ({r.term: r for r in fit.anova(adjust_sigma=a, intercept=True).collect()} for a in (False, True))
    factor = fit.n / (fit.n - fit.rank)
    for term in ("(Intercept)", "x", "z"):
        assert plain[term].f_value == pytest.approx(scaled[term].f_value * factor)
    # the intercept's sum of squares, given the site effects' weights
    y = np.array([r.y for r in df.collect()])
    sites = np.array([r.site for r in df.collect()])
    w = np.zeros((len(y), len(y)))
    for s in set(sites):
        at = np.flatnonzero(sites == s)
        w[np.ix_(at, at)] = np.eye(len(at)) - fit.theta / (1 + len(at) * fit.theta)
    ones = np.ones(len(y))
    assert plain["(Intercept)"].sum_sq == pytest.approx((ones @ w @ y) ** 2 / (ones @ w @ ones), rel=1e-8)


def test_averaging_errors(spark):
    rows = [(0.6, ["a"], [1.0], [0.2]), (0.4, ["a"], [2.0], [0.3])]
    table = spark.createDataFrame([(w, 0.0, t, b, e) for w, t, b, e in rows], "weight double, delta double, terms array<string>, estimates array<double>, std_errors array<double>")
    mean = 1.4
    parts = [(0.6, 0.2**2 + (1 - mean) ** 2), (0.4, 0.3**2 + (2 - mean) ** 2)]
    assert selection.model_average(table, 2.0).first().full_error == pytest.approx(math.sqrt(sum(w * v for w, v in parts)))
    plain = selection.model_average(table, 2.0, revised=False).first().full_error
    assert plain == pytest.approx(sum(w * math.sqrt(v) for w, v in parts))


def test_nan_becomes_null_on_every_load(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), 2001), (2, 3.0, 2002)], "k int, x double, year int")
    df.write.parquet(f"{tmp_path}/t.parquet")
    tables.write_panel(df, f"{tmp_path}/panel")
    for back in (tables.read_parquet(spark, str(tmp_path), "t"), tables.read_panel(spark, f"{tmp_path}/panel")):
        assert back.agg(F.max("x"), F.count("x")).first() == (3.0, 1)


def test_missing_rows_fail_on_request(spark):
    df = sample(spark)
    with pytest.raises(ValueError):
        linear.fit_linear(df, ["y"], ["x"], na="fail")
    assert linear.fit_linear(df.dropna(), ["y"], ["x"], na="fail").coefficients().count() == 2
