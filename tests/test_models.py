"""Models against dense matrix algebra on the same rows."""

import itertools
import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitepanel.operators import linear, mixed, selection
from sitepanel.operators.moments import PooledMoments, SizeClasses, expand_terms, model_frame, site_moments
from sitepanel.operators.subsets import SubsetTree, step, unstep
from sitepanel.plans.interactions import WIDE_TERMS

TERMS = ["x", "z", "x:z"]


@pytest.fixture(scope="module")
def data():
    """Sites of 1 to 900 rows, one of them holding a third of all rows."""
    rng = np.random.default_rng(11)
    frames = []
    for g in range(120):
        n = 1500 if g == 0 else int(rng.integers(1, 9)) if g % 4 else int(rng.integers(40, 200))
        x, z = rng.normal(size=n) + 3, rng.normal(size=n) * 4 + 50
        y = 1 + 0.4 * x - 0.2 * z + 0.03 * x * z + rng.normal() * 0.6 + rng.normal(size=n)
        frames.append(pd.DataFrame({"site": f"s{g}", "x": x, "z": z, "y": y}))
    out = pd.concat(frames, ignore_index=True)
    out["x:z"] = out.x * out.z
    return out


@pytest.fixture(scope="module")
def df(spark, data):
    holes = pd.DataFrame({"site": ["s1", "s2", "s3"], "x": [1.0, None, 2.0], "z": [2.0, 3.0, None], "y": [None, 1.0, 1.0]})
    rows = pd.concat([data[["site", "x", "z", "y"]], holes])
    rows = rows.astype(object).where(rows.notna(), None)
    return spark.createDataFrame(list(rows.itertuples(index=False, name=None)), "site string, x double, z double, y double")


def design(data, terms):
    return np.column_stack([np.ones(len(data)), *[data[t] for t in terms]])


def dense(data, terms, y, theta, reml):
    """Generalised least squares with one explicit covariance block per site."""
    X, v = design(data, terms), np.asarray(y)
    p, n = X.shape[1], len(v)
    A, c, q, L = np.zeros((p, p)), np.zeros(p), 0.0, 0.0
    for i in data.groupby("site").indices.values():
        W = np.eye(len(i)) - theta / (1 + len(i) * theta)
        A += X[i].T @ W @ X[i]
        c += X[i].T @ W @ v[i]
        q += v[i] @ W @ v[i]
        L += math.log1p(len(i) * theta)
    beta = np.linalg.solve(A, c)
    rss = q - beta @ c
    d = n - p if reml else n
    ll = -0.5 * (d * math.log(2 * math.pi * rss / d) + L + d)
    if reml:
        ll -= 0.5 * np.linalg.slogdet(A)[1]
    u = np.zeros(n)
    for i in data.groupby("site").indices.values():
        u[i] = theta / (1 + len(i) * theta) * (v[i] - X[i] @ beta).sum()
    return {"beta": beta, "A": A, "s2": rss / d, "ll": ll, "fitted": X @ beta + u}


@pytest.fixture(scope="module", params=[False, True], ids=["ml", "reml"])
def fit(request, df):
    return mixed.fit_mixed(df, "y", ["x*z"], "site", reml=request.param)


def by_term(table, column):
    return {r["term"]: r[column] for r in table.collect()}


def test_terms_expand_main_effects_first():
    assert expand_terms(["a*b", "c", "a", "b*c"]) == ["a", "b", "c", "a:b", "b:c"]


def test_linear_model_matches_lstsq(df, data):
    fit = linear.fit_linear(df, ["y"], ["x*z"])
    X = design(data, TERMS)
    beta, rss, _, _ = np.linalg.lstsq(X, data.y, rcond=None)
    got = by_term(fit.coefficients(), "estimate")
    assert list(got.values()) == pytest.approx(list(beta), rel=1e-6)
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * rss[0] / (len(data) - 4))
    assert list(by_term(fit.coefficients(), "std_error").values()) == pytest.approx(list(se), rel=1e-6)


def test_anova_adds_up_and_is_sequential(df, data):
    table = linear.fit_linear(df, ["y"], ["x*z"]).anova().collect()
    total = ((data.y - data.y.mean()) ** 2).sum()
    assert sum(r["sum_sq"] for r in table) == pytest.approx(total, rel=1e-9)
    rss = [np.linalg.lstsq(design(data, TERMS[:k]), data.y, rcond=None)[1][0] for k in range(4)]
    for k, row in enumerate(table[:3]):
        assert row["term"] == TERMS[k]
        assert row["sum_sq"] == pytest.approx(rss[k] - rss[k + 1], rel=1e-6)
    assert table[-1]["df"] == len(data) - 4


def test_many_responses_equal_single_fits(df):
    more = df.withColumn("w", F.col("y") * 2 + F.col("x"))
    both = linear.fit_linear(more, ["y", "w"], ["x", "z"]).coefficients()
    for response in ("y", "w"):
        alone = linear.fit_linear(more, [response], ["x", "z"]).coefficients()
        assert by_term(both.where(F.col("response") == response), "estimate") == pytest.approx(
            by_term(alone, "estimate"), rel=1e-9
        )


def test_dependent_and_constant_terms_are_left_out(df):
    more = df.withColumns({"twice": F.col("x") * 2, "one": F.lit(1.0)})
    table = linear.fit_linear(more, ["y"], ["x", "twice", "one", "z"]).coefficients()
    estimates = by_term(table, "estimate")
    assert estimates["twice"] is None and estimates["one"] is None
    plain = by_term(linear.fit_linear(df, ["y"], ["x", "z"]).coefficients(), "estimate")
    assert {k: v for k, v in estimates.items() if v is not None} == pytest.approx(plain, rel=1e-8)
    assert mixed.fit_mixed(more, "y", ["x", "twice", "z"], "site").terms == ["x", "z"]


def test_na_fail_raises(df):
    with pytest.raises(ValueError):
        linear.fit_linear(df, ["y"], ["x"], na="fail")


def test_mixed_fit_matches_dense_algebra(fit, data):
    want = dense(data, TERMS, data.y, fit.theta, fit.reml)
    assert list(by_term(fit.coefficients(), "estimate").values()) == pytest.approx(list(want["beta"]), rel=1e-7)
    se = np.sqrt(np.diag(np.linalg.inv(want["A"])) * want["s2"])
    assert list(by_term(fit.coefficients(), "std_error").values()) == pytest.approx(list(se), rel=1e-7)
    assert fit.log_lik == pytest.approx(want["ll"], abs=1e-7)
    assert fit.var_resid == pytest.approx(want["s2"], rel=1e-9)
    for step in (0.99, 1.01):
        assert dense(data, TERMS, data.y, fit.theta * step, fit.reml)["ll"] < want["ll"]


def test_theta_zero_is_least_squares(df):
    zero = mixed.fit_mixed(df, "y", ["x", "z"], "site", theta=0.0)
    plain = linear.fit_linear(df, ["y"], ["x", "z"])
    assert zero.estimates() == pytest.approx(plain.estimates("y"), rel=1e-9)


def test_no_site_variance_gives_theta_zero(spark):
    rows = [(g, float(i), float((-1) ** i + i)) for g in range(10) for i in range(4)]
    df = spark.createDataFrame(rows, "site int, x double, y double")
    assert mixed.fit_mixed(df, "y", ["x"], "site").theta == 0.0


def test_scores_and_r_squared(fit, df, data):
    want = dense(data, TERMS, data.y, fit.theta, fit.reml)
    scored = fit.score(df.withColumn("x:z", F.col("x") * F.col("z"))).toPandas()
    assert scored[scored[["x", "z", "y"]].isna().any(axis=1)].fitted.isna().all()
    known = scored.dropna(subset=["x", "z", "y"]).sort_values(["site", "x"])
    expected = data.assign(f=want["fitted"]).sort_values(["site", "x"])
    assert np.allclose(known.fitted, expected.f, rtol=1e-7)
    assert np.allclose(known.residual, expected.y - expected.f, atol=1e-6)
    fixed = np.var(design(data, TERMS) @ want["beta"], ddof=1)
    marginal, conditional = fit.r_squared_values()
    whole = fixed + fit.var_site + fit.var_resid
    assert marginal == pytest.approx(fixed / whole, rel=1e-7)
    assert conditional == pytest.approx((fixed + fit.var_site) / whole, rel=1e-7)


def test_scoring_in_two_parts_gives_the_same_rows(fit, df, rows):
    whole = df.withColumn("x:z", F.col("x") * F.col("z"))
    assert rows(fit.score(whole, bound=5), "site", "y", "fitted") == rows(fit.score(whole), "site", "y", "fitted")


def test_linear_residuals_are_orthogonal_to_the_design(df):
    zero = mixed.fit_mixed(df, "y", ["x", "z"], "site", theta=0.0)
    scored = zero.score(df.dropna())
    sums = scored.agg(*[F.sum(F.col("residual") * c) for c in (F.lit(1.0), F.col("x"), F.col("z"))]).first()
    assert max(abs(s) for s in sums) < 1e-5


def test_influence_matches_the_hat_matrix(df, data, fit):
    rows = df.dropna().withColumn("x:z", F.col("x") * F.col("z"))
    got = fit.influence(rows).toPandas().sort_values(["site", "x"])
    X = design(data, TERMS)
    want = dense(data, TERMS, data.y, fit.theta, fit.reml)
    inverse = np.linalg.inv(want["A"])
    h = np.zeros(len(data))
    for i in data.groupby("site").indices.values():
        k = fit.theta / (1 + len(i) * fit.theta)
        w = X[i] - k * X[i].sum(axis=0)
        h[i] = k + np.einsum("ij,jk,ik->i", w, inverse, w)
    expected = data.assign(h=h, e=data.y - want["fitted"]).sort_values(["site", "x"])
    assert np.allclose(got.leverage, expected.h, rtol=1e-6)
    cook = expected.e**2 * expected.h / (want["s2"] * 4 * (1 - expected.h) ** 2)
    assert np.allclose(got.cook, cook, rtol=1e-5)
    assert 4 < got.leverage.sum() < 4 + data.site.nunique()
    assert (got.high_leverage == (got.leverage > 8 / len(data))).all()


def test_every_subset_matches_a_direct_fit(df, data):
    frame = model_frame(df, ["y"], TERMS, keep=["site"])
    moments = site_moments(frame, "site", [*TERMS, "y"])
    table = {r["subset"]: r for r in selection.model_selection(moments, "y", TERMS).collect()}
    allowed = [s for k in range(4) for s in itertools.combinations(TERMS, k) if "x:z" not in s or len(s) == 3]
    assert len(table) == len(allowed) == 5
    for terms in allowed:
        row = table[sum(1 << TERMS.index(t) for t in terms)]
        want = dense(data, terms, data.y, row["theta"], False)
        k = len(terms) + 3
        n = len(data)
        assert row["aicc"] == pytest.approx(-2 * want["ll"] + 2 * k + 2 * k * (k + 1) / (n - k - 1), abs=1e-6)
        found = [b for b in row["estimates"] if b is not None]
        assert found == pytest.approx(list(want["beta"]), rel=1e-6)
    assert sum(r["weight"] for r in table.values()) == pytest.approx(1.0)
    assert min(r["delta"] for r in table.values()) == 0.0


def test_averages_of_all_models(df):
    terms = ["x", "z"]
    moments = site_moments(model_frame(df, ["y"], terms, keep=["site"]), "site", [*terms, "y"])
    table = selection.model_selection(moments, "y", terms, theta=0.0)
    models = table.collect()
    for row in selection.model_average(table, math.inf).collect():
        at = models[0]["terms"].index(row["term"])
        parts = [(m["weight"], m["estimates"][at], m["std_errors"][at]) for m in models]
        full = sum(w * (b or 0.0) for w, b, _ in parts)
        share = sum(w for w, b, _ in parts if b is not None)
        error = sum(w * math.hypot(se or 0.0, (b or 0.0) - full) for w, b, se in parts)
        assert (row["full_average"], row["importance"]) == pytest.approx((full, share))
        assert row["full_error"] == pytest.approx(error)
        assert row["conditional_average"] == pytest.approx(full / share)


def pooled_sample(terms, rows=900, sites=45, effects=(), seed=4):
    """Pooled moments of random terms, as the aggregates over rows would give them; products from their factors."""
    draw = np.random.default_rng(seed)
    x = {}
    for t in terms:
        x[t] = np.prod([x[f] for f in t.split(":")], axis=0) if ":" in t else draw.normal(size=rows) + 0.4 * draw.normal()
    site = draw.integers(0, sites, rows)
    y = draw.normal(size=rows) + draw.normal(size=sites)[site] * 0.7
    for t, b in zip(terms, effects):
        y = y + b * x[t]
    columns = np.column_stack([np.ones(rows), *x.values(), y])
    shift = columns.mean(axis=0)
    columns[:, 1:] -= shift[1:]
    counts = np.bincount(site, minlength=sites)
    kept = [s for s in range(sites) if counts[s]]
    blocks = [(counts[s], columns[site == s]) for s in kept]
    classes = SizeClasses(
        np.array([float(n) for n, _ in blocks]), np.ones(len(blocks)), np.array([z.T @ z for _, z in blocks]),
        np.array([np.outer(z.sum(axis=0), z.sum(axis=0)) for _, z in blocks]),
    )
    return PooledMoments([*terms, "y"], dict(zip([*terms, "y"], shift[1:].tolist())), classes)


def found(tree, branches=1):
    rows = [row for branch in tree.branches(branches) for lot in tree.search(*branch) for row in lot]
    return {row[0]: row for row in rows}


def test_allowed_subsets_match_brute_force():
    terms = expand_terms(WIDE_TERMS)
    assert len(terms) == 13
    want = set()
    for subset in range(1 << len(terms)):
        chosen = {t for j, t in enumerate(terms) if subset >> j & 1}
        if all(set(t.split(":")) <= chosen for t in chosen if ":" in t):
            want.add(subset)
    tree = SubsetTree(pooled_sample(terms), "y", terms, reml=False)
    assert {leaf.subset for b in tree.branches(40) for leaf in tree.leaves(tree.node(*b))} == want


def test_sweeps_are_undone():
    a = np.cov(np.random.default_rng(1).normal(size=(6, 50)))[None]
    assert unstep(unstep(step(step(a, 1), 3), 1), 3) == pytest.approx(a)


@pytest.mark.parametrize("theta", [None, 0.0])
@pytest.mark.parametrize("reml", [False, True])
@pytest.mark.parametrize("within", [0.5, 2.0, 9.0])
def test_bounded_search_finds_what_the_whole_search_finds(reml, theta, within):
    terms = ["a", "b", "c", "d", "e", "a:b", "c:d", "a:e"]
    for seed in (1, 2, 3):
        pooled = pooled_sample(terms, effects=(0.5, 0.1, 0.05, 0.3, 0.0, 0.08, 0.2), seed=seed)
        every = found(SubsetTree(pooled, "y", terms, reml, theta))
        best = min(row[4] for row in every.values())
        tree = SubsetTree(pooled, "y", terms, reml, theta, within)
        tree.descend()
        some = found(tree, branches=6)
        close = {s for s, row in every.items() if row[4] <= best + within}
        assert close <= set(some)
        for s in close:
            assert some[s][1:5] == pytest.approx(every[s][1:5], rel=1e-7)
        assert within > 2 or len(some) < len(every) / 2


@pytest.mark.parametrize("reml", [False, True])
def test_thirty_terms_end(reml):
    """A billion subsets: the branches without a strong term are cut where they begin."""
    mains = [f"x{j:02d}" for j in range(24)]
    terms = [*mains, *[f"{a}:{b}" for a, b in zip(mains[:6], mains[6:12])]]
    pooled = pooled_sample(terms, rows=3000, sites=60, effects=[0.6] * 22 + [0.0, 0.0] + [0.5, 0.5, 0.0, 0.0, 0.0, 0.4])
    tree = SubsetTree(pooled, "y", terms, reml, within=2.0)
    tree.descend()
    rows = found(tree, branches=8)
    best = min(rows.values(), key=lambda row: row[4])
    strong = sum(1 << j for j in [*range(22), 24, 25, 29])
    assert best[0] & strong == strong and 1 <= len(rows) <= 64


def test_wide_search_matches_direct_fits(spark, df):
    """A search with two products against one fit per subset, both variance rules."""
    terms = expand_terms(["x*z", "x*w"])
    more = df.withColumn("w", F.sin(F.col("x") * 7))
    moments = site_moments(model_frame(more, ["y"], terms, keep=["site"]), "site", [*terms, "y"])
    for reml in (False, True):
        table = selection.model_selection(moments, "y", terms, reml).collect()
        # x, z, w free: 8; with x, each product needs its other factor: 13 in all
        assert len(table) == 13
        for row in table:
            chosen = [t for j, t in enumerate(terms) if row["subset"] >> j & 1]
            alone = mixed.fit_on_moments(moments, "y", chosen, reml)
            assert (row["theta"], row["log_lik"]) == pytest.approx((alone.theta, alone.log_lik), rel=1e-9)
            found = {t: b for t, b in zip(row["terms"], row["estimates"]) if b is not None}
            assert found == pytest.approx(alone.estimates(), rel=1e-8)


def test_too_many_terms_are_refused(spark, df):
    terms = [f"t{k}" for k in range(selection.MOST_TERMS + 1)]
    wide = df.select("site", "y", *[F.sin(F.col("x") * (k + 1)).alias(t) for k, t in enumerate(terms)])
    pooled = pooled_sample(terms)
    moments = SimpleNamespace(table=wide, pooled=pooled)
    with pytest.raises(ValueError, match="at most 62"):
        selection.model_selection(moments, "y", terms)


def test_chain_matches_dense_steps(df, data):
    got = {(r["step"], r["term"]): r for r in mixed.residual_chain(df, "y", ["x", "z"], "site", "x", ["z"]).collect()}

    def best(y, terms, reml=True):
        low, high = -6.0, 3.0
        for _ in range(40):
            a, b = low + (high - low) / 3, high - (high - low) / 3
            if dense(data, terms, y, 10**a, reml)["ll"] < dense(data, terms, y, 10**b, reml)["ll"]:
                low = a
            else:
                high = b
        return dense(data, terms, y, 10 ** ((low + high) / 2), reml)

    full = best(data.y, ["x", "z"])
    base = best(full["fitted"], ["x"])
    last = best(full["fitted"] - base["fitted"], ["z"])
    for step, want, terms in ((1, full, ["x", "z"]), (2, base, ["x"]), (3, last, ["z"])):
        found = [got[step, t]["estimate"] for t in ["(Intercept)", *terms]]
        assert found == pytest.approx(list(want["beta"]), rel=1e-4, abs=1e-4)


def test_effect_line_is_linear_at_the_mean_of_the_others(fit, data):
    line = fit.effect_line("x", 0.0, 6.0, points=4).toPandas()
    b = fit.estimates()
    z, xz = data.z.mean(), data.z.mean()
    want = b["(Intercept)"] + b["x"] * line.x + b["z"] * z + b["x:z"] * line.x * xz
    assert np.allclose(line.fit, want)
    assert (line.std_error > 0).all()


def test_likelihood_grid(df, data):
    moments = site_moments(model_frame(df.dropna(), ["y"], ["x"], keep=["site"]), "site", ["x", "y"])
    grid = mixed.likelihood_grid(moments, "y", ["x"], [0.0, 0.3, 5.0])
    want = [dense(data, ["x"], data.y, t, False)["ll"] for t in (0.0, 0.3, 5.0)]
    assert [r["log_lik"] for r in grid.collect()] == pytest.approx(want, abs=1e-7)


def test_pooling_is_bounded_and_exact(spark):
    """Many distinct large row counts collapse into a few nodes with the same sums."""
    from sitepanel.operators.moments import EXACT_SIZES, NODES, SiteMoments

    sizes = spark.range(1, 3001).select(
        F.col("id").cast("string").alias("site"), F.col("id").cast("double").alias("s_0_0"),
        F.sin("id").alias("s_0_1"), F.lit(1.0).alias("s_1_1"),
    )
    classes = SiteMoments(sizes, "site", ["x"], {"x": 0.0}).pooled.classes
    assert len(classes.sizes) <= EXACT_SIZES + NODES * 6
    n = np.arange(1, 3001)
    for theta in (1e-3, 1.0, 50.0):
        want = (theta / (1 + n * theta) * np.sin(n) ** 2).sum()
        got = (theta / (1 + classes.sizes * theta) * classes.outer[:, 1, 1]).sum()
        assert got == pytest.approx(want, rel=1e-11)
        assert (classes.weights * np.log1p(classes.sizes * theta)).sum() == pytest.approx(np.log1p(n * theta).sum(), rel=1e-12)
