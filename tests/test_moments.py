"""Moments by batches against aggregates, and merged states against whole tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitepanel.operators import mixed, moments
from sitepanel.operators.moments import Scatter, ScatterTree, model_frame, site_moments, total_moments

NAMES = ["x", "z", "w", "y"]


@pytest.fixture(scope="module")
def df(spark):
    """Sites of 1 to 700 rows and rows without a site, with an offset that plain sums of squares would lose."""
    rows = spark.range(0, 6000, 1, 5).select(
        F.when(F.col("id") % 997 == 0, F.lit(None)).when(F.col("id") < 700, F.lit("hot")).otherwise(
            F.concat(F.lit("s"), (F.sqrt("id")).cast("int"))
        ).alias("site"),
        (F.sin(F.col("id") * 1.7) + 1e3).alias("x"),
        (F.cos(F.col("id") * 0.3) * 5).alias("z"),
        F.when(F.col("id") % 50 != 3, F.sin(F.col("id") * F.col("id"))).alias("w"),
    )
    return rows.withColumn("y", F.col("z") * 0.3 - F.col("w") + F.col("x") - 1e3 + F.sin(F.hash("site") % 7) + F.sin(F.xxhash64("x")))


def test_states_merge_to_the_whole():
    rows = np.random.default_rng(2).normal(size=(1000, 3)) + 1e8
    tree = ScatterTree()
    for part in np.array_split(rows, 37):
        tree.add(Scatter.of(part))
    whole, direct = tree.whole(), Scatter.of(rows)
    assert whole.n == 1000 and len(tree.held) == 6
    assert whole.mean == pytest.approx(direct.mean, rel=1e-14)
    assert whole.products == pytest.approx(direct.products, rel=1e-7, abs=1e-5)
    assert ScatterTree().whole() is None


def test_batched_totals_equal_aggregates(df, monkeypatch):
    frame = model_frame(df, [], NAMES)
    plain = total_moments(frame, NAMES)
    monkeypatch.setattr(moments, "AGGREGATED_COLUMNS", 2)
    batched = total_moments(frame, NAMES)
    assert batched.n == plain.n
    assert batched.total == pytest.approx(plain.total, rel=1e-9, abs=1e-6)
    assert batched.shift == pytest.approx(plain.shift, rel=1e-14)


@pytest.mark.parametrize("block", [50, 1 << 17])
def test_batched_sites_equal_aggregates(df, monkeypatch, block):
    frame = model_frame(df, [], NAMES, keep=["site"])
    plain = site_moments(frame, "site", NAMES)
    monkeypatch.setattr(moments, "AGGREGATED_COLUMNS", 2)
    monkeypatch.setattr(moments, "ROWS_AT_ONCE", block)
    batched = site_moments(frame, "site", NAMES)
    sums = ["site", *[f"s_0_{i}" for i in range(5)]]
    left = {r[0]: r[1:] for r in plain.table.select(*sums).collect()}
    right = {r[0]: r[1:] for r in batched.table.select(*sums).collect()}
    assert left.keys() == right.keys() and None in left
    for site in left:
        assert right[site] == pytest.approx(left[site], rel=1e-9, abs=1e-6)
    a, b = plain.pooled.classes, batched.pooled.classes
    order, other = np.argsort(a.sizes), np.argsort(b.sizes)
    assert b.sizes[other] == pytest.approx(a.sizes[order])
    assert b.weights[other] == pytest.approx(a.weights[order])
    assert b.inner[other] == pytest.approx(a.inner[order], rel=1e-8, abs=1e-5)
    assert b.outer[other] == pytest.approx(a.outer[order], rel=1e-8, abs=1e-5)
    for reml in (False, True):
        one = mixed.fit_on_moments(plain, "y", ["x", "z", "w"], reml)
        two = mixed.fit_on_moments(batched, "y", ["x", "z", "w"], reml)
        assert (two.theta, two.log_lik) == pytest.approx((one.theta, one.log_lik), rel=1e-8)
        assert two.estimates() == pytest.approx(one.estimates(), rel=1e-7)


def test_empty_frames(df, monkeypatch):
    monkeypatch.setattr(moments, "AGGREGATED_COLUMNS", 2)
    none = model_frame(df.limit(0), [], NAMES, keep=["site"])
    assert total_moments(none, NAMES).n == 0
    assert site_moments(none, "site", NAMES).table.count() == 0


def test_site_keys_keep_their_kind(df, monkeypatch):
    monkeypatch.setattr(moments, "AGGREGATED_COLUMNS", 2)
    numbered = df.withColumn("site", F.hash("site").cast("long"))
    frame = model_frame(numbered, [], NAMES, keep=["site"])
    table = site_moments(frame, "site", NAMES).table
    assert dict(table.dtypes)["site"] == "bigint"
    assert table.count() == frame.select("site").distinct().count()
