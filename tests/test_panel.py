import math
import random

import pytest
from pyspark.sql import functions as F

from sitepanel.operators import joins, panel, reshape


@pytest.fixture(scope="module")
def gappy(spark):
    rng = random.Random(1)
    data = [(s, y, float(rng.randrange(50))) for s in range(20) for y in range(2007, 2016) if rng.random() < 0.7]
    return spark.createDataFrame(data, "site int, year int, stems double")


def lagged(df, **more):
    return panel.with_lags(
        df, "site", "year", logs={"stems": "ln"}, raw={"stems": "raw"}, growth=["ln"], percent={"stems": "pct"}, **more
    )


def test_first_row_of_each_site_has_no_lag(gappy):
    first = lagged(gappy).join(gappy.groupBy("site").agg(F.min("year").alias("year")), ["site", "year"])
    assert first.where("ln_lag1 is not null or raw_lag1 is not null or growth_ln is not null").count() == 0


def test_lags_match_brute_force(gappy):
    by_site = {}
    for r in gappy.collect():
        by_site.setdefault(r["site"], {})[r["year"]] = r["stems"]
    for r in lagged(gappy, depth=2).collect():
        seen = sorted(by_site[r["site"]])
        k = seen.index(r["year"])
        before = by_site[r["site"]][seen[k - 1]] if k else None
        assert r["raw_lag1"] == before
        assert r["raw_lag2"] == (by_site[r["site"]][seen[k - 2]] if k > 1 else None)
        if before is not None:
            assert r["growth_ln"] == pytest.approx(math.log(r["stems"] + 1) - math.log(before + 1))
            assert r["pct"] == pytest.approx((r["stems"] - before) / (before + 1) * 100)


def test_completed_grid(gappy, rows):
    years = reshape.observed_years(gappy)
    grid = reshape.complete_years(gappy, "site", "year", years)
    sites = [r[0] for r in gappy.select("site").distinct().collect()]
    assert grid.count() == len(sites) * len(years)
    assert rows(grid.dropna()) == rows(gappy)
    assert rows(grid, "site", "year") == sorted((s, y) for s in sites for y in years)


def test_calendar_lag_breaks_at_a_missing_year(spark, rows):
    df = spark.createDataFrame([(1, 2007, 1.0), (1, 2009, 2.0), (2, 2008, 3.0)], "site int, year int, stems double")
    got = panel.calendar_lags(df, "site", "year", [2007, 2008, 2009], raw={"stems": "raw"})
    assert rows(got.where("site = 1"), "year", "raw_lag1") == [(2007, None), (2008, 1.0), (2009, None)]


def test_both_lag_modes_agree_without_gaps(spark, rows):
    df = spark.createDataFrame([(s, y, float(s * y % 7)) for s in range(5) for y in range(2000, 2006)], "site int, year int, stems double")
    assert rows(lagged(df)) == rows(lagged(reshape.complete_years(df, "site", "year", reshape.observed_years(df))))


def test_row_order_and_partitions_do_not_matter(gappy, rows):
    assert rows(lagged(gappy)) == rows(lagged(gappy.orderBy(F.desc("stems")).repartition(7)))


def test_monitored_years_count_distinct_years_and_span_does_not(spark, rows):
    df = spark.createDataFrame(
        [("a", y) for y in range(2000, 2005)] + [("b", 2000), ("b", 2009), ("b", 2009), ("b", 2009), ("b", 2000)],
        "site string, year int",
    )
    assert rows(panel.well_monitored(df, "site", "year", 5), "site") == [("a",)]
    spans = df.groupBy("site").agg(F.min("year").alias("f"), F.max("year").alias("l"))
    assert rows(panel.keep_long_span(spans, "f", "l", 5), "site") == [("b",)]
    unique = df.distinct().withColumn("x", F.lit(1.0))
    assert rows(panel.keep_well_monitored(unique, "site", 5), "site") == [("a",)] * 5


def test_earliest_release(spark, rows):
    df = spark.createDataFrame([("a", 2005, "x"), ("a", 2003, "y"), ("a", 2003, "z"), ("b", None, "w")], "site string, year int, tag string")
    assert rows(panel.earliest_release(df, "site", "year")) == [("a", 2003), ("b", None)]
    assert rows(panel.first_row(df, "site", ["year", "tag"]), "site", "year", "tag") == [("a", 2003, "y"), ("b", None, "w")]


def test_years_after_release_reads_text(spark, rows):
    df = spark.createDataFrame([(2010, "2004"), (2010, "unknown")], "year int, release string")
    assert rows(panel.years_after(df, "year", "release"), "years_after_release") == [(6.0,), (None,)]


def test_cast_and_collapse(spark, rows):
    df = spark.createDataFrame([("a", 1, 2.0, 5.0), ("a", 1, 3.0, None), ("b", 1, 4.0, 1.0)], "site string, year int, x double, y double")
    long = reshape.melt(df, ["site", "year"], ["x", "y"])
    assert long.count() == 6
    wide = reshape.cast_wide(long, ["site", "year"], ["x", "y"], "sum")
    assert rows(wide) == rows(reshape.collapse(df, ["site", "year"], ["x", "y"], "sum")) == [("a", 1, 5.0, None), ("b", 1, 4.0, 1.0)]
    absent = reshape.cast_wide(long.where("variable = 'x' or site = 'a'"), ["site", "year"], ["x", "y"], "sum")
    assert absent.where("site = 'b'").first()["y"] is None


def test_replicates_by_prefix_and_type(spark, rows):
    df = spark.createDataFrame([(1, 1.0, 3, "note"), (2, None, None, "note")], "k int, W1 double, W2 int, W_text string")
    assert panel.numeric_columns(df, "W") == ["W1", "W2"]
    assert rows(panel.replicate_means(df, ["k"], {"w": "W"})) == [(1, 2.0), (2, None)]


def test_monitoring_matrix(spark, rows):
    df = spark.createDataFrame([("a", 2007, 1.0), ("b", 2008, None), ("b", 2030, 1.0)], "site string, year int, x double")
    got = reshape.monitoring_matrix(df, "site", "year", F.col("x"), 2007, 2008)
    assert rows(got) == [("a", 2007, 1), ("a", 2008, 0), ("b", 2007, 0), ("b", 2008, 0), ("b", 2030, 1)]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_is_the_same_by_broadcast_and_in_two_parts(spark, rows, how):
    """A third of the rows share one key; some rows have no key or no partner."""
    data = [(i % 2 * 1000 + (i if i % 3 else 0), i) for i in range(3000)] + [(None, -1)]
    fact = spark.createDataFrame(data, "k int, v int")
    lookup = spark.createDataFrame([(k, k * 2) for k in range(0, 4000, 2)], "k int, w int")
    plain = fact.join(lookup, ["k"], how)
    assert rows(joins.lookup_join(fact, lookup, ["k"], how)) == rows(plain)
    assert rows(joins.lookup_join(fact, lookup, ["k"], how, bound=10)) == rows(plain)


def test_coordinate_join_keeps_the_asked_side(spark, rows):
    taken = joins.with_coordinate_keys(
        spark.createDataFrame([(0.1 + 0.2, 1.0, 5.0), (9.0, 9.0, 6.0)], "lon double, lat double, pr double"), "lon", "lat"
    ).drop("lon", "lat")
    sites = joins.with_coordinate_keys(
        spark.createDataFrame([("a", 0.3, 1.0), ("b", 0.3, 1.0), ("c", 5.0, 5.0)], "site string, lon double, lat double"), "lon", "lat"
    ).drop("lon", "lat")
    for bound in (100, 0):
        kept = joins.coordinate_join(taken, sites, "readings", bound)
        assert rows(kept, "site", "pr") == [("a", 5.0), ("b", 5.0), (None, 6.0)]
        kept = joins.coordinate_join(taken, sites, "sites", bound)
        assert rows(kept, "site", "pr") == [("a", 5.0), ("b", 5.0), ("c", None)]


def test_drop_members_keeps_rows_without_a_key(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "site string")
    assert rows(joins.drop_members(df, "site", ["b"])) == [("a",), (None,)]
