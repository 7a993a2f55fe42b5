import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sitepanel.functions import calendar
from sitepanel.operators import climate


def labels(spark, days):
    df = spark.createDataFrame([(d.year, d.month, d.day) for d in days], "year int, month int, day int")
    month, late = F.col("month"), calendar.late_piece(F.col("month"), F.col("day"))
    return [
        tuple(r)
        for r in df.select(
            calendar.season(month, late),
            calendar.season_year(F.col("year"), month, late),
            calendar.season_year(F.col("year"), month, late, "contiguous"),
            calendar.water_year(F.col("year"), month),
            calendar.winter_year(F.col("year"), month),
        ).collect()
    ]


@pytest.mark.parametrize(
    "month, before, after",
    [(3, "winter", "spring"), (6, "spring", "summer"), (9, "summer", "autumn"), (12, "autumn", "winter")],
)
def test_season_edges(spark, month, before, after):
    got = labels(spark, [dt.date(2010, month, 20), dt.date(2010, month, 21)])
    assert [g[0] for g in got] == [before, after]


def test_year_labels(spark):
    days = [dt.date(2010, 4, 30), dt.date(2010, 5, 1), dt.date(2010, 10, 31), dt.date(2010, 11, 1), dt.date(2010, 12, 21)]
    got = labels(spark, days)
    assert [g[1] for g in got] == [2010] * 5
    assert [g[2] for g in got] == [2010, 2010, 2010, 2010, 2011]
    assert [g[3] for g in got] == [2010, 2011, 2011, 2011, 2011]
    assert [g[4] for g in got] == [2010, 2010, 2010, 2011, 2011]


@pytest.fixture(scope="module")
def weather():
    """Three years of days for three sites with a few missing readings and a missing month."""
    rng = random.Random(4)
    rows, day = [], dt.date(2009, 1, 1)
    while day < dt.date(2012, 1, 1):
        for site in ("a", "b", "c"):
            if site == "b" and (day.year, day.month) == (2010, 4):
                continue
            if site == "c" and (day.year, day.month) in ((2010, 1), (2010, 11), (2011, 3)):
                continue
            rain = None if rng.random() < 0.004 else float(rng.randrange(20))
            rows.append((site, day.year, day.month, day.day, rain, float(rng.randrange(-30, 30))))
        day += dt.timedelta(days=1)
    return rows


@pytest.fixture(scope="module")
def pieces(spark, weather):
    df = spark.createDataFrame(weather, "site string, year int, month int, day int, pr double, t double")
    return climate.month_pieces(df, ["site"], ["pr", "t"])


def total(values):
    return None if not values or None in values else sum(values)


def days(weather, site, first, last):
    return [r for r in weather if r[0] == site and first <= dt.date(*r[1:4]) <= last]


def test_seasons_match_brute_force(weather, pieces, rows):
    expected = []
    for site in "abc":
        for y in (2009, 2010, 2011):
            spans = {
                "winter": [((y, 1, 1), (y, 3, 20)), ((y, 12, 21), (y, 12, 31))],
                "spring": [((y, 3, 21), (y, 6, 20))],
                "summer": [((y, 6, 21), (y, 9, 20))],
                "autumn": [((y, 9, 21), (y, 12, 20))],
            }
            sums = []
            for parts in spans.values():
                inside = [r for a, b in parts for r in days(weather, site, dt.date(*a), dt.date(*b))]
                months = {(r[2], r[2] % 3 == 0 and r[3] >= 21) for r in inside}
                sums.append(total([r[4] for r in inside]) if len(months) == 4 else None)
            if None not in sums:
                expected.append((site, y, *sums))
    got = climate.seasonal_totals(pieces, ["site"], "pr")
    assert rows(got, "site", "year", "winter_pr", "spring_pr", "summer_pr", "autumn_pr") == sorted(expected)
    both = climate.season_and_maxima(pieces, ["site"], "pr", "t")
    assert rows(both.select(got.columns)) == rows(got)


def test_contiguous_seasons_add_up_to_the_whole_span(spark, weather):
    known = [r for r in weather if r[0] == "a"]
    df = spark.createDataFrame(known, "site string, year int, month int, day int, pr double, t double").fillna(1.0)
    table = climate.seasonal_totals(climate.month_pieces(df, ["site"], ["pr"]), ["site"], "pr", "contiguous")
    for row in table.collect():
        span = days(known, "a", dt.date(row["year"] - 1, 12, 21), dt.date(row["year"], 12, 20))
        whole = sum(1.0 if r[4] is None else r[4] for r in span)
        assert sum(row[f"{s}_pr"] for s in calendar.SEASONS) == whole


@pytest.mark.parametrize("shift", [True, False])
def test_winter_minimum_matches_brute_force(weather, pieces, rows, shift):
    groups = {}
    for site, y, m, _, _, t in weather:
        if m in (11, 12, 1, 2):
            year = y + 1 if shift and m >= 11 else y
            groups.setdefault((site, year), {}).setdefault(m, []).append(t)
    expected = []
    for (site, y), months in groups.items():
        if 11 in months:
            lows = [min(months[m]) if m in months else None for m in (11, 12, 1, 2)]
            expected.append((site, y, *lows, None if None in lows else min(lows)))
    got = climate.winter_minimum(pieces, ["site"], "t", shift=shift)
    key = lambda t: tuple((v is None, v) for v in t)
    assert rows(got, "site", "year", "nov", "dec", "jan", "feb", "coldest") == sorted(expected, key=key)


def test_water_year_and_the_combined_table(weather, pieces, rows):
    groups = {}
    for site, y, m, _, rain, _ in weather:
        groups.setdefault((site, y + 1 if m > 4 else y), []).append(rain)
    expected = sorted((s, y, total(v)) for (s, y), v in groups.items())
    water = climate.water_year_total(pieces, ["site"], "pr")
    assert rows(water, "site", "year", "water_year_pr") == sorted(expected, key=lambda t: (t[0], t[1]))
    cut = climate.water_year_total(pieces, ["site"], "pr", min_year=2009, max_year=2012)
    assert {r["year"] for r in cut.collect()} == {2010, 2011}
    separate = water.join(
        climate.winter_minimum(pieces, ["site"], "t").select("site", "year", "coldest"), ["site", "year"], "left"
    )
    assert rows(climate.annual_climate(pieces, ["site"], "pr", "t")) == rows(separate)


def test_year_without_january_has_no_maxima(pieces):
    years = {(r["site"], r["year"]) for r in climate.monthly_maxima(pieces, ["site"], "t").collect()}
    assert ("c", 2010) not in years and ("c", 2011) in years
    gap = climate.monthly_maxima(pieces, ["site"], "t").where("site = 'c' and year = 2011").first()
    assert gap["mar_max"] is None and gap["apr_max"] is not None


def test_reducing_before_the_coordinate_join_changes_nothing(spark, rows):
    taken = spark.createDataFrame(
        [("1", "1", 2010, 3, d, float(d)) for d in range(1, 32)] + [("2", "2", 2010, 3, 1, 5.0)],
        "lon_key string, lat_key string, year int, month int, day int, pr double",
    )
    sites = spark.createDataFrame(
        [("a", "1", "1"), ("b", "1", "1"), ("c", "9", "9")], "site string, lon_key string, lat_key string"
    )
    before = climate.monthly_totals(climate.pieces_by_site(taken, sites, ["pr"]), ["site"], "pr")
    after = climate.monthly_totals(
        climate.month_pieces(taken.join(sites, ["lon_key", "lat_key"]), ["site"], ["pr"]), ["site"], "pr"
    )
    assert rows(before) == rows(after) == [("a", 2010, 3, 496.0), ("b", 2010, 3, 496.0)]
    kept = climate.pieces_by_site(taken, sites, ["pr"], keep="sites")
    assert {r["site"] for r in kept.collect()} == {"a", "b", "c"}
    unmatched = climate.pieces_by_site(taken, sites, ["pr"], keep="readings")
    assert {r["site"] for r in unmatched.collect()} == {"a", "b", None}
