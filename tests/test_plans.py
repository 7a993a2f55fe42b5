import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sitepanel.plans import growth, interactions, seasons
from sitepanel.plans.rules import GROWN, PanelRules

MEASURES = ["target_weed", "other_weed", "forbs", "grass", "bare_ground", "stems", "insects"]
YEARS = range(2005, 2014)


@pytest.fixture(scope="module")
def weather(spark):
    rng = random.Random(6)
    rows, day = [], dt.date(2004, 1, 1)
    while day < dt.date(2014, 1, 1):
        for site in "abcdef":
            rows.append((site, day.year, day.month, day.day, float(rng.randrange(9)), rng.uniform(-20, 0), rng.uniform(0, 35), rng.random()))
        day += dt.timedelta(days=3)
    return spark.createDataFrame(
        rows, "site string, year int, month int, day int, pr double, tmin double, tmax double, srad double"
    )


@pytest.fixture(scope="module")
def surveys(spark):
    """Site f has four years, site e misses one year in the middle, site a has two surveys a year."""
    rng = random.Random(7)
    rows = []
    for site in "abcdef":
        for year in YEARS:
            if (site == "f" and year > 2008) or (site == "e" and year == 2009):
                continue
            for _ in range(2 if site == "a" else 1):
                rows.append((site, year, *[round(rng.uniform(0, 60), 2) for _ in MEASURES]))
    return spark.createDataFrame(rows, "site string, year int, " + ", ".join(f"{m} double" for m in MEASURES))


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame([(s, 500.0 + i, 2004, 2013) for i, s in enumerate("abcdef")], "site string, elevation double, first_year int, last_year int")


@pytest.fixture(scope="module")
def panel(weather, surveys, sites):
    return growth.growth_panel(weather, surveys, sites, MEASURES).cache()


def test_growth_panel_completes_years_and_drops_short_sites(panel, surveys):
    assert {r[0] for r in panel.select("site").distinct().collect()} == set("abcde")
    assert panel.count() == 5 * len(YEARS)
    gap = panel.where("site = 'e' and year in (2009, 2010)").orderBy("year").collect()
    assert gap[0]["stems"] is None and gap[1]["stems"] is not None and gap[1]["growth_ln_stems"] is None
    least = surveys.where("site = 'a' and year = 2006").agg(F.min("stems")).first()[0]
    assert panel.where("site = 'a' and year = 2006").first()["stems"] == least
    assert panel.where("elevation is null").count() == 0


def test_observed_lags_skip_the_gap(weather, surveys, sites):
    got = growth.growth_panel(weather, surveys, sites, MEASURES, rules=PanelRules(lag_mode="complete"))
    after = got.where("site = 'e' and year = 2010").first()
    before = got.where("site = 'e' and year = 2008").first()
    assert after["ln_stems_lag1"] == before["ln_stems"]
    assert got.where("site = 'e' and year = 2009").count() == 0


def test_collapse_rule(weather, surveys, sites):
    got = growth.growth_panel(weather, surveys, sites, MEASURES, rules=PanelRules(collapse="sum"))
    total = surveys.where("site = 'a' and year = 2007").agg(F.sum("stems")).first()[0]
    assert got.where("site = 'a' and year = 2007").first()["stems"] == pytest.approx(total)


def test_unknown_lag_mode(weather, surveys, sites):
    with pytest.raises(ValueError):
        growth.growth_panel(weather, surveys, sites, MEASURES, rules=PanelRules(lag_mode="other"))


def test_growth_models(panel):
    results = growth.growth_models(panel, {"small": ["ln_stems_lag1", "ln_grass_lag1*rain_lag1"]})
    assert {r.choice for r in results["complete_cases"].collect()} == {"small", "whole"}
    assert {r["step"] for r in results["residual_first"].collect()} == {1, 2, 3}
    assert set(results) == {"chain", "residual_first", "complete_cases", "small_coefficients", "small_anova", "small_selection", "small_average"}
    # the product needs both its factors, so 10 of the 16 subsets are allowed
    assert results["small_selection"].count() == 10
    assert {r["step"] for r in results["chain"].collect()} == {1, 2, 3, 4}
    assert results["small_average"].where("term = '(Intercept)'").first()["importance"] == pytest.approx(1.0)


def test_cover_growth_models(spark):
    rows = [(f"s{k % 9}", k // 9, *[5.0 + (k * (j + 3)) % 11 for j in range(4)], *[1.0 + (k * 5) % m for m in (13, 17, 19, 23)]) for k in range(108)]
    columns = ["site", "year", "target_weed", "other_weed", "forbs", "grass", "spring_pr", "summer_pr", "autumn_pr", "winter_pr"]
    grown = seasons.with_cover_growth(spark.createDataFrame(rows, columns), GROWN)
    results = seasons.cover_growth_models(grown, GROWN)
    assert {name: table.count() for name, table in results.items()} == {
        "growth_fits": 4, "growth_coefficients": 20, "growth_anova": 20,
        "log_growth_fits": 4, "log_growth_coefficients": 20, "log_growth_anova": 20,
    }


def test_season_frame_and_models(spark, weather, surveys, sites):
    frame = seasons.season_cover_frame(weather, surveys, sites)
    row = frame.where("site = 'b' and year = 2010").first()
    assert row["total_cover"] == pytest.approx(sum(row[c] for c in MEASURES[:5]))
    rain = weather.where("site = 'b' and year = 2010 and month in (4, 5)").agg(F.sum("pr")).first()[0]
    assert row["spring_pr"] >= rain
    results = seasons.season_models(frame, ["grass", "forbs"])
    assert results["season_coefficients"].where("response = 'grass'").count() == 5
    assert results["month_coefficients"].where("response = 'forbs'").count() == 13
    short = sites.withColumn("last_year", F.lit(2006))
    assert seasons.season_cover_frame(weather, surveys, short).count() == 0


def test_contiguous_winter_uses_the_december_before(weather, surveys, sites):
    plain = seasons.season_cover_frame(weather, surveys, sites)
    moved = seasons.season_cover_frame(weather, surveys, sites, rules=PanelRules(winter_season="contiguous"))
    key = "site = 'c' and year = 2010"
    a, b = plain.where(key).first(), moved.where(key).first()
    late = {
        y: weather.where(f"site = 'c' and year = {y} and month = 12 and day >= 21").agg(F.sum("pr")).first()[0]
        for y in (2009, 2010)
    }
    assert b["winter_pr"] == a["winter_pr"] - late[2010] + late[2009]
    assert (a["spring_pr"], a["jan_max"]) == (b["spring_pr"], b["jan_max"])


def test_cover_growth_has_one_row_less_per_site(weather, surveys, sites):
    one = surveys.where("site != 'a'")
    frame = seasons.season_cover_frame(weather, one, sites)
    grown = seasons.with_cover_growth(frame, ["grass"])
    assert grown.count() == frame.count() - frame.select("site").distinct().count()
    assert grown.where("grass_change > -92 and ln_grass_change is null").count() == 0


def test_interaction_frame_and_models(spark, weather, surveys, sites):
    releases = spark.createDataFrame([(s, y) for s in "abcdef" for y in (2001, 1999)], "site string, release_year int")
    rules = PanelRules(lag_mode="observed", rain_scale=10.0, excluded_sites=["b"])
    frame = interactions.interaction_frame(weather, surveys, sites, releases, MEASURES, rules)
    assert {r[0] for r in frame.select("site").distinct().collect()} == set("acde")
    assert frame.groupBy("site", "year").count().where("count != 12").count() == 0
    assert frame.where("years_after_release != year - 1999").count() == 0
    results = interactions.interaction_models(frame, interactions.INSECT_TERMS)
    assert {"variances", "selection", "average", "effect_ln_insects_lag1", "effect_rain_lag1"} <= set(results)
    assert results["selection"].count() == 5
    assert results["effect_rain_lag1"].count() == 50
