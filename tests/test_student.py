"""The quantile column against the tail function, and limits against their definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitepanel.functions.numerics import t_two_sided
from sitepanel.functions.student import t_two_sided_quantile
from sitepanel.operators import plotdata

DEGREES = [1.0, 2.0, 3.0, 4.5, 7.0, 30.0, 97.0, 1000.0, 123456.0]


@pytest.mark.parametrize("level", [0.1, 0.5, 0.9, 0.95, 0.99, 0.9999])
def test_quantile_inverts_the_tail(spark, level):
    df = spark.createDataFrame([(d,) for d in DEGREES], "df double")
    rows = df.select("df", t_two_sided_quantile(level, F.col("df")).alias("t")).collect()
    for degrees, t in rows:
        assert t_two_sided(t, degrees) == pytest.approx(1 - level, abs=1e-9)


def test_quantile_without_degrees(spark):
    df = spark.createDataFrame([(None,), (0.0,), (-3.0,), (0.9,)], "df double")
    assert {r[0] for r in df.select(t_two_sided_quantile(0.95, F.col("df"))).collect()} == {None}
    with pytest.raises(ValueError):
        t_two_sided_quantile(1.0, F.lit(3))


def test_known_values(spark):
    df = spark.createDataFrame([(1.0,), (10.0,), (120.0,), (1e9,)], "df double")
    found = [r[0] for r in df.orderBy("df").select(t_two_sided_quantile(0.95, F.col("df"))).collect()]
    assert found == pytest.approx([12.706204736, 2.228138852, 1.979930405, 1.959963987], abs=1e-8)


def test_band_per_group(spark):
    draw = np.random.default_rng(3)
    rows = [(g, float(x), float(2 * x + draw.normal())) for g, n in (("a", 30), ("b", 3), ("c", 2), ("d", 1)) for x in draw.normal(size=n)]
    frame = spark.createDataFrame(rows, "g string, x double, y double")
    band = plotdata.trend_band(plotdata.trend_line(frame, "x", "y", ["g"]), points=5).collect()
    assert sorted({r.g for r in band}) == ["a", "b", "c"]
    assert {r.g for r in band if r.lower is None} == {"c"}
    x, y = np.array([(b, c) for a, b, c in rows if a == "a"]).T
    design = np.column_stack([np.ones(30), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    sigma2 = ((y - design @ beta) ** 2).sum() / 28
    for r in (r for r in band if r.g == "a"):
        at = np.array([1.0, r.x])
        error = np.sqrt(at @ np.linalg.inv(design.T @ design) @ at * sigma2)
        assert (r.fit, r.std_error) == pytest.approx((at @ beta, error))
        assert t_two_sided((r.upper - r.fit) / r.std_error, 28) == pytest.approx(0.05, abs=1e-9)
        assert r.upper - r.fit == pytest.approx(r.fit - r.lower)
