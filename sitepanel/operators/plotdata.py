"""The tables behind the figures: histograms, quantile plots, densities, trend lines."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist, median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitepanel.functions.normal import probit
from sitepanel.functions.numerics import pretty_breaks
from sitepanel.functions.student import t_two_sided_quantile
from sitepanel.session import durable

DENSITY_POINTS = 512
RUN = 100_000  # positions of one value that are unfolded together


def histogram(df: DataFrame, column: str, breaks: Sequence[float] | None = None) -> DataFrame:
    """Counts and densities of right-closed bins, empty bins included.

    Without ``breaks`` about log2(n) + 1 bins on round numbers are used.  Given
    breaks may be uneven and must span the values.
    """
    x = F.col(column)
    n, low, high = df.agg(F.count(x), F.min(x), F.max(x)).first()
    if breaks is None:
        if not n:
            raise ValueError(f"no values in {column!r}")
        breaks = pretty_breaks(low, high, math.ceil(math.log2(n) + 1))
    breaks = sorted(float(b) for b in breaks)
    widths = [b - a for a, b in zip(breaks, breaks[1:])]
    # a value within 1e-7 of the median bin width above an edge counts as on the edge
    fuzz = 1e-7 * median(widths)
    if n and (low < breaks[0] - fuzz or high > breaks[-1] + fuzz):
        raise ValueError(f"the breaks don't span {column!r}: {low} to {high}")
    inner = F.array(*[F.lit(b + fuzz) for b in breaks[1:-1]]).cast("array<double>")
    counts = (
        df.where(x.isNotNull())
        .groupBy(F.size(F.filter(inner, lambda b: b < x)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    edges = df.sparkSession.createDataFrame(
        [(k, breaks[k], breaks[k + 1], w) for k, w in enumerate(widths)], "bin int, low double, high double, _width double"
    )
    count = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    return edges.join(counts, "bin", "left").select(
        "bin", "low", "high", count.alias("count"), F.try_divide(count.cast("double"), F.lit(float(n)) * F.col("_width")).alias("density")
    )


def cumulative_counts(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value with its count and the number of rows up to it, exactly.

    Values are first counted, so a value that fills a third of the rows is one
    row from then on.  They are then range-partitioned; a running total inside
    each range plus the totals of the ranges before it gives global ranks
    without a window over everything.
    """
    spark = df.sparkSession
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    ranged = durable(
        counted.repartitionByRange(F.col(column)).withColumn("_part", F.spark_partition_id())
    )
    # one row per shuffle partition
    totals = sorted(ranged.groupBy("_part").agg(F.sum("count")).collect())
    offsets, before = [], 0
    for part, total in totals:
        offsets.append((part, before))
        before += total
    running = F.sum("count").over(Window.partitionBy("_part").orderBy(column))
    return (
        ranged.withColumn("_running", running)
        .join(F.broadcast(spark.createDataFrame(offsets, "_part int, _before long")), "_part")
        .select(column, "count", (F.col("_running") + F.col("_before")).alias("upto"))
    )


def exact_quantiles(
    cumulative: DataFrame, column: str, n: int, probabilities: Sequence[float]
) -> list[float]:
    """Quantiles that interpolate between the two neighbouring order statistics."""
    positions = [(n - 1) * p for p in probabilities]
    ranks = sorted({r for h in positions for r in (math.floor(h) + 1, math.ceil(h) + 1)})
    wanted = F.filter(
        F.array(*[F.lit(r) for r in ranks]),
        lambda r: (r <= F.col("upto")) & (r > F.col("upto") - F.col("count")),
    )
    found = dict(
        cumulative.select(F.explode(wanted).alias("rank"), column).collect()
    )
    return [
        found[math.floor(h) + 1] + (h - math.floor(h)) * (found[math.ceil(h) + 1] - found[math.floor(h) + 1])
        for h in positions
    ]


def qq_points(df: DataFrame, column: str, points: int | None = None) -> DataFrame:
    """Normal quantile plot: theoretical against sample quantiles.

    Without ``points`` every row gets a point.  Otherwise ``points`` plotting
    positions (k - 1/2) / points are matched to order statistics, exactly.
    """
    cumulative = cumulative_counts(df, column)
    n = df.agg(F.count(column)).first()[0]
    upto, count = F.col("upto"), F.col("count")
    if points is None:
        m = n
        first, last = upto - count + 1, upto
    else:
        m = points

        def position(rank: Column) -> Column:
            return F.floor((2 * rank * m + n) / F.lit(2 * n)).cast("long")

        first, last = position(upto - count) + 1, position(upto)
    offset = 0.375 if m <= 10 else 0.5
    spread = cumulative.withColumns({"_first": first, "_last": last}).where(
        F.col("_first") <= F.col("_last")
    )
    p = (F.col("position") - F.lit(offset)) / F.lit(m + 1 - 2 * offset)
    # a value that fills many rows is cut into runs, which are dealt out before they are unfolded
    starts = F.sequence(F.col("_first"), F.col("_last"), F.lit(RUN))
    runs = spread.select(F.explode(starts).alias("_start"), "_last", F.col(column).alias("sample")).repartition("_start")
    stop = F.least(F.col("_last"), F.col("_start") + F.lit(RUN - 1))
    return runs.select(F.explode(F.sequence(F.col("_start"), stop)).alias("position"), "sample").select(
        "position", probit(p).alias("theoretical"), "sample"
    )


def qq_line(df: DataFrame, column: str) -> DataFrame:
    """Line through the quartiles of a normal quantile plot."""
    n = df.agg(F.count(column)).first()[0]
    low, high = exact_quantiles(cumulative_counts(df, column), column, n, [0.25, 0.75])
    z = NormalDist().inv_cdf(0.75)
    slope = (high - low) / (2 * z)
    return df.sparkSession.createDataFrame(
        [(low, high, slope, low + slope * z)],
        "q25 double, q75 double, slope double, intercept double",
    )


def density(df: DataFrame, column: str, points: int = DENSITY_POINTS) -> DataFrame:
    """Gaussian kernel density.

    Each value is split linearly between its two neighbouring grid points, which
    leaves at most ``points`` masses; the kernel sum runs over those.  The
    bandwidth is 0.9 min(sd, IQR/1.34) n^(-1/5); where both are zero, as in a
    constant column, the value's size takes their place, or else one.
    """
    x = F.col(column)
    n, low, high, sd = df.agg(F.count(x), F.min(x), F.max(x), F.stddev_samp(x)).first()
    if not n:
        raise ValueError(f"no values in {column!r}")
    sd = sd or 0.0
    q25, q75 = exact_quantiles(cumulative_counts(df, column), column, n, [0.25, 0.75])
    spread = min(sd, (q75 - q25) / 1.34) or sd or abs(low) or 1.0
    width = 0.9 * spread * n ** -0.2
    first, last = low - 3 * width, high + 3 * width
    step = (last - first) / (points - 1)
    place = (x - F.lit(first)) / F.lit(step)
    cell = F.floor(place)
    share = place - cell
    masses = (
        df.where(x.isNotNull())
        .select(cell.cast("int").alias("cell"), share.alias("share"))
        .groupBy("cell")
        .agg(F.sum(1 - F.col("share")).alias("left"), F.sum("share").alias("right"))
        .select(
            F.explode(
                F.array(
                    F.struct(F.col("cell").alias("cell"), F.col("left").alias("mass")),
                    F.struct((F.col("cell") + 1).alias("cell"), F.col("right").alias("mass")),
                )
            ).alias("m")
        )
        .select("m.cell", "m.mass")
    )
    z = (F.col("point") - F.col("cell")) * F.lit(step / width)
    return (
        masses.select("cell", "mass", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .groupBy("point")
        .agg(
            (
                F.sum(F.col("mass") * F.exp(-0.5 * z * z))
                / F.lit(n * width * math.sqrt(2 * math.pi))
            ).alias("density")
        )
        .select("point", (F.lit(first) + F.col("point") * F.lit(step)).alias("x"), "density")
    )


def binned_points(df: DataFrame, x: str, y: str, cell_x: float, cell_y: float) -> DataFrame:
    """Scatter plot of many rows as counts on a rectangular grid."""
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(
            F.floor(F.col(x) / F.lit(cell_x)).alias("cell_x"),
            F.floor(F.col(y) / F.lit(cell_y)).alias("cell_y"),
        )
        .agg(F.count(F.lit(1)).alias("count"))
    )


TREND_COLUMNS = ("n", "slope", "intercept", "r_squared", "x_min", "x_max", "slope_error", "x_mean", "sxx", "sigma")


def trend_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of a scatter plot, overall or per group, with its x range.

    ``slope_error`` is NULL for groups of fewer than three points.
    """
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    known = df.where(cx.isNotNull() & cy.isNotNull())
    stats = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(cy, cx).alias("slope"),
        F.regr_intercept(cy, cx).alias("intercept"),
        F.regr_r2(cy, cx).alias("r_squared"),
        F.min(cx).alias("x_min"),
        F.max(cx).alias("x_max"),
        F.avg(cx).alias("_mean"),
        F.regr_sxx(cy, cx).alias("_sxx"),
        F.regr_syy(cy, cx).alias("_syy"),
        F.regr_sxy(cy, cx).alias("_sxy"),
    )
    left = F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx"))
    error = F.sqrt(F.try_divide(F.greatest(left, F.lit(0.0)), (F.col("n") - 2) * F.col("_sxx")))
    sigma = F.sqrt(F.try_divide(F.greatest(left, F.lit(0.0)), F.col("n") - 2))
    return (
        stats.withColumn("slope_error", F.when(F.col("n") > 2, error))
        .withColumns({"x_mean": F.col("_mean"), "sxx": F.col("_sxx"), "sigma": F.when(F.col("n") > 2, sigma)})
        .drop("_sxx", "_syy", "_sxy", "_mean")
    )


def trend_band(lines: DataFrame, points: int = 80, level: float = 0.95) -> DataFrame:
    """Points of each trend line over its x range, with the confidence limits of the mean.

    ``lines`` comes from ``trend_line``.  The limits have n - 2 degrees of
    freedom; they are NULL for groups of fewer than three points, and groups
    without a slope have no points.
    """
    keys = [c for c in lines.columns if c not in TREND_COLUMNS]
    spread = lines.where(F.col("slope").isNotNull()).withColumn("_t", t_two_sided_quantile(level, F.col("n") - 2))
    # multiplied first: a range of whole years ends at its last year
    x = F.col("x_min") + F.col("_k") * (F.col("x_max") - F.col("x_min")) / F.lit(points - 1)
    along = spread.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
    gap = F.col("x") - F.col("x_mean")
    error = F.col("sigma") * F.sqrt(1.0 / F.col("n") + F.try_divide(gap * gap, F.col("sxx")))
    fit = F.col("intercept") + F.col("slope") * F.col("x")
    return along.select(
        *keys, F.col("_k").alias("point"), "x", fit.alias("fit"), error.alias("std_error"),
        (fit - F.col("_t") * error).alias("lower"), (fit + F.col("_t") * error).alias("upper"),
    )
