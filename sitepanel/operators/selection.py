"""All-subsets model selection and model averaging."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import sitepanel
from sitepanel.operators.mixed import independent_terms
from sitepanel.operators.moments import SiteMoments
from sitepanel.operators.subsets import SubsetTree
from sitepanel.session import durable

# The fitting helpers travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sitepanel)

# A subset is the bits of a long.
MOST_TERMS = 62
BRANCHES_PER_CORE = 8

_COLUMNS = ["subset", "rank", "theta", "log_lik", "aicc", "estimates", "std_errors"]
_FITTED = (
    "subset long, rank int, theta double, log_lik double, aicc double, "
    "estimates array<double>, std_errors array<double>"
)


def model_selection(
    moments: SiteMoments,
    response: str,
    terms: Sequence[str],
    reml: bool = False,
    theta: float | None = None,
    within: float | None = None,
) -> DataFrame:
    """Fit the allowed subsets of the terms and rank them by AICc.

    A product is only allowed with all its factors.  The size classes of the
    full design hold every subset's moments, so no fit reads the rows.  Branches
    of the tree of subsets are spread over the cluster as rows.  ``theta=0``
    selects among linear models.

    With ``within`` only the subsets at most that far from the best are found,
    and branches that can't hold one are cut; weights are then shares among
    those found.
    """
    spark = moments.table.sparkSession
    pooled = moments.pooled
    terms = independent_terms(pooled, terms)
    if len(terms) > MOST_TERMS:
        raise ValueError(f"all subsets of {len(terms)} terms: at most {MOST_TERMS} are searched")
    tree = SubsetTree(pooled, response, terms, reml, theta, within)
    if within is not None:
        tree.descend()
    cores = spark.sparkContext.defaultParallelism
    branches = tree.branches(BRANCHES_PER_CORE * cores)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for subset, depth in zip(batch["subset"], batch["depth"]):
                for lot in tree.search(int(subset), int(depth)):
                    yield pd.DataFrame(lot, columns=_COLUMNS)

    # neighbouring branches are alike in size, so they are dealt out
    rows = spark.createDataFrame(branches, "subset long, depth int").repartition(min(len(branches), 4 * cores), "subset")
    fitted = durable(rows.mapInPandas(fit, _FITTED))
    best = fitted.agg(F.min(F.nanvl("aicc", F.lit(None)))).first()[0]
    if within is not None:
        fitted = fitted.where(F.col("aicc") <= F.lit(best) + F.lit(float(within)))
    relative = F.exp(-(F.col("aicc") - F.lit(best)) / 2)
    mass = fitted.agg(F.sum(relative)).first()[0]
    labels = F.array(*[F.lit(t) for t in ["(Intercept)", *terms]])
    included = F.filter(
        F.transform(F.arrays_zip(labels.alias("t"), F.col("estimates").alias("e")), lambda z: F.when(z["e"].isNotNull(), z["t"])),
        lambda t: t.isNotNull(),
    )
    return fitted.select(
        "subset",
        F.array_join(included, " + ").alias("model"),
        "rank",
        "theta",
        "log_lik",
        "aicc",
        (F.col("aicc") - F.lit(best)).alias("delta"),
        (relative / F.lit(mass)).alias("weight"),
        labels.alias("terms"),
        "estimates",
        "std_errors",
    )


def best_models(selection: DataFrame, count: int) -> DataFrame:
    """The models with the smallest AICc first."""
    return selection.orderBy("aicc", "subset").limit(count)


def model_average(selection: DataFrame, delta: float, revised: bool = True) -> DataFrame:
    """Weighted coefficients over the models within ``delta`` of the best.

    The full average counts an absent term as zero; the conditional one
    averages over the models that contain the term.  Errors are the root of the
    weighted mean of se^2 + (b - mean)^2, or with ``revised=False`` the weighted
    mean of the roots.
    """
    chosen = selection.where(F.col("delta") < delta)
    mass = chosen.agg(F.sum("weight")).first()[0]
    long = chosen.select(
        (F.col("weight") / F.lit(mass)).alias("w"),
        F.explode(F.arrays_zip("terms", "estimates", "std_errors")).alias("z"),
    ).select("w", F.col("z.terms").alias("term"), F.col("z.estimates").alias("b"), F.col("z.std_errors").alias("se"))
    present = F.col("b").isNotNull()
    means = long.groupBy("term").agg(
        F.sum(F.when(present, F.col("w") * F.col("b"))).alias("full_average"),
        F.sum(F.when(present, F.col("w"))).alias("importance"),
        F.count(F.when(present, F.lit(1))).alias("models"),
    )
    means = means.where(F.col("models") > 0).withColumn(
        "conditional_average", F.col("full_average") / F.col("importance")
    )
    spread = long.join(means, "term")
    full_b, full_se = F.coalesce("b", F.lit(0.0)), F.coalesce("se", F.lit(0.0))

    def error(b, se, centre):
        gap = b - F.col(centre)
        return se * se + gap * gap if revised else F.sqrt(se * se + gap * gap)

    def settled(mean):
        return F.sqrt(mean) if revised else mean

    return (
        spread.groupBy("term")
        .agg(
            F.max("models").alias("models"),
            F.max("importance").alias("importance"),
            F.max("full_average").alias("full_average"),
            settled(F.sum(F.col("w") * error(full_b, full_se, "full_average"))).alias("full_error"),
            F.max("conditional_average").alias("conditional_average"),
            settled(
                F.sum(F.when(present, F.col("w") * error(F.col("b"), F.col("se"), "conditional_average")))
                / F.max("importance")
            ).alias("conditional_error"),
        )
    )
