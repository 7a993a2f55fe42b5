"""Which values are missing together, and what each choice of columns would keep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 62  # columns that one long can stand for


def missing_patterns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows by the set of columns that are NULL in them: ``missing`` (names), ``n_missing``, ``rows``.

    A row becomes a bit set, which is counted in one aggregate over the frame;
    the result has one row per set that occurs.  No column at all missing is the empty set.
    """
    columns = list(df.columns if columns is None else columns)
    words = {}
    for first in range(0, len(columns), BITS):
        bits = F.lit(0).cast("long")
        for place, name in enumerate(columns[first : first + BITS]):
            bits = bits + F.when(F.col(f"`{name}`").isNull(), F.lit(1 << place).cast("long")).otherwise(F.lit(0).cast("long"))
        words[f"w{first // BITS}"] = bits
    counted = df.select(*[bits.alias(w) for w, bits in words.items()]).groupBy(*words).agg(F.count(F.lit(1)).alias("rows"))
    names = [
        F.when(F.col(f"w{i // BITS}").bitwiseAND(F.lit(1 << i % BITS).cast("long")) != 0, F.lit(name)) for i, name in enumerate(columns)
    ]
    missing = F.filter(F.array(*names), lambda name: name.isNotNull()) if columns else F.array().cast("array<string>")
    return counted.select(missing.alias("missing"), F.size(missing).alias("n_missing"), "rows")


def rows_kept(patterns: DataFrame, choices: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per choice of columns: rows that are complete in them, rows that aren't, and the columns at fault.

    ``fails`` says whether a fit that refuses missing values would stop.  The
    rows are not read again: the patterns hold all that is needed.
    """
    sums = []
    for name, columns in choices.items():
        # names that a choice and a pattern share
        wanted = F.array(*[F.lit(c) for c in columns]) if columns else F.array().cast("array<string>")
        at_fault = F.array_intersect("missing", wanted)
        whole = F.size(at_fault) == 0
        sums.append(
            F.struct(
                F.lit(name).alias("choice"),
                F.coalesce(F.sum(F.when(whole, F.col("rows"))), F.lit(0)).alias("kept"),
                F.coalesce(F.sum(F.when(~whole, F.col("rows"))), F.lit(0)).alias("dropped"),
                F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(at_fault)))), ",").alias("at_fault"),
            )
        )
    rows = patterns.agg(F.array(*sums).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    return rows.withColumn("fails", F.col("dropped") > 0)
