"""Scans and sinks."""

from __future__ import annotations

import math
import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitepanel.functions.nulls import nan_to_null

_SIGNS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


#: column, one of = != < <= > >=, value
Comparison = tuple[str, str, object]


def read_parquet(spark: SparkSession, folder: str, table: str, where: Sequence[Comparison] = ()) -> DataFrame:
    """A Parquet table; NaN becomes NULL, as on every load.  ``where`` is as in ``read_panel``."""
    return nan_to_null(compared(spark.read.parquet(f"{folder}/{table}.parquet"), where))


def compared(raw: DataFrame, where: Sequence[Comparison]) -> DataFrame:
    """The rows of a scan for which every comparison holds, NaN counting as missing.

    A filter on what ``nan_to_null`` gives can't reach the files, as it tests
    an expression.  Each comparison here tests the stored column, so it does;
    a missing value never passes one, which leaves only NaN to be excluded.
    """
    if not where:
        return raw
    kinds = dict(raw.dtypes)

    def passes(column: str, sign: str, value: object) -> Column:
        stored = F.col(f"`{column}`")
        known = F.lit(None) if isinstance(value, float) and math.isnan(value) else F.lit(value)
        held = _SIGNS[sign](stored, known)
        return held & ~F.isnan(stored) if kinds[column] in ("double", "float") else held

    return raw.where(reduce(operator.and_, [passes(*c) for c in where]))


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """CSV with a header line and a declared schema.

    A byte-order mark and LF, CR or CRLF line ends are all accepted.  Empty
    fields become NULL and so does NaN.
    """
    df = spark.read.schema(schema).option("header", True).csv(path)
    return nan_to_null(df.withColumnsRenamed(dict(renames or {})))


def read_csv_by_header(
    spark: SparkSession, path: str, headers: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """CSV columns picked by header text, renamed and typed.

    Other columns are ignored, whatever their order; text that does not fit the
    type becomes NULL.
    """
    raw = spark.read.option("header", True).csv(path)
    picked = [F.col(f"`{header}`").try_cast(kind).alias(name) for header, (name, kind) in headers.items()]
    return nan_to_null(raw.select(*picked))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_panel(df: DataFrame, path: str, year: str = "year") -> None:
    """Parquet partitioned by year, so that year cut-offs prune whole folders."""
    df.write.mode("overwrite").partitionBy(year).parquet(path)


def read_panel(spark: SparkSession, path: str, where: Sequence[Comparison] = ()) -> DataFrame:
    """A written panel; ``where`` are comparisons that all must hold and that prune folders, row groups and rows in the scan."""
    return nan_to_null(compared(spark.read.parquet(path), where))
