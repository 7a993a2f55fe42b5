"""Missing-value rules.

The surveys treat a missing reading as making a whole total unknown, while
Spark aggregates skip NULL.  Every aggregate here therefore answers NULL when
any row it covers is NULL, unless ``na_rm`` asks for Spark's own rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _strict(stat: Callable[[Column], Column], value: Column, where: Column | None, na_rm: bool) -> Column:
    kept = value if where is None else F.when(where, value)
    if na_rm:
        return stat(kept)
    rows = F.count(F.lit(1)) if where is None else F.count(F.when(where, F.lit(1)))
    return F.when(F.count(kept) == rows, stat(kept))


def na_sum(value: Column, where: Column | None = None, na_rm: bool = False) -> Column:
    """Sum over the rows that match ``where``; NULL if one of them is NULL or none match."""
    return _strict(F.sum, value, where, na_rm)


def na_min(value: Column, where: Column | None = None, na_rm: bool = False) -> Column:
    return _strict(F.min, value, where, na_rm)


def na_max(value: Column, where: Column | None = None, na_rm: bool = False) -> Column:
    return _strict(F.max, value, where, na_rm)


def na_mean(value: Column, where: Column | None = None, na_rm: bool = False) -> Column:
    return _strict(F.avg, value, where, na_rm)


def row_sum(columns: Iterable[Column]) -> Column:
    """Sum across columns of one row; NULL if any is NULL."""
    return reduce(add, columns)


def row_min(columns: Iterable[Column]) -> Column:
    """Smallest of several columns; NULL if any is NULL (``least`` alone skips NULL)."""
    columns = list(columns)
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    return F.when(known, F.least(*columns))


def row_mean(columns: Iterable[Column]) -> Column:
    """Mean of the known values of one row; NULL when none is known."""
    known = F.filter(F.array(*columns), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(known))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column, so one missing-value rule holds."""
    floating = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(
        *[
            F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c in floating else F.col(c)
            for c in df.columns
        ]
    )
