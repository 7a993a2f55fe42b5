"""Joins of large row sets to lookups, without hot keys in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitepanel.functions.scalars import coordinate_key
from sitepanel.session import durable

BROADCAST_ROWS = 100_000
HOT_KEYS = 1_000
TRACKED = 65_536
SALTS = 64
SPLIT_JOINS = ("left", "inner", "left_semi", "left_anti")


def row_count_within(df: DataFrame, bound: int) -> bool:
    """Whether a frame has at most ``bound`` rows; reads no further than that."""
    return df.limit(bound + 1).count() <= bound


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    bound: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a large, possibly skewed row set to a lookup table.

    A lookup of at most ``bound`` rows is broadcast.  A larger one is joined in
    two parts.  Keys that hold more than about 1/HOT_KEYS of the rows are
    broadcast with their lookup rows, or, if those are more than ``bound``
    themselves, joined by salted keys; rows without a key, which match nothing,
    go along unshuffled.  All other keys go through an ordinary shuffle join.
    The result is the same either way.
    """
    on = list(on)
    if how not in SPLIT_JOINS:
        raise ValueError(f"{how!r} joins aren't supported, only {', '.join(SPLIT_JOINS)}")
    if row_count_within(lookup, bound):
        return rows.join(F.broadcast(lookup), on, how)
    # both sides hash a key in the type in which the join compares it
    types = [f.dataType for f in rows.select(*on).union(lookup.select(*on)).schema]
    key = F.xxhash64(*[F.col(c).cast(t) for c, t in zip(on, types)])
    keyed = reduce(and_, [F.col(c).isNotNull() for c in on])
    hot = key.isin(hot_hashes(rows.where(keyed), key))
    hot_lookup = lookup.where(keyed & hot)
    hot_rows, cold_rows = rows.where(~keyed | hot), rows.where(keyed & ~hot)
    if row_count_within(hot_lookup, bound):
        joined = hot_rows.join(F.broadcast(hot_lookup), on, how)
    else:
        salted = hot_rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)).cast("int"))
        spread = hot_lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, [*on, "_salt"], how).drop("_salt")
    return joined.unionByName(cold_rows.join(lookup, on, how))


def hot_hashes(rows: DataFrame, key: Column) -> list[int]:
    """The values of ``key`` that more than about 1/HOT_KEYS of the rows hold, by one pass and a mergeable sketch.

    A sketch of TRACKED frequent items misjudges a count by a few rows in
    TRACKED, far less than 1/HOT_KEYS, so no hot key is missed and, as there
    can hardly be more than HOT_KEYS of them, the first 2 * HOT_KEYS hold all.
    """
    sketch = F.expr(f"approx_top_k(_key, {2 * HOT_KEYS}, {TRACKED})")
    found = rows.select(key.alias("_key")).agg(F.count(F.lit(1)).alias("n"), sketch.alias("most")).first()
    return [r["item"] for r in found["most"] or [] if r["count"] * HOT_KEYS > found["n"]]


def with_coordinate_keys(df: DataFrame, lon: str, lat: str) -> DataFrame:
    return df.withColumns(
        {"lon_key": coordinate_key(F.col(lon)), "lat_key": coordinate_key(F.col(lat))}
    )


def coordinate_join(
    readings: DataFrame,
    sites: DataFrame,
    keep: str = "sites",
    bound: int = BROADCAST_ROWS,
) -> DataFrame:
    """Attach sites to readings taken at the same coordinate.

    Both sides carry ``lon_key`` and ``lat_key``.  Sites that share a coordinate
    each get the readings.  ``keep="readings"`` keeps readings without a site,
    ``keep="sites"`` keeps sites without readings; the latter are added from a
    key-only pass, because a small left side of a left join cannot be broadcast.
    That pass drops the keys of no site before it looks for distinct ones.
    """
    on = ["lon_key", "lat_key"]
    if keep == "readings":
        return lookup_join(readings, sites, on, "left", bound)
    if keep != "sites":
        raise ValueError(f"unknown side to keep {keep!r}")
    matched = lookup_join(readings, sites, on, "inner", bound)
    read = lookup_join(readings.select(*on), sites.select(*on), on, "left_semi", bound).distinct()
    unread = sites.join(read, on, "left_anti")
    return matched.unionByName(unread, allowMissingColumns=True)


def keep_members(
    rows: DataFrame, keys: DataFrame, on: Sequence[str], bound: int = BROADCAST_ROWS
) -> DataFrame:
    """Rows whose key is in a derived key set.

    The keys are materialised first: a set within ``bound`` is then broadcast and
    the rows are not shuffled at all.
    """
    return lookup_join(rows, durable(keys.select(*on).distinct()), on, "left_semi", bound)


def drop_members(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose key is not in a literal list; rows without a key stay."""
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(*values))
