"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitepanel.llm.store import durable

MOST_ROUNDS = 60
FILES, FILE_LINKS = 8, 10_000  # a round is written as so many files, and one more for so many links


def components(links: DataFrame) -> DataFrame:
    """``id component`` for every end of ``links`` (columns ``a b``, integers).

    The component is the smallest id that can be reached.  Rounds of large and
    small stars: each node passes its neighbours on to the smallest of them,
    which halves distances while every node keeps few links.  Each round's
    links are written to the shared folder, so a lost executor costs one round.
    Minima are formed on the map side; nothing is gathered by node, and no
    join is broadcast: each one would pass through the driver and leave it a
    thread and buffers, for every round.

    Defined results: self-links make a component of one; repeated and reversed
    links count once; no links give no rows; a null end is left out.
    """
    ends = links.filter("a is not null and b is not null")
    loops = ends.select(F.col("a").alias("id")).union(ends.select(F.col("b").alias("id"))).distinct()
    edges = ends.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = durable(edges)
    size, before = edges.count(), None
    for _ in range(MOST_ROUNDS):
        # a round about keeps the number of links; few of them make few files, whatever the shuffle's partitions
        edges = durable(_small_star(_large_star(edges)).coalesce(FILES + size // FILE_LINKS))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        size, before = now[0], now
    else:
        raise RuntimeError("the components didn't settle")
    return loops.join(edges.select(F.col("u").alias("id"), F.col("v").alias("_v")).hint("merge"), "id", "left").select(
        "id", F.coalesce("_v", "id").alias("component")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours go to the smallest neighbour, or to the node itself if that is smaller."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
    moved = both.filter("v > u").join(least.hint("merge"), F.col("u") == F.col("_u"))
    return moved.select(F.col("v").alias("u"), F.least("u", "_m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours, and the node itself, go to the smallest of them."""
    least = edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
    moved = edges.join(least.hint("merge"), F.col("u") == F.col("_u"))
    own = least.select(F.col("_u").alias("u"), F.col("_m").alias("v"))
    return moved.filter("v != _m").select(F.col("v").alias("u"), F.col("_m").alias("v")).union(own).distinct()
