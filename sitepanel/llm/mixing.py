"""Mixing sources to target weights.

The words of a source form one line: its documents follow each other in the
order of a hash, and the line is cut into blocks of equal length.  A source
gives as many words as its target says: whole passes over its blocks in
permuted order, then as many permuted blocks of one more pass as are missing,
the last of them cut to the word.  A splitting tree deals these draws to the
output shards: at each node the blocks of every source in it are divided
between its two halves by a multivariate hypergeometric draw, so that a leaf
is an exact random share of the whole, and no two shards hold the same draw.

Positions on the line are running sums inside hash buckets of a source plus
the sum of the buckets before, so a source with a third of all rows is spread
over all tasks.  Per source, a handful of numbers passes the driver.

Defined results: a null or blank text has size 0 and is drawn never; a null
source is a source of its own and comes last; a source without words has
target 0; repeated rows are documents of their own; an empty table gives an
empty result.  Columns of the input stay; those named like an added column
are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitepanel.llm.registry import query
from sitepanel.llm.store import documents, durable

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_TIMES = 2.0
BLOCK_WORDS = 1024
SHARD_WORDS = 8_000_000
MOST_BLOCKS = 500_000_000  # what numpy's hypergeometric draws allow for; blocks grow beyond
BUCKETS = 4096
SPACE = r"[\x20\x09-\x0D]+"
SOURCE_SCHEMA = (
    "_name string, rank int, source_size long, target double, words long, block long, blocks long, last long, "
    "times array<long>, shift array<long>, last_at array<long>"
)


def word_list(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST_TIMES) -> list[float]:
    """Words per source: ``share`` of all words by weight, none above ``most`` times its size.

    What a full source leaves goes to the others by weight, until none is above.
    """
    caps = [most * s for s in sizes]
    given = [0.0] * len(sizes)
    free = {k for k, s in enumerate(sizes) if s > 0 and weights[k] > 0}
    left = min(share * sum(sizes), sum(caps[k] for k in free))
    while free:
        unit = left / sum(weights[k] for k in free)
        full = {k for k in free if weights[k] * unit >= caps[k]}
        for k in full or free:
            given[k] = caps[k] if k in full else weights[k] * unit
        if not full:
            break
        left -= sum(caps[k] for k in full)
        free -= full
    return given


def source_rows(
    sizes: dict[str | None, int], weights: Sequence[float], share: float, most: float, block_words: int, seed: int
) -> list[tuple]:
    """One row of ``SOURCE_SCHEMA`` per source, in code point order, null last."""
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    sized = [int(sizes[n]) for n in names]
    wanted = targets(sized, [weights[k % len(weights)] for k in range(len(names))], share, most)
    block = max(block_words, math.ceil(most * sum(sized) / MOST_BLOCKS))
    rows = []
    for rank, (name, size, target) in enumerate(zip(names, sized, wanted)):
        blocks = max(1, math.ceil(size / block))
        last = size - (blocks - 1) * block
        rng = np.random.default_rng([seed, rank])
        times, shift = [], []
        for _ in range(math.ceil(most)):
            factor = int(rng.integers(1, max(2, blocks)))
            while math.gcd(factor, blocks) > 1:
                factor = factor % blocks + 1
            times.append(factor)
            shift.append(int(rng.integers(0, blocks)))
        last_at = [(t * (blocks - 1) + s) % blocks for t, s in zip(times, shift)]
        rows.append((name, rank, size, float(target), int(round(target)), block, blocks, last, times, shift, last_at))
    return rows


def draw_count(row: tuple) -> int:
    """How many blocks, the cut one included, a source gives."""
    size, words, block, blocks, last, last_at = row[2], row[4], row[5], row[6], row[7], row[10]
    if words == 0:
        return 0
    passes, rest = divmod(words, size)
    if rest == 0:
        return passes * blocks
    at = last_at[passes]
    if rest <= at * block + last:
        return passes * blocks + min(-(-rest // block), at + 1)
    return passes * blocks + -(-(rest + block - last) // block)


def packed(docs: DataFrame, *own: str) -> tuple[DataFrame, dict[str, Column]]:
    """The columns ``own`` and the others as one, ``_others``, so that no name of theirs can meet a helper's; and how to take them out."""
    others = [c for c in docs.columns if c not in own]
    together = F.struct(F.lit(True).alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)])
    return docs.select(*own, together.alias("_others")), {c: F.col("_others").getField(f"c{k}").alias(c) for k, c in enumerate(others)}


def free_name(name: str, columns: Sequence[str]) -> str:
    while name in columns:
        name += "_"
    return name


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_TIMES,
    block_words: int = BLOCK_WORDS,
    seed: int = 11,
) -> tuple[DataFrame, list[tuple]]:
    """``docs`` with ``size source_size target`` and ``spans``, and the rows of its sources.

    ``spans`` lists what the mix takes of a document: ``pass draw first words``,
    the draw being its number among the draws of the source, ``first`` the
    first word, counted from 0.  ``rank`` and ``start`` are the document's place.
    """
    spark = docs.sparkSession
    slim, others = packed(docs, "doc_id", "source", "text")
    placed = (
        slim.withColumn("size", word_count(F.col("text")))
        .withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "text"))
        .withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)))
    )
    buckets = durable(placed.groupBy(F.col("source").alias("_name"), "_bucket").agg(F.sum("size").alias("_words")))
    sizes = {r._name: r.n for r in buckets.groupBy("_name").agg(F.sum("_words").alias("n")).collect()}
    rows = source_rows(sizes, weights, share, most, block_words, seed)
    sources = spark.createDataFrame(rows, SOURCE_SCHEMA)
    before = W.partitionBy("_name").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.select("_name", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    ranks = sources.select("_name", F.col("rank").alias("_rank"))
    offsets = offsets.join(ranks, offsets["_name"].eqNullSafe(ranks["_name"]))
    offsets = offsets.select(F.col("_rank").alias("_of"), F.col("_bucket").alias("_key"), "_offset")
    inside = W.partitionBy("_rank", "_bucket").orderBy("_hash").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.join(ranks, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    placed = placed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(offsets, (F.col("_rank") == F.col("_of")) & (F.col("_bucket") == F.col("_key")))
    about = sources.drop("_name").withColumnsRenamed(
        {"last": "_last", "block": "_block", "blocks": "_blocks", "words": "_words", "times": "_times", "shift": "_shift", "last_at": "_last_at"}
    )
    joined = joined.join(about, F.col("_rank") == F.col("rank"))
    joined = joined.withColumn("start", F.col("_offset") + F.col("_inside")).withColumn("spans", _spans())
    kept = [others.get(c, F.col(c)) for c in docs.columns if c not in ("rank", "start", "spans", "size", "source_size", "target")]
    return joined.select(*kept, "rank", "start", "size", "source_size", "target", "spans"), rows


def _spans() -> Column:
    """The pieces of a document that lie in drawn blocks, per pass over its source."""
    c = F.col

    def piece(at: Column, b: Column) -> Column:
        place = F.pmod(F.element_at("_times", at + 1) * b + F.element_at("_shift", at + 1), c("_blocks"))
        length = F.when(b == c("_blocks") - 1, c("_last")).otherwise(c("_block"))
        short = F.when(place > F.element_at("_last_at", at + 1), c("_block") - c("_last")).otherwise(0)
        drawn_before = at * c("source_size") + place * c("_block") - short
        taken = F.least(c("_words") - drawn_before, length)
        low = F.greatest(c("start") - b * c("_block"), F.lit(0))
        high = F.least(c("start") + c("size") - b * c("_block"), taken)
        return F.struct(
            at.cast("int").alias("pass"),
            (at * c("_blocks") + place).alias("draw"),
            (b * c("_block") + low - c("start")).alias("first"),
            (high - low).alias("words"),
        )

    first, last = F.expr("start div _block"), F.expr("(start + size - 1) div _block")
    passes = F.expr("sequence(0, greatest(cast((_words - 1) div greatest(source_size, 1) as int), 0))")
    every = F.flatten(F.transform(passes, lambda e: F.transform(F.sequence(first, last), lambda b: piece(e, b))))
    none = F.expr("array()").cast("array<struct<pass:int,draw:bigint,first:bigint,words:bigint>>")
    return F.when(c("size") > 0, F.filter(every, lambda s: s["words"] > 0)).otherwise(none)


def split_shards(spark: SparkSession, draws: Sequence[int], shards: int, seed: int = 11) -> DataFrame:
    """The splitting tree's leaves: ``shard rank first draws`` for each source in each shard.

    A leaf walks down from the root by itself; the draw at a node depends on the
    seed and the node only, so all leaves agree and none waits for another.
    """
    total = list(map(int, draws))

    def walk(low: int, high: int, counts: np.ndarray, first: np.ndarray, wanted: range) -> Iterator[tuple]:
        if wanted.stop <= low or wanted.start >= high:
            return
        if high - low == 1:
            for rank in np.flatnonzero(counts):
                yield low, int(rank), int(first[rank]), int(counts[rank])
            return
        middle = (low + high) // 2
        share = int(counts.sum()) * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(counts, share, method="marginals")
        yield from walk(low, middle, left, first, wanted)
        yield from walk(middle, high, counts - left, first + left, wanted)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wanted = range(int(batch["id"].min()), int(batch["id"].max()) + 1) if len(batch) else range(0)
            rows = list(walk(0, shards, np.array(total, dtype=np.int64), np.zeros(len(total), dtype=np.int64), wanted))
            yield pd.DataFrame(rows, columns=["shard", "rank", "first", "draws"])

    return spark.range(shards).mapInPandas(leaves, "shard long, rank int, first long, draws long")


def shard_count(rows: Sequence[tuple], shard_words: int = SHARD_WORDS) -> int:
    return max(1, math.ceil(sum(r[4] for r in rows) / shard_words))


def dealt(plan: DataFrame, rows: Sequence[tuple], shards: int, seed: int = 11) -> DataFrame:
    """One row per span, with its shard: the plan's columns but ``spans``, then the span's, ``shard``.

    Columns of the plan that are named like one of a span's or ``shard`` are replaced.
    """
    if not rows:
        rows = [(None, 0, 0, 0.0, 0, 1, 1, 0, [1], [0], [0])]
    leaves = split_shards(plan.sparkSession, [draw_count(r) for r in rows], shards, seed)
    plan = plan.drop("pass", "draw", "first", "words", "shard")
    span, of_rank, of_draw = (free_name(c, plan.columns) for c in ("_span", "_rank", "_draw"))
    of = leaves.select(
        F.col("rank").alias(of_rank), "shard", F.explode(F.expr("sequence(first, first + draws - 1)")).alias(of_draw)
    )
    taken = plan.select("*", F.explode("spans").alias(span)).select("*", f"{span}.*").drop("spans", span)
    return taken.join(of, (F.col("rank") == F.col(of_rank)) & (F.col("draw") == F.col(of_draw))).drop(of_rank, of_draw)


def taken_text(text: Column, spans: Column) -> Column:
    """The words of ``spans`` in order; the text itself where they are all of it."""
    words = word_list(text)
    parts = F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["first"].alias("first"), s["words"].alias("words")))),
        lambda s: F.slice(words, (s["first"] + 1).cast("int"), s["words"].cast("int")),
    )
    return F.array_join(F.flatten(parts), " ")


def shard_texts(plan: DataFrame, rows: Sequence[tuple], shards: int, seed: int = 11) -> DataFrame:
    """The mix itself: a row per span with its text, together by shard and shuffled inside it."""
    pieces = dealt(plan, rows, shards, seed)
    spans = F.array(F.struct("first", "words"))
    pieces = pieces.withColumn(
        "text", F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(taken_text(F.col("text"), spans))
    )
    order = F.xxhash64(F.lit(seed), "rank", "start", "pass", "first")
    return pieces.repartition("shard").sortWithinPartitions("shard", order)


def mixed_documents(docs: DataFrame, shard_words: int = SHARD_WORDS, seed: int = 11) -> DataFrame:
    """``docs`` as the mix takes them: a row per document, pass and shard, cut to the words taken.

    Rows are together by shard and shuffled inside it.  A document that the mix
    doesn't take is gone, one that it takes twice is there twice, and one that
    several shards share is there for each.  ``n_chars``, if there, is the
    length of the new text.
    """
    slim, others = packed(docs, "doc_id", "source", "text")
    plan, sources = plan_mix(slim, seed=seed)
    plan = durable(plan)
    pieces = dealt(plan.select("rank", "start", "spans"), sources, shard_count(sources, shard_words), seed)
    pieces = pieces.groupBy(F.col("rank").alias("_rank"), F.col("start").alias("_start"), F.col("pass").alias("_pass"), F.col("shard").alias("_shard"))
    pieces = pieces.agg(F.collect_list(F.struct("first", "words")).alias("_spans"))
    same = (F.col("rank") == F.col("_rank")) & (F.col("start") == F.col("_start"))
    rows = plan.filter("size > 0").join(pieces, same)
    words = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    rows = rows.withColumn(
        "text", F.when(words == F.col("size"), F.col("text")).otherwise(taken_text(F.col("text"), F.col("_spans")))
    )
    if "n_chars" in others:
        others["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    order = F.xxhash64(F.lit(seed), "_rank", "_start", "_pass")
    rows = rows.repartition("_shard").sortWithinPartitions("_shard", order)
    return rows.select(*[others.get(c, F.col(c)) for c in docs.columns])


@query("op1_mix")
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, rows = plan_mix(documents(spark, sf_dir, "doc_id", "source", "text"))
    plan = durable(plan.drop("text", "source"))
    shards = shard_count(rows)
    taken = (
        dealt(plan.select("rank", "start", "spans"), rows, shards)
        .groupBy(F.col("rank").alias("_rank"), F.col("start").alias("_start"))
        .agg(F.sum("words").alias("_taken"), F.countDistinct("shard").alias("_shards"))
    )
    same = (F.col("rank") == F.col("_rank")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
    return plan.join(taken, same, "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("_taken", F.lit(0)).alias("taken"),
        F.coalesce("_shards", F.lit(0)).alias("n_shards"),
    )
