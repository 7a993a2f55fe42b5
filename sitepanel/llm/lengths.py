"""Token counts from an exact histogram of encoded lengths.

Documents are counted by encoded length; suffix sums over the histogram then
answer totals, quantiles and truncated totals for every context limit, without
another look at a text.  The suffix sums go by blocks of lengths: the sums of
later blocks are a window over the few block totals, the rest is a window
inside each block.

Defined results: a null text has length 0 and counts as a document; repeated
rows count each; an empty table gives an empty histogram, whose totals are 0
and whose quantiles are null.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitepanel.llm.bpe import vocabulary_path
from sitepanel.llm.registry import query
from sitepanel.llm.store import documents, durable

BLOCK = 1024
LIMITS = (128, 512, 2048, 8192)


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(
    docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", length: str = "n_tokens"
) -> DataFrame:
    """``docs`` with the number of tokens of every whole text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(vocabulary, pattern).encode_ordinary
        for batch in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int64")

    return docs.withColumn(length, count(F.col(text).cast("string")))


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """Per length: documents of it, documents and tokens of it or longer, and
    ``truncated_total``, all tokens when every text is cut at that length.

    Columns ``n_tokens n_docs docs_at_least tokens_at_least truncated_total``.
    """
    counts = durable(lengths.groupBy(F.col(length).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")))
    counts = counts.withColumn("_block", F.expr(f"n_tokens div {BLOCK}"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    totals = counts.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    later = W.orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    up_to = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        "_block",
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_later_d"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_later_t"),
        F.coalesce(F.sum("_t").over(up_to), F.lit(0)).alias("_before_t"),
    )
    inside = W.partitionBy("_block").orderBy(F.desc("n_tokens"))
    below = W.partitionBy("_block").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, -1)
    at_least = F.col("_later_d") + F.sum("n_docs").over(inside)
    shorter = F.col("_before_t") + F.coalesce(F.sum(tokens).over(below), F.lit(0))
    return counts.join(totals, "_block").select(
        "n_tokens",
        "n_docs",
        at_least.alias("docs_at_least"),
        (F.col("_later_t") + F.sum(tokens).over(inside)).alias("tokens_at_least"),
        (shorter + F.col("n_tokens") * at_least).alias("truncated_total"),
    )


def totals(histogram: DataFrame) -> DataFrame:
    """One row: ``n_docs`` and ``n_tokens`` of all documents."""
    return histogram.agg(
        F.coalesce(F.max("docs_at_least"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("n_tokens"),
    )


def truncated_totals(histogram: DataFrame, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """Per context limit: ``kept_tokens`` when texts are cut there, and ``cut_docs`` longer than it."""
    cut = [
        F.struct(
            F.lit(limit).cast("long").alias("context_limit"),
            F.coalesce(F.max(F.when(F.col("n_tokens") <= limit, F.col("n_tokens"))), F.lit(0)).alias("_at"),
            F.coalesce(F.min_by("docs_at_least", F.when(F.col("n_tokens") > limit, F.col("n_tokens"))), F.lit(0)).alias("_longer"),
            F.coalesce(F.max_by("truncated_total", F.when(F.col("n_tokens") <= limit, F.col("n_tokens"))), F.lit(0)).alias("_kept"),
        )
        for limit in limits
    ]
    rows = histogram.agg(F.array(*cut).alias("_rows")).select(F.explode("_rows").alias("r")).select("r.*")
    return rows.select(
        "context_limit",
        (F.col("_kept") + (F.col("context_limit") - F.col("_at")) * F.col("_longer")).alias("kept_tokens"),
        F.col("_longer").alias("cut_docs"),
    )


def quantiles(histogram: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Per share p: the smallest length that at least p of all documents don't exceed."""
    every = histogram.agg(F.max("docs_at_least").alias("_n"))
    up_to = F.col("_n") - F.col("docs_at_least") + F.col("n_docs")
    least = [
        F.struct(F.lit(float(p)).alias("share"), F.min(F.when(up_to >= p * F.col("_n"), F.col("n_tokens"))).alias("n_tokens"))
        for p in shares
    ]
    return (
        histogram.join(F.broadcast(every))  # one row
        .agg(F.array(*least).alias("_rows"))
        .select(F.explode("_rows").alias("r"))
        .select("r.*")
    )


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir, "doc_id", "text")
    path = vocabulary_path("byte_bpe_50k.tiktoken")
    return length_histogram(encoded_lengths(docs, path, public_tokenizers.PATTERN))
