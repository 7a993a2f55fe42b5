"""A training corpus from raw documents: five stages, each a table from the one before.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns a DataFrame; all but the last return the columns of ``documents``.

1. ``language``: documents without any language go; a missing ``lang`` is filled in.
2. ``near_duplicates``: one document of each group of near copies stays, the one
   with the smallest doc_id; repeated rows of it go as well.
3. ``secrets``: confirmed secrets are blanked out, every document stays.
4. ``mixture``: sources come near their target weights; a document may be left
   out, cut or drawn twice.
5. ``tokens``: the ids of each text and the text that they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitepanel.llm.bpe import recoded, vocabulary_path
from sitepanel.llm.langid import UNDETERMINED, fit_language_model, identify, learnable
from sitepanel.llm.mixing import mixed_documents
from sitepanel.llm.neardup import near_duplicates
from sitepanel.llm.secrets import redact, scan
from sitepanel.llm.store import durable


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; where nothing could be learned, those that hold a letter."""
    model = fit_language_model(learnable(docs))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    named = identify(docs, model).filter(F.col("lang_pred") != UNDETERMINED)
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component; rows without words or doc_id are in no component and stay."""
    marks = near_duplicates(docs.select("doc_id", "text")).filter("kept and component_id is not null and n_shingles > 0")
    kept = marks.select(F.col("doc_id").alias("kept")).distinct()
    # the caller's columns travel as one, so no name of theirs can meet one of these
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    doc_id, text = F.col("row.doc_id"), F.col("row.text")
    empty = doc_id.isNull() | ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = packed.join(kept, doc_id == F.col("kept"), "left").filter(empty | F.col("kept").isNotNull())
    # rows that share a kept doc_id: the first by text
    place = F.row_number().over(W.partitionBy(doc_id, F.when(empty, F.monotonically_increasing_id())).orderBy(F.xxhash64(text), text))
    return rows.withColumn("place", place).filter("place = 1").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs, scan(docs.select("doc_id", "text", "lang")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id n_tokens ids decoded``; ids are packed little-endian 32-bit integers."""
    coded = recoded(docs, vocabulary_path("word_bpe_49k.json"))
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Learned models, sketches and hashed draws have no SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
