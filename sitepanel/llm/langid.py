"""Language identification by sparse multinomial logistic regression.

Features are character n-grams (n = 1, 2, 3) of the whole lower-cased text,
hashed to ``DIMENSIONS`` columns, weighted by damped term frequency times
inverse document frequency and scaled to length one.  Document frequencies
cover all rows that may be learned from.  The regression is trained on a
bounded sample of them (``SAMPLE`` rows, equally many of each language, chosen
by a hash of doc_id; of more than ``SAMPLE`` languages the most frequent ones)
with the follow-the-regularised-leader rule and an elastic-net penalty; a temperature fitted on a fifth of the sample, which the
regression didn't see, turns its margins into probabilities.

Defined results: a text that is null or has no letter is ``und`` with score 0,
as is every text when nothing could be learned; ties go to the language that
comes first by code point; rows are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitepanel.llm.registry import query
from sitepanel.llm.store import documents

BITS = 15
DIMENSIONS = 1 << BITS
SAMPLE = 2400
SLACK = 64
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.02
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")  # number signs such as a half or a Roman eight are no letters
CHUNK = 1 << 20
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def held_out(doc_id: Column, parts: int = 4) -> Column:
    """Whether a row is kept from learning; a row without doc_id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 2, F.lit(True))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns and counts of the n-grams of a whole text, in pieces of bounded length."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), dtype="<u4")
    counts = np.zeros(DIMENSIONS, dtype=np.int64)
    for at in range(0, max(len(points) - 2, 1), CHUNK):
        part = points[at : at + CHUNK + 2]
        whole = len(part) - 2 if at + CHUNK + 2 < len(points) else len(part)
        hashed = np.zeros(len(part), dtype=np.uint32)
        for n in range(min(3, len(part))):
            hashed = hashed[: len(part) - n] + (part[n:] + np.uint32(n)) * FACTORS[n]
            mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount((mixed >> np.uint32(32 - BITS))[:whole], minlength=DIMENSIONS)
    columns = np.flatnonzero(counts)
    return columns, counts[columns]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # language x column
    bias: np.ndarray
    temperature: float

    def vector(self, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return unit_vector(columns, counts, self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not LETTER.search(text) or not self.languages:
            return UNDETERMINED, 0.0
        columns, counts = gram_counts(text)
        margins = self.weights[:, columns] @ self.vector(columns, counts) + self.bias
        shares = softmax(margins / self.temperature)
        best = int(np.argmax(shares))
        return self.languages[best], float(shares[best])


def unit_vector(columns: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1.0 + np.log(counts)) * idf[columns]
    return values / max(float(np.sqrt(values @ values)), 1e-12)


class Vectors:
    """Columns and unit vector of each row (columns, counts), formed anew on every pass: the driver holds the packed rows alone."""

    def __init__(self, rows: Sequence, idf: np.ndarray):
        self.rows, self.idf = rows, idf

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for r in self.rows:
            columns = np.frombuffer(r["columns"], "<u2").astype(np.int64)
            yield columns, unit_vector(columns, np.frombuffer(r["counts"], "<u4").astype(np.float64), self.idf)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: Iterable[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = EPOCHS):
    """Weights and bias after ``epochs`` passes; the last column of the state is the bias."""
    z = np.zeros((classes, DIMENSIONS + 1))
    n = np.zeros((classes, DIMENSIONS + 1))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(ns)) / ALPHA + L2)

    for _ in range(epochs):
        for (columns, values), label in zip(rows, labels):
            at = np.append(columns, DIMENSIONS)
            x = np.append(values, 1.0)
            zs, ns = z[:, at], n[:, at]
            w = weights(zs, ns)
            error = softmax(w @ x)
            error[label] -= 1.0
            g = error[:, None] * x
            grown = ns + g * g
            z[:, at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * w
            n[:, at] = grown
    final = weights(z, n)
    return final[:, :DIMENSIONS], final[:, DIMENSIONS]


def fit_temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of margins with the least log loss, searched on a fixed grid."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(20.0), 121))
    loss = [-np.log(softmax(margins / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def document_frequencies(texts: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all texts each n-gram column occurs, and how many texts there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(DIMENSIONS + 1, dtype=np.int64)
        for batch in batches:
            for t in batch[text]:
                seen[gram_counts(t or "")[0]] += 1
                seen[DIMENSIONS] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"column": at, "texts": seen[at]})

    sums = texts.select(text).mapInPandas(count, "column long, texts long").groupBy("column").agg(F.sum("texts").alias("n"))
    found = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    for r in sums.collect():  # at most one row per column
        found[r["column"]] = r.n
    return found[:DIMENSIONS], int(found[DIMENSIONS])


def fit_language_model(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """A model from the columns ``doc_id text lang``; rows without text or lang teach nothing.

    No task ranks more than about ``2 * sample + SLACK`` hashes of a language,
    however many rows it has.
    """
    labelled = labelled.filter("lang is not null and text is not null")
    hashed = labelled.withColumn("_hash", F.xxhash64("doc_id"))
    counted = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    languages = sorted(r.lang for r in counted)
    if not languages:
        return LanguageModel([], np.zeros(DIMENSIONS), np.zeros((0, DIMENSIONS)), np.zeros(0), 1.0)
    each = max(1, sample // len(languages))
    # hashes are spread evenly, so about twice as many as are wanted lie below this share of their range
    bounds = [(r.lang, min(1.0, (2 * each + SLACK) / r.n)) for r in counted]
    few = labelled.sparkSession.createDataFrame(bounds, "lang string, _share double")  # at most ``sample`` rows
    thin = hashed.select("lang", "_hash").join(F.broadcast(few), "lang").filter("_hash / 1.8446744073709552e19 + 0.5D <= _share")
    first = F.row_number().over(W.partitionBy("lang").orderBy("_hash"))
    chosen = thin.select("lang", "_hash").distinct().withColumn("_place", first).filter(F.col("_place") <= each)
    bound = chosen.groupBy("lang").agg(F.max("_hash").alias("_most"))
    marked = hashed.join(F.broadcast(bound.limit(sample)), "lang").filter("_hash <= _most").dropDuplicates(["doc_id"])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [gram_counts(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "lang": batch["lang"],
                    "_hash": batch["_hash"],
                    "columns": [c.astype("<u2").tobytes() for c, _ in rows],
                    "counts": [np.minimum(k, 0xFFFFFFFF).astype("<u4").tobytes() for _, k in rows],
                }
            )

    schema = "lang string, _hash long, columns binary, counts binary"
    picked = marked.select("lang", "_hash", "text").mapInPandas(features, schema).limit(2 * sample).collect()
    picked.sort(key=lambda r: (r["_hash"], r["lang"], r["columns"]))
    texts, n = document_frequencies(labelled)
    idf = np.log((1.0 + n) / (1.0 + texts)) + 1.0
    known = {x: k for k, x in enumerate(languages)}
    labels = np.array([known[r["lang"]] for r in picked])
    check = np.arange(len(picked)) % 5 == 4
    weights, bias = train_ftrl(Vectors([r for r, c in zip(picked, check) if not c], idf), labels[~check], len(languages))
    tested = Vectors([r for r, c in zip(picked, check) if c], idf)
    margins = np.array([weights[:, c] @ v + bias for c, v in tested]).reshape(-1, len(languages))
    return LanguageModel(
        languages, idf, np.ascontiguousarray(weights, dtype=np.float32), bias, fit_temperature(margins, labels[check])
    )


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the probability of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x DIMENSIONS numbers

    @F.pandas_udf("lang_pred string, score double")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            yield pd.DataFrame([own.predict(t) for t in batch], columns=["lang_pred", "score"])

    # a deterministic function would run again, in workers of its own, for a filter on its result
    predict = named.asNondeterministic()
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.withColumn("_prediction", predict(F.col(text).cast("string")))
    return out.select(*kept, "_prediction.lang_pred", "_prediction.score")


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")


@query("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = fit_language_model(learnable(docs))
    marked = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return identify(marked, model).select("doc_id", "held_out", "lang_pred", "score")
