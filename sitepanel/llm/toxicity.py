"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled texts, one for each class,
from the word forms that speak for it.  A text is cut into windows of one word
form; each is compressed with either dictionary, and the bytes that the toxic
dictionary saves over the ordinary one are compared with thresholds.  How many
windows pass each threshold, alone and per word, is weighed by a logistic
calibration that was fitted on labelled texts the dictionaries didn't see.

zstandard stores a frame raw when little is to be won, and a first match costs
more than a later one.  Each window therefore stands between a lead-in and a
lead-out that both dictionaries hold, so that a frame is always packed and the
saving shows at its full size.

Dictionaries and calibration come from a bounded sample of labelled rows
(``TOXIC_SAMPLE`` and ``ORDINARY_SAMPLE``, chosen by a hash of doc_id); the
calibration is weighted to the class shares of all labelled rows.

Defined results: a null or blank text has no window and gets the score of a
text without any hit; with only one class, or none, among the labels every
score is that class's share (0 without labels); rows are kept as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepanel.llm.langid import held_out
from sitepanel.llm.registry import query
from sitepanel.llm.store import documents

TOXIC_SAMPLE, ORDINARY_SAMPLE = 1500, 3000
THRESHOLDS = tuple(range(2, 10))
PREDICT_FROM = 0.3
DICTIONARY_BYTES = 8192
GRAMS = (5, 6, 8)
LEAST_TEXTS, LEAST_CONTRAST = 4, 5.0
LEAD_IN = b"~a lead-in that both dictionaries hold: 0123456789 ABCDEFGHIJKLMNOPQRSTUVWXYZ~"
LEAD_OUT = b"=and a lead-out, for the same reason: zyxwvutsrqponmlkjihgfedcba 9876543210="
MEMORY = 100_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?\"'()[]{}#&%$*-_"


def forms(text: str) -> Iterator[str]:
    """The word forms of a whole text: lower-cased words without punctuation at their edges."""
    for word in WORD.finditer(text):
        yield word.group().lower().strip(EDGES)


def grams(form: str) -> set[str]:
    padded = f" {form} "
    return {padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1)}


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=14, hash_log=12, chain_log=12, search_log=5,
        target_length=64, write_content_size=0, write_dict_id=0,
    )
    held = zstandard.ZstdCompressionDict(b"\n" * 16 + content + LEAD_IN + LEAD_OUT, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=settings)


def dictionary(ranked: list[str], most: int = DICTIONARY_BYTES) -> bytes:
    """The word forms in order of weight, those that count most at the end, where matches are cheapest."""
    out = b""
    for form in ranked:
        entry = f" {form}".encode("utf-8", "replace")
        if entry in out:
            continue
        if len(out) + len(entry) > most:
            break
        out = entry + out
    return out


def train_dictionaries(texts: list[str], toxic: np.ndarray) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary.

    Character n-grams that are found in significantly more toxic than ordinary
    texts mark the word forms for the toxic dictionary; the ordinary one takes
    the forms found in most ordinary texts that hold no such mark.
    """
    seen = [Counter(), Counter()]
    uses = [Counter(), Counter()]
    for text, label in zip(texts, toxic):
        found = Counter(forms(text))
        found.pop("", None)
        seen[label].update(set().union(*map(grams, found)) if found else ())
        uses[label].update(found if label else found.keys())
    n = np.array([np.sum(toxic == 0), np.sum(toxic == 1)], dtype=float)
    marks = set()
    for gram, a in seen[1].items():
        if a < LEAST_TEXTS:
            continue
        share = (a + seen[0][gram]) / n.sum()
        spread = np.sqrt(max(share * (1 - share), 1e-12) * (1 / n[0] + 1 / n[1]))
        if (a / n[1] - seen[0][gram] / n[0]) / spread > LEAST_CONTRAST:
            marks.add(gram)
    ranked = [
        [f for f, _ in sorted(uses[k].items(), key=lambda x: (-x[1], x[0])) if bool(grams(f) & marks) == bool(k)] for k in (0, 1)
    ]
    return dictionary(ranked[1]), dictionary(ranked[0])


@dataclass
class ToxicityModel:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * len(THRESHOLDS) + 1))
    constant: float | None = 0.0  # the score where there was nothing to learn from

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """One worker's compressors; remembers the savings of forms met lately."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.pair = compressor(model.ordinary).compress, compressor(model.toxic).compress
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def saving(self, form: str) -> int:
        found = self.older.get(form)
        if found is None:
            window = LEAD_IN + f" {form} ".encode("utf-8", "replace") + LEAD_OUT
            found = len(self.pair[0](window)) - len(self.pair[1](window))
        if len(self.recent) >= MEMORY:
            self.recent, self.older = {}, self.recent
        self.recent[form] = found
        return found

    def features(self, text: str | None) -> np.ndarray:
        passed = np.zeros(64, dtype=np.int64)
        words = 0
        for form in forms(text or ""):
            words += 1
            saved = self.recent.get(form)
            if saved is None:
                saved = self.saving(form)
            if saved >= THRESHOLDS[0]:
                passed[min(saved, 63)] += 1
        hits = np.cumsum(passed[::-1])[::-1][list(THRESHOLDS)]
        return np.concatenate([np.log1p(hits), np.log1p(200.0 * hits / (words + 20)), [1.0]])

    def score(self, text: str | None) -> float:
        if self.model.constant is not None:
            return self.model.constant
        margin = float(self.features(text) @ self.model.weights)
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -40.0, 40.0)))


def calibrate(rows: np.ndarray, labels: np.ndarray, row_weights: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(rows @ w, -40, 40)))
        gradient = rows.T @ (row_weights * (p - labels)) + ridge * w * (np.arange(len(w)) < len(w) - 1)
        curvature = (rows * (row_weights * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_toxicity(texts: list[str], toxic: np.ndarray, totals: tuple[int, int] | None = None) -> ToxicityModel:
    """A model from labelled texts; ``totals`` are the numbers of all ordinary and toxic rows."""
    if len(set(toxic.tolist())) < 2:
        return ToxicityModel(constant=float(toxic.mean()) if len(toxic) else 0.0)
    check = np.arange(len(texts)) % 5 >= 3
    for label in (0, 1):  # both parts need both classes
        mine = np.flatnonzero(toxic == label)
        check[mine] = np.arange(len(mine)) % 5 >= 3
        check[mine[0]] = len(mine) == 1
    learn = ~check | (np.bincount(toxic, minlength=2)[toxic] == 1)
    contents = train_dictionaries([t for t, k in zip(texts, learn) if k], toxic[learn])
    model = ToxicityModel(*contents)
    scorer = model.scorer()
    if not any(check[toxic == 0]) or not any(check[toxic == 1]):
        check[:] = True
    rows = np.array([scorer.features(t) for t, c in zip(texts, check) if c])
    labels = toxic[check]
    in_class = np.bincount(labels, minlength=2)
    wanted = np.array(totals if totals else np.bincount(toxic, minlength=2), dtype=float)
    share = wanted / wanted.sum() * len(labels)
    model.weights, model.constant = calibrate(rows, labels, (share / in_class)[labels]), None
    return model


def fit_toxicity_model(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("_hash", F.xxhash64("doc_id"))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # every task keeps only its first rows of a class
    some = [known.filter(F.col("toxic") == k).orderBy("_hash", "doc_id").limit(n) for k, n in ((1, TOXIC_SAMPLE), (0, ORDINARY_SAMPLE))]
    chosen = some[0].unionByName(some[1])
    # about the two samples' rows; of many texts of one doc_id the same ones in every run
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic", "_hash")), "doc_id")
    texts = texts.filter("text is not null").orderBy("_hash", "doc_id", F.xxhash64("text"))
    rows = texts.limit(2 * (TOXIC_SAMPLE + ORDINARY_SAMPLE)).collect()
    rows.sort(key=lambda r: (r["_hash"], r["doc_id"], r["text"]))
    return fit_toxicity(
        [r["text"] for r in rows], np.array([r["toxic"] for r in rows], dtype=np.int64), (totals.get(0, 0), totals.get(1, 0))
    )


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries and a few weights

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared.value.scorer()
        for batch in batches:
            yield pd.Series([scorer.score(t) for t in batch], dtype="float64")

    scored = docs.withColumn("score", score(F.col(text).cast("string")))
    return scored.withColumn("predicted", F.when(F.col("score") >= PREDICT_FROM, 1).otherwise(0))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit_toxicity_model(docs.filter(~F.col("held_out")), labels.filter(~held_out(F.col("doc_id"))))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")
