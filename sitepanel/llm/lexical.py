"""Ranked lexical search, term at a time with a limited number of accumulators.

The documents become blocks of an inverted file that holds the postings of the
queries' terms.  Every block answers all items by itself: an item's terms are
taken rarest first; while a document not seen so far could still reach the
k-th best partial score, postings create accumulators, and from the moment
that the remaining terms' bounds can't, they only update the survivors, whose
scores become exact.  The k-th score that a task has reached carries over to
its next blocks.  Tasks return k rows an item, merged in two steps.

Items are taken in groups of about ``QUERY_BYTES`` of text, so that what is
sent to the tasks has a fixed bound (or is a single item), and every group is
searched in all documents.

Defined results: a null or termless text matches nothing and counts in no
statistic; repeated document rows are documents of their own, a null
``doc_id`` ranks behind others of its score; rows that repeat an ``item_id``
are one item with the smallest text; without documents or items the result is
empty.  Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitepanel.llm.registry import query
from sitepanel.llm.store import documents, durable

BLOCK = 4096
QUERY_BYTES = 1 << 22
# Tasks whose best rows are merged first, so no task reads the rows of all others.
MERGED = 64
# Fixed values of the score.
IDF_SCALE, IMPACT_SCALE, K_TF, K_LENGTH, FLAT, SLOPE = 1000, 1_000_000_000, 1000, 12, 75, 25

# Terms are runs of digits, letters and bytes above ASCII; only A-Z change case.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)

INDEX = (
    "ids binary, unnamed binary, lengths binary, n_docs long, n_terms long, "
    "terms array<int>, df array<long>, docs binary, tfs binary"
)
HITS = "item_id long, doc_id long, score long, merged int"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TERM_BYTES).split() if text else []


def _index_block(ids: list[int | None], counts: list[Counter], lengths: list[int], vocabulary: dict[bytes, int]) -> dict:
    """One block of the inverted file: postings by term, each in order of documents."""
    terms, docs, tfs = [], [], []
    for place, count in enumerate(counts):
        known = [(vocabulary[t], n) for t, n in count.items() if t in vocabulary]
        terms += [t for t, _ in known]
        tfs += [n for _, n in known]
        docs += [place] * len(known)
    terms = np.array(terms, dtype=np.int32)
    order = np.argsort(terms, kind="stable")
    names, df = np.unique(terms, return_counts=True)
    lengths = np.array(lengths, dtype=np.int64)
    return {
        "ids": np.array([i or 0 for i in ids], dtype=np.int64).tobytes(),
        "unnamed": np.array([i is None for i in ids], dtype=bool).tobytes(),
        "lengths": lengths.tobytes(),
        "n_docs": int((lengths > 0).sum()),
        "n_terms": int(lengths.sum()),
        "terms": names.tolist(),
        "df": df.tolist(),
        "docs": np.array(docs, dtype=np.uint16)[order].tobytes(),
        "tfs": np.array(tfs, dtype=np.uint32)[order].tobytes(),
    }


def inverted_file(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of at most ``BLOCK`` documents with the postings of the vocabulary's terms, written once."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([
        ("ids", pa.binary()), ("unnamed", pa.binary()), ("lengths", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
        ("terms", pa.list_(pa.int32())), ("df", pa.list_(pa.int64())), ("docs", pa.binary()), ("tfs", pa.binary()),
    ])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        ids, counts, lengths = [], [], []

        def block():
            return pa.RecordBatch.from_pylist([_index_block(ids, counts, lengths, known)], schema=schema)

        for batch in batches:
            for number, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms = terms_of(value.as_py())
                ids.append(number)
                lengths.append(len(terms))
                counts.append(Counter(terms))
                counts[-1] = {t: n for t, n in counts[-1].items() if t in known}
                if len(ids) == BLOCK:
                    yield block()
                    ids, counts, lengths = [], [], []
        if ids:
            yield block()

    rows = docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string"))
    index = durable(rows.mapInArrow(build, INDEX))
    shared.unpersist()
    return index


def term_weight(documents_with_terms: int, df: int) -> int:
    return math.floor(IDF_SCALE * math.log((2 * documents_with_terms + 2) / (2 * df + 1)))


class Block:
    """One block of the inverted file with the impacts of its postings."""

    def __init__(self, row: dict, n: int, total: int):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.unnamed = np.frombuffer(row["unnamed"], dtype=bool)
        lengths = np.frombuffer(row["lengths"], dtype=np.int64)
        self.norms = K_LENGTH * (FLAT + (SLOPE * lengths * n) // max(total, 1))
        ends = np.cumsum(row["df"])
        self.ranges = {t: (int(e - d), int(e)) for t, d, e in zip(row["terms"], row["df"], ends)}
        self.docs = np.frombuffer(row["docs"], dtype=np.uint16).astype(np.int64)
        self.tfs = np.frombuffer(row["tfs"], dtype=np.uint32).astype(np.int64)
        self.seen: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Documents, impacts and the largest impact of a term, None where no document holds it."""
        if term not in self.ranges:
            return None
        if term not in self.seen:
            start, end = self.ranges[term]
            docs, tf = self.docs[start:end], self.tfs[start:end]
            impacts = (IMPACT_SCALE * tf) // (K_TF * tf + self.norms[docs])
            self.seen[term] = docs, impacts, int(impacts.max())
        return self.seen[term]


def search_block(block: Block, terms: Sequence[tuple[int, int]], k: int, reached: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the block that may be among the k best, and their exact scores.

    ``terms`` are (term, weight) pairs, rarest first; ``reached`` is a score that
    k documents of other blocks have, or 0.
    """
    held = [(p, w) for p, w in ((block.postings(t), w) for t, w in terms) if p and w]
    bounds = np.array([w * most for (_, _, most), w in held], dtype=np.int64)
    rest = np.cumsum(bounds[::-1])[::-1]
    size = len(block.ids)
    scores = np.zeros(size, dtype=np.int64)
    alive = np.zeros(size, dtype=bool)
    creating, threshold = True, reached
    for ((docs, impacts, _), weight), still in zip(held, rest):
        if creating:
            if size > k:
                threshold = max(threshold, int(np.partition(scores, size - k)[size - k]))
            # a document that isn't seen yet ends below the k-th partial score
            creating = still >= threshold
        if creating:
            scores[docs] += weight * impacts
            alive[docs] = True
        else:
            survive = alive[docs]
            scores[docs[survive]] += weight * impacts[survive]
    found = np.flatnonzero(alive & (scores >= max(reached, 1)))
    if len(found) > k:
        least = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= least]
    return found, scores[found]


def _item_groups(items: DataFrame) -> DataFrame:
    """``items`` with a group number; a group holds about QUERY_BYTES of text, or one item."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    total, count = items.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, math.ceil(total / QUERY_BYTES))
    while True:
        grouped = items.withColumn("group", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))
        sizes = grouped.groupBy("group").agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n"))
        worst = sizes.filter(F.col("n") > 1).agg(F.max("b")).first()[0] or 0
        if worst <= 4 * QUERY_BYTES or groups > 64 * count:
            return grouped.withColumn("groups", F.lit(groups))
        groups *= 2


def _search_group(docs: DataFrame, items: list[tuple[int | None, str | None]], k: int) -> DataFrame:
    spark = docs.sparkSession
    wanted = [Counter(terms_of(text)) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
    index = inverted_file(docs, vocabulary)
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    pairs = index.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).select("p.terms", "p.df")
    df = {r[0]: r[1] for r in pairs.groupBy("terms").agg(F.sum("df")).collect()}  # at most the group's own terms
    plans = []
    for (item, _), count in zip(items, wanted):
        known = [(df[i], i, repeats) for i, repeats in ((vocabulary[t], c) for t, c in count.items()) if i in df]
        plans.append((item, [(i, repeats * term_weight(n, d)) for d, i, repeats in sorted(known)]))
    shared = spark.sparkContext.broadcast(plans)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int]]] = [[] for _ in shared.value]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, n, total)
                for place, (_, terms) in enumerate(shared.value):
                    mine = best[place]
                    found, scores = search_block(block, terms, k, -mine[-1][0] if len(mine) == k else 0)
                    if len(found):
                        mine += zip((-scores).tolist(), block.unnamed[found].tolist(), block.ids[found].tolist())
                        best[place] = heapq.nsmallest(k, mine)
        merged = TaskContext.get().partitionId() // MERGED
        hits = [
            (item, None if unnamed else number, -score)
            for (item, _), rows in zip(shared.value, best)
            for score, unnamed, number in rows
        ]
        columns = list(zip(*hits)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in columns], pa.array([merged] * len(hits), pa.int32())],
            names=["item_id", "doc_id", "score", "merged"],
        )

    hits = durable(index.mapInArrow(search, HITS))
    shared.unpersist()
    return hits


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents of every item: ``item_id rank doc_id score``.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``.
    """
    spark = docs.sparkSession
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    grouped = durable(_item_groups(plain.groupBy("item_id").agg(F.min("text").alias("text"))))
    groups = grouped.agg(F.coalesce(F.max("groups"), F.lit(0))).first()[0]
    hits = spark.createDataFrame([], HITS)
    for group in range(groups):
        members = [(r[0], r[1]) for r in grouped.filter(F.col("group") == group).select("item_id", "text").collect()]
        if members:
            hits = hits.unionByName(_search_group(docs, members, k))
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = F.row_number()
    first = hits.withColumn("rank", rank.over(W.partitionBy("item_id", "merged").orderBy(*best))).filter(F.col("rank") <= k)
    last = first.withColumn("rank", rank.over(W.partitionBy("item_id").orderBy(*best))).filter(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RANKED_SQL = f"""WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all({_LOWER.format('text')}, '{_TERM}') AS words FROM documents),
sized AS (SELECT row_id, doc_id, len(words) AS n FROM texts WHERE len(words) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sized),
normed AS (SELECT row_id, doc_id, 75 + ((CAST(25 AS HUGEINT) * n * nn) // ll) AS m FROM sized, totals),
items AS (SELECT item_id, unnest(regexp_extract_all({_LOWER.format('min(text)')}, '{_TERM}')) AS term FROM benchmark GROUP BY item_id),
asked AS (SELECT item_id, term, count(*) AS repeats FROM items GROUP BY ALL),
tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(words) AS term FROM texts)
       WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0 * nn + 2) / (2.0 * df + 1))) AS BIGINT) AS w FROM df, totals),
scores AS (
  SELECT item_id, doc_id, row_id, CAST(sum(repeats * w * ((CAST(1000000000 AS HUGEINT) * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN normed USING (row_id) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20"""


@query("op11_ranked_search", RANKED_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return ranked_search(documents(spark, sf_dir, "doc_id", "text"), items)
