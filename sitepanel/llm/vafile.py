"""Exact top-k search by inner product with vector-approximation files.

Every component of a vector is cut to a cell of an even grid.  A query's inner
product with a cell's lower corner, plus a slack of the query alone, bounds its
product with any vector in the cell.  Blocks of queries scan groups of blocks of
cells, block after block; exact vectors are only compared where the bound isn't
below the k-th best product that the query has met so far.  A group of blocks and
a chunk of queries meet in one task, so a query travels once to each group and a
vector once to each chunk; both are bounded by memory.  Each group's few best of
a query are merged.

Equal vectors are one entry with their k + 1 smallest ids, queries with equal
vectors are one query; a group of copies therefore costs as much as one vector.

Defined results: a vector that is null, or holds a null or non-finite component
takes no part, nor does a row without id; a score that no long can hold is given
as the nearest one, but ranked as it is; vectors of another length than the query's
are no candidates; a repeated id is listed once per row that has it, but never
for the query of the same id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitepanel.llm.registry import query
from sitepanel.llm.store import durable

CELLS = 256  # per dimension: a byte
VECTORS, QUERIES = 4096, 256  # per block
GROUPS, MOST_BLOCKS = 32, 64  # of vectors: about so many groups, but no more blocks in one
CHUNK = 512  # blocks of queries
SMALL = (1 << 15) - 1  # components that two bytes hold
WHOLE = 2.0**53  # sums of whole numbers below are exact
PAIRS_AT_ONCE = 1 << 20  # components
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1


def usable(embedding: Column) -> Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & fine, F.lit(False))


def scaled(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``id vector dims`` of the rows that take part; vectors as packed whole numbers, of 16 bits where all are small, else 64-bit floats, which hold every one."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.filter(usable(F.col("e")) & F.col("id").isNotNull())

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        whole = lambda v: np.floor(float(scale) * np.asarray(v, dtype="<f8")) + 0.0  # no negative zero
        return pd.Series([packed(whole(v)) for v in vectors], dtype=object)

    rows = rows.filter(F.forall("e", lambda x: F.abs(F.lit(float(scale)) * x) < float("inf")))
    return rows.select("id", pack(F.col("e")).alias("vector"), F.size("e").alias("dims"))


def packed(whole: np.ndarray) -> bytes:
    return whole.astype("<i2" if np.abs(whole).max(initial=0.0) <= SMALL else "<f8").tobytes()


def from_packed(body: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(body, dtype="<i2" if len(body) == 2 * rows * dims else "<f8").reshape(rows, dims)


def unpacked(column: pd.Series, dims: int) -> np.ndarray:
    out = np.empty((len(column), dims))
    small = np.array([len(v) == 2 * dims for v in column], dtype=bool)
    for width, some in ((2, small), (8, ~small)):
        out[some] = np.frombuffer(b"".join(column[some]), dtype="<i2" if width == 2 else "<f8").reshape(-1, dims) if dims else 0.0
    return out


def entries(vectors: DataFrame, copies: int) -> DataFrame:
    """``entry vector dims ids``: distinct vectors, by their smallest id, with ``copies`` ids at most."""
    place = F.row_number().over(W.partitionBy("vector", "dims").orderBy("id"))
    few = vectors.withColumn("_place", place).filter(F.col("_place") <= copies)
    return few.groupBy("vector", "dims").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.element_at("ids", 1).alias("entry"), "vector", "dims", "ids"
    )


def grid(found: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per vector length: the least value and the cell width of each dimension."""

    def extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, rows in batch.groupby("dims"):
                v = unpacked(rows["vector"], int(dims))
                yield pd.DataFrame({"dims": int(dims), "at": np.arange(int(dims)), "low": v.min(axis=0), "high": v.max(axis=0)})

    sides = found.select("vector", "dims").mapInPandas(extremes, "dims int, at int, low double, high double")
    out: dict[int, tuple[list, list]] = {}
    for r in sides.groupBy("dims", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dims", "at").collect():
        low, width = out.setdefault(r.dims, ([], []))
        low.append(r.low)
        width.append((r.high - r.low) // CELLS + 1)
    return {d: (np.array(a, dtype=np.float64), np.array(w, dtype=np.float64)) for d, (a, w) in out.items()}


def blocks(found: DataFrame, number: int, grids: dict | None) -> DataFrame:
    """``block dims ids cells body``: the entries in ``number`` blocks; cells only with ``grids``."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        dims = int(part["dims"].iloc[0])
        part = part.sort_values("entry")
        v = unpacked(part["vector"], dims)
        cells = b""
        if grids is not None:
            low, width = grids.get(dims, (0, 1))
            cells = np.clip((v - low) // width, 0, CELLS - 1).astype(np.uint8).tobytes()
        ids = part["entry"].to_numpy(dtype="<i8").tobytes()
        return pd.DataFrame({"block": [int(part["block"].iloc[0])], "dims": [dims], "ids": [ids], "cells": [cells], "body": [packed(v)]})

    numbered = found.select("entry", "vector", "dims", F.pmod(F.xxhash64("entry"), F.lit(number)).alias("block"))
    return numbered.groupBy("block", "dims").applyInPandas(pack, "block long, dims int, ids binary, cells binary, body binary")


class Leaders:
    """The ``keep`` best entries of each query of a block so far, by score, then by smallest id."""

    def __init__(self, q: np.ndarray, most: float, low: np.ndarray, width: np.ndarray, keep: int):
        self.q, self.keep, self.width = q, keep, width
        dims = q.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            # products of whole numbers that a double can't tell apart go by Python's integers
            self.sure = float(np.abs(q).max(initial=0.0)) * most * dims < WHOLE
            reach = np.abs(q) @ (np.abs(low) + CELLS * width)
            narrow = float(reach.max(initial=0.0)) < 1e37
            self.side = (q * width).astype(np.float32 if narrow else np.float64)
            rounding = reach * ((dims + 8) * (1.2e-7 if narrow else 1e-14) + 1e-9) + 1.0
            # a cell's upper bound, less its place in the grid
            self.over = q @ low + np.maximum(q, 0) @ (width - 1.0) + rounding
        self.least = np.full(len(q), -np.inf)
        self.at, self.score, self.entry = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)
        self.exact: list[list[tuple[int, int]]] = [[] for _ in q]

    def scan(self, ids: np.ndarray, cells: np.ndarray, v: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            corner = self.side @ cells.astype(self.side.dtype).T
            if not self.sure:
                self._scan_exactly(ids, corner, v)
                return
            if np.isinf(self.least).any() and len(ids) >= self.keep:
                # a first few by their bounds
                few = np.argpartition(-corner, self.keep - 1, axis=1)[:, : self.keep]
                i = np.repeat(np.arange(len(self.q)), self.keep)
                first = self._products(i, few.ravel(), v).reshape(-1, self.keep)
                self.least = np.maximum(self.least, first.min(axis=1))
            # what can't be told is looked at
            cut = np.nextafter((self.least - self.over).astype(corner.dtype), corner.dtype.type(-np.inf))
            i, j = np.nonzero(~(corner < cut[:, None]))
        if not len(i):
            return
        if len(i) * 8 > corner.size:
            score = (self.q @ v.T.astype(np.float64))[i, j]
        else:
            score = self._products(i, j, v)
        at = np.concatenate([self.at, i])
        score, entry = np.concatenate([self.score, score]), np.concatenate([self.entry, ids[j]])
        fine = score >= self.least[at]
        at, score, entry = at[fine], score[fine], entry[fine]
        order = np.lexsort((entry, -score, at))
        at, score, entry = at[order], score[order], entry[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        some = place < self.keep
        self.at, self.score, self.entry = at[some], score[some], entry[some]
        last = place == self.keep - 1
        self.least[at[last]] = score[last]

    def _products(self, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> np.ndarray:
        out, lot = np.empty(len(i)), max(1, PAIRS_AT_ONCE // max(1, v.shape[1]))
        for a in range(0, len(i), lot):
            out[a : a + lot] = np.einsum("pd,pd->p", self.q[i[a : a + lot]], v[j[a : a + lot]].astype(np.float64))
        return out

    def _scan_exactly(self, ids: np.ndarray, corner: np.ndarray, v: np.ndarray) -> None:
        for k, held in enumerate(self.exact):
            upper = corner[k].astype(np.float64) + self.over[k]
            # the best bounds first, a few at a time, each lot with what the lot before found
            order = np.argsort(-np.where(np.isnan(upper), np.inf, upper), kind="stable")
            for a in range(0, len(order), 4 * self.keep):
                some = order[a : a + 4 * self.keep]
                some = some[~(upper[some] < self.least[k])]
                if not len(some):
                    break
                held += [(-dot(self.q[k], v[j].astype(np.float64)), int(ids[j])) for j in some]
                held.sort()
                del held[self.keep :]
                if len(held) == self.keep:
                    try:
                        self.least[k] = np.nextafter(float(-held[-1][0]), -np.inf)
                    except OverflowError:
                        self.least[k] = -np.inf if held[-1][0] > 0 else np.finfo(float).max

    def rows(self, q_ids: np.ndarray) -> pd.DataFrame:
        """``q entry score beyond`` of what is held."""
        if self.sure:
            return pd.DataFrame({"q": q_ids[self.at], "entry": self.entry, "score": self.score.astype(np.int64), "beyond": "m"})
        found = [(int(q), entry, *within_long(-score)) for q, held in zip(q_ids, self.exact) for score, entry in held]
        return pd.DataFrame(found, columns=["q", "entry", "score", "beyond"])


def scan(v_blocks: DataFrame, q_blocks: DataFrame, v_number: int, q_number: int, grids: dict, keep: int) -> DataFrame:
    """``q entry score beyond``: the ``keep`` best entries of each query, from so many blocks of vectors and of queries."""
    share = min(MOST_BLOCKS, max(1, -(-v_number // GROUPS)))  # blocks of a group
    n_groups, n_chunks = -(-v_number // share), -(-q_number // CHUNK)

    def look(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        lots = []
        if len(held) and len(asked):
            dims = int(held["dims"].iloc[0])
            low, width = grids[dims] if dims else (np.zeros(0), np.zeros(0))
            file = []
            for ids, cells, body in zip(held["ids"], held["cells"], held["body"]):
                n = len(ids) // 8
                file.append((np.frombuffer(ids, dtype="<i8"), np.frombuffer(cells, dtype=np.uint8).reshape(n, dims), from_packed(body, n, dims)))
            most = max(float(np.abs(v.astype(np.float64)).max(initial=0.0)) for _, _, v in file)
            for block, ids, body in zip(asked["block"], asked["ids"], asked["body"]):
                q = from_packed(body, len(ids) // 8, dims).astype(np.float64)
                leaders = Leaders(q, most, low, width, keep)
                for lot in file:
                    leaders.scan(*lot)
                best = leaders.rows(np.frombuffer(ids, dtype="<i8"))
                numbers = [best[c].to_numpy(dtype="<i8").tobytes() for c in ("q", "entry", "score")]
                lots.append((dims, int(block), *numbers, ",".join(best["beyond"]) if (best["beyond"] != "m").any() else None))
        return pd.DataFrame(lots, columns=["dims", "block", "q", "entry", "score", "beyond"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        several = []
        for q, entry, score, beyond in zip(rows["q"], rows["entry"], rows["score"], rows["beyond"]):
            of = {n: np.frombuffer(x, dtype="<i8") for n, x in (("q", q), ("entry", entry), ("score", score))}
            several.append(pd.DataFrame({**of, "beyond": beyond.split(",") if beyond else "m"}))
        every = pd.concat(several).sort_values(["q", "score", "beyond", "entry"], ascending=[True, False, False, True])
        return every.groupby("q").head(keep)

    keys = ["dims", "group", "chunk"]
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = v_blocks.select("*", F.expr(f"block div {share}").alias("group"), each(n_chunks).alias("chunk"))
    right = q_blocks.select("block", "dims", "ids", "body", F.expr(f"block div {CHUNK}").alias("chunk"), each(n_groups).alias("group"))
    count = max(2, 2 * n_groups * n_chunks)
    both = left.repartition(count, *keys).groupBy(*keys).cogroup(right.repartition(count, *keys).groupBy(*keys))
    some = both.applyInPandas(look, "dims int, block long, q binary, entry binary, score binary, beyond string")
    return some.groupBy("dims", "block").applyInPandas(merge, "q long, entry long, score long, beyond string")


def dot(a: np.ndarray, b: np.ndarray) -> int:
    """The exact inner product of whole numbers."""
    if not len(a):
        return 0
    most_a, most_b = float(np.abs(a).max()), float(np.abs(b).max())
    if max(most_a, most_b) < 2.0**62 and most_a * most_b * len(a) < 2.0**62:
        return int(a.astype(np.int64) @ b.astype(np.int64))
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist()))


def within_long(n: int) -> tuple[int, str]:
    """The nearest long, and a string that ranks what lies beyond the longs."""
    if LEAST_LONG <= n <= MOST_LONG:
        return n, "m"
    digits = f"{len(str(abs(n))):04d}{abs(n)}"
    if n > 0:
        return MOST_LONG, "p" + digits
    return LEAST_LONG, "a" + digits.translate(str.maketrans("0123456789", "9876543210"))


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id rank vec_id score``: for each row of ``queries`` (both: vec_id, embedding) its k best others."""
    keep = k + 1
    found = durable(entries(scaled(embeddings, scale), keep))
    wanted = scaled(queries, scale).join(found.select("vector", "dims", F.col("entry").alias("q")), ["vector", "dims"], "left")
    # a query that is no candidate itself is an entry of its own, under an id no candidate has
    own = -F.min("id").over(W.partitionBy("vector", "dims")) - F.lit(1 << 62)
    wanted = durable(wanted.select("id", "vector", "dims", F.coalesce("q", own).alias("q")))
    asked = wanted.select(F.col("id").alias("query_id"), "q")
    grids = grid(found)
    q_entries = wanted.select(F.col("q").alias("entry"), "vector", "dims").dropDuplicates(["entry"]).filter(F.col("dims").isin([*grids, 0]))
    v_number, q_number = max(1, -(-found.count() // VECTORS)), max(1, -(-q_entries.count() // QUERIES))
    best = scan(blocks(found, v_number, grids), blocks(q_entries, q_number, None), v_number, q_number, grids, keep)
    scores = durable(best).join(found.select("entry", "ids"), "entry")
    each = scores.select("q", "score", "beyond", F.explode("ids").alias("vec_id"))
    order = W.partitionBy("q").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    few = each.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= keep)
    answer = asked.distinct().join(few, "q").filter("vec_id != query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return answer.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


@query("op3_topk", SQL)
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.filter("vec_id % 50 = 0"))
