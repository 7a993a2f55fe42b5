"""Cases that the reviewer of round 4 found to fail."""

import numpy as np
import pytest

from sitepanel.llm import contextmix as cm
from sitepanel.llm import vafile
from sitepanel.operators.moments import PooledMoments, SizeClasses
from sitepanel.operators.subsets import SubsetTree
from tests.test_models import found, pooled_sample


def repeated(pooled: PooledMoments, times: int) -> PooledMoments:
    """The same sites ``times`` over, under other names."""
    c = pooled.classes
    return PooledMoments(pooled.names, pooled.shift, SizeClasses(c.sizes, c.weights * times, c.inner * times, c.outer * times))


@pytest.mark.parametrize("reml", [False, True])
@pytest.mark.parametrize("times", [1, 100, 10_000, 1_000_000])
def test_bounded_search_of_many_sites_keeps_the_best(reml, times):
    """The more sites, the sharper the likelihood's peak, which lies between the points of any grid."""
    terms = ["a", "b", "c", "d", "a:b", "c:d"]
    for seed in range(6):
        pooled = repeated(pooled_sample(terms, effects=(0.5, 0.1, 0.05, 0.3, 0.08, 0.2), seed=seed), times)
        every = found(SubsetTree(pooled, "y", terms, reml))
        best = min(row[4] for row in every.values())
        tree = SubsetTree(pooled, "y", terms, reml, within=2.0)
        tree.descend()
        some = found(tree, branches=6)
        assert {s for s, row in every.items() if row[4] <= best + 2.0} <= set(some)
        assert len(some) < len(every)


def products(vectors: np.ndarray, queries: range, k: int) -> list[tuple]:
    whole = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    score = whole @ whole.T
    out = []
    for q in queries:
        best = [i for i in np.lexsort((np.arange(len(vectors)), -score[q])) if i != q][:k]
        out += [(q, r + 1, int(i), int(score[q, i])) for r, i in enumerate(best)]
    return out


# whole numbers of 16 bits, of more, and with products that no double holds
@pytest.mark.parametrize("spread,size", [(1.0, 6000), (1e3, 900), (1e5, 900)])
def test_blocks_of_queries_are_not_copied_to_every_block_of_vectors(spark, monkeypatch, spread, size):
    monkeypatch.setattr(vafile, "VECTORS", 64)
    monkeypatch.setattr(vafile, "GROUPS", 4, raising=False)
    monkeypatch.setattr(vafile, "CHUNK", 2, raising=False)
    vectors = (np.random.default_rng(2).normal(size=(size, 16)) * spread).round(2).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    # what the driver is sent for a broadcast join; the copies of 4 blocks of queries for 94 of vectors are 12 MB
    spark.conf.set("spark.sql.maxBroadcastTableSize", "8m")
    try:
        got = sorted(tuple(r) for r in vafile.top_k(rows, rows.filter("vec_id % 6 = 0")).collect())
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert got == products(vectors, range(0, size, 6), 5)


@pytest.mark.parametrize("at_once", [1 << 21, 3])
def test_a_large_table_of_contexts_has_few_parts(spark, monkeypatch, at_once):
    """Each group of texts asks each part, so more parts and more groups would be more rows than either."""
    monkeypatch.setattr(cm, "KEYS_AT_ONCE", at_once, raising=False)
    words = [f"w{k}" for k in range(3000)]
    coder = cm.Coder([w.encode() for w in words], [10] * len(words), 8, 5, bits=33)
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(words, 3000)) for _ in range(2)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    table = cm.count_contexts(frame, spark.sparkContext.broadcast(coder))
    assert table.count() <= 2048
    keys = np.concatenate([cm.slots(coder, p[0]) * 2 + np.tile(p[1], cm.INPUTS) for p in coder.pieces(texts)])
    found, n = np.unique(keys, return_counts=True)
    got = []
    for r in table.orderBy("part").collect():
        slots = cm.from_rising(r["keys"]).astype(np.int64)
        got += zip((slots + (r["part"] << (coder.part_bits + 1))).tolist(), cm.from_whole_planes(r["n"], len(slots)).tolist())
    assert got == list(zip(found.tolist(), n.tolist()))


def test_sorted_sums_and_places():
    rng = np.random.default_rng(4)
    for wanted in (rng.integers(0, 50, 1000), rng.integers(0, 1 << 62, 1000), np.zeros(0, dtype=np.int64)):
        found, at = np.unique(wanted, return_inverse=True)
        values = rng.integers(-99, 99, len(found)).astype(np.int16)
        assert (cm.distinct(wanted) == found).all() and (cm.spread_out(wanted, values) == values[at]).all()
    for most in (5, 1 << 31, 1 << 40):
        keys, n = rng.integers(0, 1 << 32, 700).astype("<u4").repeat(2), rng.integers(1, most, 1400)
        found, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(found), dtype=np.int64)
        np.add.at(total, at, n)
        assert (cm.merged(keys, n)[0] == found).all() and (cm.merged(keys, n)[1] == total).all()
        assert (cm.from_whole_planes(cm.whole_planes(n), len(n)) == n).all()
    assert [len(x) for x in cm.merged(np.zeros(0, "<u4"), np.zeros(0, np.int64))] == [0, 0]
    assert len(cm.from_whole_planes(cm.whole_planes(np.zeros(0, np.int64)), 0)) == 0
