import math

import numpy as np
import pytest

from sitepanel.llm import vafile
from sitepanel.llm.vafile import op3_topk, top_k


def brute(rows, queries, k=5):
    ok = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in e)) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    asked = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in e)) for i, e in queries if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, e in asked:
        scored = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in ok if i != q and len(f) == len(e))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def result(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("vectors,queries", [(64, 16), (4096, 256)])
def test_against_brute_force(spark, monkeypatch, vectors, queries):
    monkeypatch.setattr(vafile, "VECTORS", vectors)
    monkeypatch.setattr(vafile, "QUERIES", queries)
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=12).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(80)]  # many equal ones
    rows += [(2000 + i, [float(x) for x in rng.integers(-1, 2, 12)]) for i in range(100)]  # ties
    docs = frame(spark, rows)
    got = result(top_k(docs, docs.filter("vec_id % 20 = 0")))
    assert got == brute(rows, [r for r in rows if r[0] % 20 == 0])


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, -3.0]),
        (6, [1.0, 2.0, 3.0]), (7, []), (8, []), (50, [1.0, 2.0]), (None, [9.0, 9.0]), (9, [-1e-9, 1e-9]),
    ]
    docs = frame(spark, rows)
    assert result(top_k(docs, docs)) == brute(rows, rows)
    outside = frame(spark, [(77, [3.0, 1.0]), (78, [3.0, 1.0])])
    assert result(top_k(docs, outside, k=2)) == brute(rows, [(77, [3.0, 1.0]), (78, [3.0, 1.0])], 2)
    assert result(top_k(docs.filter("false"), docs.filter("false"))) == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert result(op3_topk(spark, folder)) == brute(rows, [r for r in rows if r[0] % 50 == 0])


def test_large_components_take_part(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=6) * 10.0 ** rng.integers(0, 9)).astype(np.float32).tolist()) for k in range(60)]
    rows += [(100 + k, (rng.normal(size=6) * 10.0 ** rng.integers(6, 30)).astype(np.float32).tolist()) for k in range(60)]
    rows += [(200, [-3e38] * 6), (201, [3e38] * 6), (202, [-0.0] * 6), (203, [0.0] * 6)]
    docs = frame(spark, rows)
    want = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in brute(rows, rows)]
    assert result(top_k(docs, docs)) == want
