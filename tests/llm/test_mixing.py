import numpy as np
import pytest
from pyspark.sql import functions as F

from sitepanel.llm.mixing import (
    dealt, draw_count, mixed_documents, op1_mix, plan_mix, shard_texts, source_rows, split_shards, targets, word_count,
)


def reshared(sizes, weights):
    """The rule as stated, by rounds."""
    total, cap = 1.5 * sum(sizes), [2.0 * s for s in sizes]
    got, free, excess = [0.0] * len(sizes), set(range(len(sizes))), total
    while excess > 1e-9 and free:
        w = sum(weights[k] for k in free)
        for k in free:
            got[k] += excess * weights[k] / w
        excess = sum(max(0, g - c) for g, c in zip(got, cap))
        got = [min(g, c) for g, c in zip(got, cap)]
        free = {k for k in free if got[k] < cap[k]}
    return got


def test_targets_follow_the_rule():
    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes = [int(x) for x in rng.integers(0, 1000, rng.integers(1, 9))]
        weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
        assert targets(sizes, weights) == pytest.approx(reshared(sizes, weights), abs=1e-6)


def test_draw_count_matches_a_walk():
    rng = np.random.default_rng(6)
    for seed in range(300):
        sizes = {f"s{k}": int(x) for k, x in enumerate(rng.integers(1, 400, 4))}
        for row in source_rows(sizes, (5, 2, 1), 1.5, 2.0, int(rng.integers(1, 60)), seed):
            size, words, block, blocks, last = row[2], row[4], row[5], row[6], row[7]
            left = words
            draws = 0
            while left > 0:
                e, p = divmod(draws, blocks)
                left -= last if p == row[10][e] else block
                draws += 1
            assert draw_count(row) == draws and words <= 2 * size


def test_tree_deals_every_draw_once(spark):
    draws = [0, 1, 700, 33, 256]
    leaves = split_shards(spark, draws, 7, 3).collect()
    for rank, n in enumerate(draws):
        got = sorted(d for r in leaves if r["rank"] == rank for d in range(r["first"], r["first"] + r.draws))
        assert got == list(range(n))
    per = [sum(r.draws for r in leaves if r.shard == k) for k in range(7)]
    assert max(per) - min(per) <= 3


def sample(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        source = ["a", "b", "é", "Z", None][min(4, int(rng.integers(0, 9)) // 2)]
        n = int(rng.integers(0, 30)) if i % 50 else 3000
        rows.append((i, " ".join(f"w{i}x{k}" for k in range(n)), source, 7, "clash"))
    rows += [(900, None, "a", 7, "c"), (901, " \t\n ", "a", 7, "c"), (902, "one", "empty?", 7, "c"), (903, "", "void", 7, "c")]
    rows += [(904, "same words here", "a", 7, "c")] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string")


def test_plan_takes_the_targets(spark):
    docs = sample(spark)
    plan, rows = plan_mix(docs, block_words=16)
    plan = plan.cache()
    assert plan.count() == docs.count()
    taken = plan.select("rank", "doc_id", "size", F.expr("aggregate(spans, 0L, (a, s) -> a + s.words)").alias("t")).collect()
    assert all(r.t <= 2 * r["size"] for r in taken)
    for row in rows:
        assert sum(r.t for r in taken if r["rank"] == row[1]) == row[4]
    again, _ = plan_mix(docs.repartition(7), block_words=16)
    assert sorted(map(str, again.collect())) == sorted(map(str, plan.collect()))


def test_shard_texts_hold_the_words(spark):
    docs = sample(spark).filter("doc_id < 400")
    plan, rows = plan_mix(docs, block_words=16)
    pieces = shard_texts(plan, rows, 5).collect()
    from collections import Counter

    seen = Counter(w for r in pieces for w in r.text.split())
    assert sum(seen.values()) == sum(r[4] for r in rows) and max(seen.values()) <= 2
    assert {r.shard for r in pieces} == set(range(5))
    assert dealt(plan, rows, 5).count() == len(pieces)


def test_pipeline_form_and_empty_table(spark):
    docs = sample(spark).withColumn("n_chars", F.length("text"))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    _, rows = plan_mix(docs)
    assert mixed.select(F.sum(word_count(F.col("text")))).first()[0] == sum(r[4] for r in rows)
    none = docs.filter("false")
    assert mixed_documents(none).collect() == []
    plan, rows = plan_mix(none)
    assert dealt(plan, rows, 1).collect() == []


def test_query(spark):
    got = op1_mix(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(docs)
    by = {}
    for r in got:
        assert r["size"] == len(docs[r.doc_id].text.split()) and r.taken <= 2 * r["size"]
        s = by.setdefault(docs[r.doc_id].source, [0, 0, r.target, r.source_size])
        s[0] += r.taken
        s[1] += r["size"]
    for taken, size, target, source_size in by.values():
        assert size == source_size and abs(taken - target) <= 1


def test_pipeline_form_is_dealt_to_shards(spark):
    docs = sample(spark)
    _, rows = plan_mix(docs)
    mixed = mixed_documents(docs, shard_words=4000).select("doc_id", "text", F.spark_partition_id().alias("at")).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r[4] for r in rows)
    # long documents are shared by shards, and no part has them in the order of the plan
    assert max(sum(r.doc_id == k for r in mixed) for k in range(0, 400, 50)) > 2
    seen = [r.doc_id for r in mixed if r.at == mixed[0].at]
    assert seen != sorted(seen)


def test_columns_of_any_name_stay(spark):
    docs = sample(spark)
    names = ["_hash", "_rank", "_words", "_others", "_shard", "rank", "words", "_spans", "c0"]
    more = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in names})
    plain, mixed = mixed_documents(docs), mixed_documents(more)
    assert mixed.columns == more.columns
    rows = mixed.collect()
    assert all(r[c] == (None if r.doc_id is None else f"{c}-{r.doc_id}") for r in rows for c in names)
    key = lambda r: (str(r.doc_id), r.text)
    assert sorted(map(key, rows)) == sorted(map(key, plain.collect()))
    plan, sources = plan_mix(more)
    assert {"_hash", "_rank", "_words", "_others"} <= set(plan.columns)
    assert shard_texts(plan, sources, 3).select("_rank", "_hash").count() > 0
