import random
import tracemalloc

import numpy as np
import pytest

from sitepanel.llm import components as components_module
from sitepanel.llm.components import components
from sitepanel.llm.neardup import near_duplicates, op5_neardup
from sitepanel.llm.setsketch import band_keys, likeliest_jaccard, merge, sketches
from sitepanel.llm.wordhash import in_pieces, mix, shingle_sets


def brute(rows, words=5):
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(words, rng, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_whole_groups_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for group in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(6, 160))]
        for _ in range(rng.choice([1, 3, 40])):
            rows.append((len(rows) * 3 + 5, edited(base, rng, rng.randrange(0, max(2, len(base) // 20)))))
    rows += [(1000, "Too few words"), (1001, "too FEW\twords"), (1002, None), (1003, ""), (1004, " \n"), (1005, "one"), (1006, "É x"), (1007, "é x")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, i, "s") for i, t in rows], "doc_id long, text string, id long, first string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "z " * 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == [(0, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True)]
    assert near_duplicates(docs.filter("false")).collect() == []


def test_components(spark):
    links = [(1, 2), (2, 1), (5, 4), (4, 3), (9, 9), (7, None)] + [(k, k + 1) for k in range(100, 160)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 9: 9} | {k: 100 for k in range(100, 161)}
    assert got == want


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    values = mix(rng.integers(0, 2**62, 1500).astype(np.uint64))
    a, b = values[:1000], values[500:]
    one, two, union = sketches([a, b, values])
    assert (merge(one, two) == union).all()
    assert likeliest_jaccard(one[None], two[None], np.array([1000.0]), np.array([1000.0]))[0] == pytest.approx(1 / 3, abs=0.15)
    assert (sketches([a[::-1]]) == one).all() and (sketches([a[:0]]) == 0).all()
    assert band_keys(np.array([one, one, two]), 32, 4)[0].tolist() == band_keys(np.array([one, one, two]), 32, 4)[1].tolist()


def test_shingles_do_not_depend_on_the_pieces():
    texts = ["A b c d e f g", None, "", "x\x0by\x0cz", "long " * 3000 + "end", "a b c d e"]
    whole = [s for _, p in in_pieces(texts) for s in shingle_sets(p, 5)]
    small = [s for _, p in in_pieces(texts, 10) for s in shingle_sets(p, 5)]
    assert [s.tolist() for s in whole] == [s.tolist() for s in small]
    assert [len(s) for s in whole] == [3, 0, 0, 1, 5, 1][:4] + [len(whole[4]), 1]
    assert whole[5][0] in whole[0]


def test_a_round_of_few_links_makes_few_files(spark, monkeypatch):
    parts, write = [], components_module.durable
    monkeypatch.setattr(components_module, "durable", lambda df: parts.append(df.rdd.getNumPartitions()) or write(df))
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        links = spark.range(200).selectExpr("id as a", "id + 1 as b")
        assert {r.component for r in components(links).collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(parts) > 2 and max(parts[1:]) <= 8


def test_a_piece_takes_little_memory():
    texts = [f"words of the text {k} and more of them than the others hold " * 40 for k in range(2000)]
    tracemalloc.start()
    try:
        for _, piece in in_pieces(texts):
            shingle_sets(piece, 5)
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op5_neardup(spark, folder).collect()}
    assert got == brute(rows)


def test_nothing_is_broadcast_and_no_marker_is_written(spark, monkeypatch):
    """Every join is a merge, so none passes through the driver; the driver makes no file of its own for a written table."""
    from pathlib import Path

    from sitepanel.llm import neardup as neardup_module
    from sitepanel.llm import store

    joins, files = [], []

    def watched(df, **options):
        joins.extend(line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line)
        out = store.durable(df, **options)
        files.extend(p.name for f in out.inputFiles()[:1] for p in Path(f.removeprefix("file:")).parent.iterdir())
        return out

    monkeypatch.setattr(neardup_module, "durable", watched)
    monkeypatch.setattr(components_module, "durable", watched)
    base = " ".join(f"word{k}" for k in range(40))
    rows = [(i, f"{base} tail{i % 3} end") for i in range(12)] + [(20, "something else that is long enough to count"), (21, "")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    joins.extend(line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line)
    assert {r.component_id for r in got.filter("doc_id < 12").collect()} == {0}
    assert joins and not [x for x in joins if "Broadcast" in x]
    assert files and not [x for x in files if "SUCCESS" in x]
