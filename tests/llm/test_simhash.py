import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitepanel.llm import simhash
from sitepanel.llm.simhash import fingerprints, near_counts, op2_simhash, with_neighbours, within_radius


def check(rows, got):
    rows = sorted({(i, t or "") for i, t in rows}, key=lambda r: -r[0])
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    apart = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    like = lambda a, b: max(0.0, np.cos(np.pi * apart(a, b) / 128))
    for k, (i, t) in enumerate(rows):
        after_id, after = rows[(k + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = of[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(like(r.fingerprint, of[after_id].fingerprint))
        near = sum(apart(r.fingerprint, x.fingerprint) <= simhash.NEAR_RADIUS for x in got) - 1
        assert r.n_near == (near if i % 20 == 0 else None)


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_ROWS", 16)
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = op2_simhash(spark, folder)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near"]
    got = got.collect()
    check(rows, got)
    same = {}
    for i, t in rows:
        same.setdefault(t, set()).add(next(r.fingerprint for r in got if r.doc_id == i))
    assert all(len(s) == 1 for s in same.values())
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.3


def test_odd_rows(spark):
    rows = [(5, "É ü 🙂 x"), (20, "one"), (40, None), (9, None), (7, ""), (1, "one"), (3, "a b c d e f g " * 9000), (2, "a b c d e f g " * 9000)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows] + [(1, "one", "s")], "doc_id long, text string, fingerprint string")
    got = with_neighbours(docs).collect()
    check(rows, got)
    of = {r.doc_id: r.fingerprint for r in got}
    assert of[3] == of[2] and of[9] == of[7]
    assert with_neighbours(docs.filter("false")).collect() == []
    alone = with_neighbours(docs.filter("doc_id = 3")).collect()
    check([rows[6]], alone)
    assert len(with_neighbours(docs.unionByName(spark.createDataFrame([(None, "n", "s")], docs.schema))).collect()) == 9


def test_votes_against_counting(spark):
    docs = spark.createDataFrame([(1, "to be or not to be that is to be or not"), (2, "x y")], "id long, text string")
    words = {1: "to be or not to be that is to be or not".split(), 2: ["x", "y", None]}
    for r in fingerprints(docs, ["id"]).collect():
        w = words[r["id"]]
        grams = spark.createDataFrame([tuple(w[k : k + 3]) for k in range(len(w) - 2)], "a string, b string, c string")
        h = grams.select(F.xxhash64("a", "b", "c").alias("h")).withColumn("g", F.xxhash64("h", F.lit(128))).collect()
        for name, values in (("low", [x.h for x in h]), ("high", [x.g for x in h])):
            want = sum(1 << k for k in range(64) if 2 * sum((v >> k) & 1 for v in values) > len(values))
            assert r[name] & (2**64 - 1) == want


def test_radius_search_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centre = [int(x) for x in rng.integers(0, 2, 128)]
    rows = []
    for k in range(120):
        bits = list(centre)
        for at in rng.choice(128, rng.integers(0, 12), replace=False):
            bits[at] ^= 1
        value = sum(b << n for n, b in enumerate(bits))
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        rows.append((k, signed(value >> 64), signed(value & (2**64 - 1)), value))
    frame = spark.createDataFrame([r[:3] for r in rows], "id long, high long, low long")
    got = within_radius(frame, frame.filter("id % 20 = 0"), 6).collect()
    assert len(got) == len(set(got))  # each pair from one table only
    got = {tuple(r) for r in got}
    want = {(a[0], b[0], bin(a[3] ^ b[3]).count("1")) for a in rows if a[0] % 20 == 0 for b in rows if bin(a[3] ^ b[3]).count("1") <= 6}
    assert got == want
    for radius, blocks in ((3, 5), (6, 9), (0, 1), (5, 6)):
        counts = {(r.high, r.low): r.n_near for r in near_counts(frame.union(frame), frame, radius, blocks).collect()}
        assert counts == {a[1:3]: 2 * sum(bin(a[3] ^ b[3]).count("1") <= radius for b in rows) for a in rows}
    nothing = frame.filter("false")
    assert near_counts(frame, nothing).collect() == near_counts(nothing, frame).collect() == []
    assert within_radius(nothing, nothing).collect() == []
