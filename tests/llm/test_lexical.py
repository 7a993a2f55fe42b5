"""Ranked search against scores computed term by term in plain integers."""

import math
import random
import re
from collections import Counter

import pytest

from sitepanel.llm import lexical

DOCS = "doc_id long, text string, item_id string, rank string, score string"
ITEMS = "item_id long, text string, doc_id string"


def brute(docs, items, k):
    def terms(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)

    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n = sum(1 for *_, size in counted if size)
    total = sum(size for *_, size in counted)
    texts = {}
    for item, text in items:
        texts[item] = min([t for t in (texts.get(item), text) if t is not None], default=None)
    out = []
    for item, text in texts.items():
        scored = []
        for number, count, size in counted:
            if not size:
                continue
            m = 75 + (25 * size * n) // total
            score = 0
            for term in terms(text):
                df = sum(1 for _, c, _ in counted if term in c)
                if count[term]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                    score += w * ((1000000000 * count[term]) // (1000 * count[term] + 12 * m))
            if score > 0:
                scored.append((-score, number is None, number))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda t: (t[0] is None, t[0], t[1]))


def found(spark, docs, items, k):
    left = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], DOCS).repartition(3)
    right = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    result = lexical.ranked_search(left, right, k)
    assert result.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in result.collect()), key=lambda t: (t[0] is None, t[0], t[1]))


@pytest.fixture(params=[4096, 7])
def block_size(request, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", request.param)


def test_equals_brute_force(spark, block_size):
    draw = random.Random(5)
    words = [f"w{min(int(draw.expovariate(0.12)), 60)}" for _ in range(4000)]
    docs = [(i, " ".join(draw.sample(words, draw.randint(1, 40)))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(30)]  # ties
    items = [(i, " ".join(draw.sample(words, 12))) for i in range(6)]
    assert found(spark, docs, items, 5) == brute(docs, items, 5)


def test_odd_rows(spark, block_size):
    docs = [
        (1, "Alpha beta, ALPHA!"), (1, "Alpha beta, ALPHA!"), (2, None), (3, ""), (4, "... --"), (None, "alpha gamma"),
        (5, "Écru écru Äb 7x_7x"), (6, "rare " * 70000), (1, "gamma"), (7, "delta"), (8, "delta"),
    ]
    items = [(1, "alpha rare rare"), (2, None), (3, "écru 7X É"), (4, ""), (None, "gamma"), (5, "delta"), (5, "alpha"), (5, "alpha")]
    assert found(spark, docs, items, 3) == brute(docs, items, 3)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")], 3) == []
    assert found(spark, [(1, "a")], [], 3) == []


def test_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BYTES", 16)
    docs = [(i, f"a{i % 3} b{i % 5} c") for i in range(40)]
    items = [(i, f"a{i % 3} b{i % 4}") for i in range(12)]
    assert found(spark, docs, items, 4) == brute(docs, items, 4)


def test_accumulators_stop_and_survivors_are_exact():
    """The common term comes last and creates no accumulators, but counts for those that exist."""
    counts = [Counter({b"rare": 1, b"common": 2}) if i < 3 else Counter({b"common": 2}) for i in range(50)]
    row = lexical._index_block(list(range(50)), counts, [9] * 50, {b"rare": 0, b"common": 1})
    block = lexical.Block(row, 50, 450)
    places, scores = lexical.search_block(block, [(0, 3000), (1, 10)], 3, 0)
    parts = [1_000_000_000 // (1000 + 1200), 2_000_000_000 // (2000 + 1200)]
    assert places.tolist() == [0, 1, 2]
    assert scores.tolist() == [3000 * parts[0] + 10 * parts[1]] * 3
