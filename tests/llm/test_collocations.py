"""Collocations against counts of word tuples."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from sitepanel.llm import collocations as module
from sitepanel.llm.collocations import BurstTrie, bit_places, collocations, pair_filter, pair_hashes, slices, word_hash

SCHEMA = "text string, lang string, first string, rank string, phrase string"


def brute(rows, least, top=2000, percent=50):
    counts = defaultdict(Counter)
    for text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for width in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        covered = defaultdict(int)
        for p, c in candidates.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    covered[part] = max(covered[part], c)
        scored = []
        for p, a in candidates.items():
            if 100 * covered[p] >= percent * a:
                continue
            cuts = [((1000000 * a * a) // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(spark, rows, least=10, top=2000):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    result = collocations(frame, least, top)
    assert dict(result.dtypes) == {
        "lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint",
    }
    return sorted(tuple(r) for r in result.collect())


def prose(seed, size, words=30):
    draw = random.Random(seed)
    signs = ["", "", "", "", ".", ",", "\n", "!", ";"]
    return " ".join(f"Wö{min(int(draw.expovariate(0.25)), words)}{draw.choice(signs)}" for _ in range(size))


def test_equals_brute_force(spark):
    rows = [(prose(i, 200), ["en", "de", None][i % 3]) for i in range(40)]
    assert found(spark, rows, 10, 25) == brute(rows, 10, 25)
    assert found(spark, rows, 3, 2000) == brute(rows, 3, 2000)


def test_odd_rows(spark):
    copy = "Tied words here. Tied words here."
    rows = [(None, "en"), ("", "en"), (" .,;\t\x0b ", None), ("one", "en"), ("a\x00b c\xa0d\t e", "en"), (copy, "en"), (copy, "en"),
            (copy, "fr"), ("A b, A b a b" + " zz" * 60000 + ".A b", "en"), ("quote's \x1c x \x1c x \x1c x", "en")]
    assert found(spark, rows, 2) == brute(rows, 2)


def test_empty_table(spark):
    assert found(spark, []) == []


def counted(trie, batches):
    out = Counter()
    for batch in batches:
        for row in batch.to_pylist():
            out[row["lang"], row["first"], row["second"], row["third"]] += row["count"]
    return out


@pytest.mark.parametrize("entries", [40, 150, 1 << 20])
def test_trie_bursts_and_spills_whole_subtrees(monkeypatch, entries):
    monkeypatch.setattr(module, "ENTRIES", entries)
    monkeypatch.setattr(module, "BURST", 8)
    trie, total, expected, spills, bursts = BurstTrie(), Counter(), Counter(), 0, False
    trie.unburst = 30
    for number in range(60):
        words = [w for w in next(slices(prose(number, 50, 60))) if w != b"."]
        ids = trie.numbers("en", words)
        trie.add(ids[:-1], ids[1:] << module.BITS)
        expected.update(("en", a.decode(), b.decode(), None) for a, b in zip(words, words[1:]))
        bursts |= bool(trie.own)
        if trie.full():
            runs = list(trie.spill())
            spills += 1
            total += counted(trie, runs)
            assert not trie.full()
    assert bursts and bool(spills) == (entries < 1000)
    total += counted(trie, trie.flush())
    assert total == expected


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_slices_keep_words_and_breaks(monkeypatch, size):
    monkeypatch.setattr(module, "SLICE", size)
    text = prose(3, 400) + "x" * 500 + " end"
    assert sum(slices(text), []) == sum([[*p.split(), b"."] for p in text.lower().replace("Ö", "ö").encode().translate(module.PLAIN).split(b"\n")], [])[:-1]


def test_long_texts_in_slices(spark, monkeypatch):
    monkeypatch.setattr(module, "SLICE", 50)
    monkeypatch.setattr(module, "ENTRIES", 30)
    rows = [(prose(i, 700), "en") for i in range(3)]
    out = Counter()
    for batch in _tasks(rows, (1, 2)):
        for r in batch.to_pylist():
            out[tuple(w for w in (r["first"], r["second"]) if w)] += r["count"]
    expected = Counter()
    for text, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.replace("W", "w")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for width in (1, 2):
                expected.update(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    assert out == expected


def _tasks(rows, widths):
    """What one task gives for the rows, run in this process."""
    caught = {}

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, function, _):
            caught["f"] = function
            return self

    module.phrase_runs(Frame(), widths)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["text", "lang"])
    return caught["f"](iter([batch]))


def test_filter_holds_every_pair(spark):
    import numpy as np

    pairs = [("en", f"a{i % 50}", f"b{i}") for i in range(3000)]
    data = pair_filter(spark.createDataFrame(pairs, "lang string, first string, second string"))
    table = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")

    def held(lang, a, b):
        hashes = pair_hashes(*(np.array([word_hash(lang, w.encode())], dtype=np.uint64) for w in (a, b)))
        return bool(table[bit_places(hashes, len(table)).astype(np.int64)].all())

    assert all(held(*p) for p in pairs)
    assert sum(held("de", a, b) for _, a, b in pairs) < 30
