"""License scans: base phrases against a word-by-word search, overlap resolution against all pairs."""

import random
import re

import pytest

from sitepanel.llm import licenses
from sitepanel.llm.licenses import BASE, Hit, license_scan, op12_license_scan, resolved, rules, scan_text

SCHEMA = "doc_id long, text string, labels string, score string, hits string, n_words string"


def brute_base(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in BASE.items():
        parts = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


TEXTS = [
    None, "", "  ", "MIT License", "mit\n # license mit-LICENSE", "mit x license", "MITÉ license", "submit license", "mit license2",
    "GNU General Public License; gnu general public license v3", "gnu lesser general public license", "CC-BY-SA 4.0 and cc by", "cc0 by",
    "Apache License, Version 2.0. The Apache License", "apache_license", "word " * 30000 + "MIT License" + " tail" * 30000, "mit " * 5000 + "license",
]


def test_base_places_equal_brute_force(spark):
    frame = spark.createDataFrame([(i if i else None, t, "a", "b", "c", "d") for i, t in enumerate(TEXTS + TEXTS[3:5])], SCHEMA)
    rows = license_scan(frame.repartition(2)).collect()
    found = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows)
    assert found == sorted((str(i if i else None), *brute_base(t)) for i, t in enumerate(TEXTS + TEXTS[3:5]))
    assert all(set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 for r in rows)
    assert all((r.score > 0) == bool(r.labels) for r in rows)


def test_whole_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = op12_license_scan(spark, folder).collect()
    assert len(rows) == len(texts)
    found = sorted((r.doc_id, r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in rows)
    expected = [(d, brute_base(t)) for d, t in texts]
    assert found == sorted((d, b[0], b[1], str(b[2]), str(b[3]), ",".join(b[4])) for d, b in expected)


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the Apache License, Version 2.0 (the License)", {"apache", "apache-2.0"}),
        ("SPDX-License-Identifier: GPL-2.0-or-later OR MIT", {"gpl-2.0", "mit"}),
        ("under the GNU Lesser General Public License, version 2.1", {"lgpl-2.1"}),
        ("the GNU Affero General Public License v3", {"agpl-3.0"}),
        ("Mozilla Public License 2.0", {"mpl-2.0"}),
        ("This work is licensed under CC BY-NC-SA 4.0.", {"cc-by", "cc-by-nc-sa-4.0"}),
        ("Creative Commons Attribution-NonCommercial 3.0", {"cc-by-nc-3.0"}),
        ("http://www.apache.org/licenses/LICENSE-2.0", {"apache-2.0"}),
        ("Redistribution and use in source and binary forms, with or without\n * modification, are permitted", {"bsd"}),
        ("3-clause BSD license", {"bsd-3-clause"}),
        ("the MIT license", {"mit"}),
        ("Boost Software License - Version 1.0", {"boost-1.0"}),
        ("released into the public domain", {"public-domain"}),
        ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", {"wtfpl"}),
        ("Er kam mit Lizenz und apachischer Kunst; by cc:", set()),
        ("a general license to publish", set()),
    ],
)
def test_labels(text, labels):
    assert set(scan_text(text)["labels"]) == labels


def test_rules_are_gated_by_their_own_keywords():
    """Whatever a name rule can match holds its keywords: the prefilter loses nothing."""
    assert len(rules()) > 300 and [r.priority for r in rules()] == sorted(r.priority for r in rules())
    for rule in rules():
        letters = re.sub(r"\[\\W_\]\{\d+,\d+\}|\\[bWsw]|\(\?[:!]", " ", rule.pattern).replace("licen[cs]e", "license").replace("\\.", ".").replace("\\-", "-")
        for keyword in rule.keywords:
            assert keyword in letters, (rule.label, keyword, rule.pattern)


def test_overlaps_equal_all_pairs():
    draw = random.Random(3)
    for _ in range(200):
        hits = []
        for k in range(draw.randint(0, 12)):
            start = draw.randint(0, 8)
            priority = draw.randint(0, 3)
            hits.append(Hit(draw.choice("abc"), f"r{k}", priority, start, start + draw.randint(1, 6), 0.5))

        def beaten(h):
            for o in hits:
                holds = o.start <= h.start and o.end >= h.end
                longer = o.end - o.start > h.end - h.start
                if holds and (o.priority < h.priority or o.priority == h.priority and longer):
                    return True
            return False

        kept = {(h.start, h.end, h.priority, h.label) for h in hits if not beaten(h)}
        assert {(h.start, h.end, h.priority, h.label) for h in resolved(hits)} == kept


def test_many_detections_in_one_text():
    hits = scan_text("MIT License, Apache License 2.0. " * 4000)
    assert len(hits["hits"]) == 8000 and hits["n_base"] == 8000
