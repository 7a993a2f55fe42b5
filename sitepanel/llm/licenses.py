"""License scans by ordered signature rules behind a keyword prefilter.

Several hundred regular expressions: signatures of licence texts written one by
one, and for every licence family the forms in which it is named (identifier
tag, grant, address, name with version, plain name).  A rule runs on a text
only if all its keywords occur in it.  Where detections overlap, one that lies
inside another of higher priority goes, and of those with the same priority the
one inside a longer.

Beside the rules, four base phrases are found as consecutive words.

Defined results: a null or empty text has no words and no labels and scores 0;
every row of ``docs`` gives one row, repeated or not; an empty table gives none.
Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepanel.llm.registry import query
from sitepanel.llm.store import documents

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Words are runs of digits, letters and bytes above ASCII; only A-Z change case.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)
GAP = r"[\W_]{1,12}"  # what may stand between the words of a signature

# Priorities and strengths: a tag or a whole text says more than a name.
TAG, TEXT, GRANT, ADDRESS, VERSION, NAME = range(6)
STRENGTH = {TAG: 0.99, TEXT: 0.95, GRANT: 0.9, ADDRESS: 0.85, VERSION: 0.75, NAME: 0.5}
BASE_STRENGTH = 0.6

# Families: label | keywords | name | versions.  A blank in a name is any gap.
FAMILIES = r"""
gpl | licen general public | (?:gnu )?general public licen[cs]e | 1.0 2.0 3.0
gpl | gpl | gnu gpl | 1.0 2.0 3.0
lgpl | licen lesser public | (?:gnu )?lesser general public licen[cs]e | 2.1 3.0
lgpl | licen library public | (?:gnu )?library general public licen[cs]e | 2.0
lgpl | lgpl | (?:gnu )?lgpl | 2.0 2.1 3.0
agpl | licen affero public | (?:gnu )?affero general public licen[cs]e | 1.0 3.0
agpl | agpl | (?:gnu )?agpl | 1.0 3.0
gfdl | licen documentation gnu | gnu free documentation licen[cs]e | 1.1 1.2 1.3
apache | licen apache | apache(?: software)? licen[cs]e | 1.0 1.1 2.0
mit | licen mit | (?:the )?mit licen[cs]e |
mit | licen expat | expat licen[cs]e |
mit-0 | licen mit | mit no attribution(?: licen[cs]e)? |
x11 | licen x11 | x11 licen[cs]e |
isc | licen isc | isc licen[cs]e |
bsd | licen bsd | bsd licen[cs]e |
bsd | licen bsd | bsd style licen[cs]e |
bsd-0-clause | licen bsd | (?:0|zero) clause bsd licen[cs]e |
bsd-1-clause | licen bsd | (?:1|one) clause bsd licen[cs]e |
bsd-2-clause | licen bsd | (?:2|two) clause bsd licen[cs]e |
bsd-2-clause | licen bsd | simplified bsd licen[cs]e |
bsd-2-clause | licen freebsd | freebsd licen[cs]e |
bsd-3-clause | licen bsd | (?:3|three) clause bsd licen[cs]e |
bsd-3-clause | licen bsd | (?:new|revised|modified) bsd licen[cs]e |
bsd-4-clause | licen bsd | (?:4|four) clause bsd licen[cs]e |
bsd-4-clause | licen bsd | (?:original|old) bsd licen[cs]e |
mpl | licen mozilla | mozilla public licen[cs]e | 1.0 1.1 2.0
npl | licen netscape | netscape public licen[cs]e | 1.0 1.1
epl | licen eclipse | eclipse public licen[cs]e | 1.0 2.0
cpl | licen common | common public licen[cs]e | 1.0
ipl | licen ibm | ibm public licen[cs]e | 1.0
cddl | licen distribution common | common development and distribution licen[cs]e | 1.0 1.1
cecill | licen cecill | cecill(?: free software)? licen[cs]e | 1.0 1.1 2.0 2.1
eupl | licen european | european union public licen[cs]e | 1.0 1.1 1.2
osl | licen open | open software licen[cs]e | 1.0 1.1 2.0 2.1 3.0
afl | licen academic | academic free licen[cs]e | 1.1 1.2 2.0 2.1 3.0
artistic | licen artistic | artistic licen[cs]e | 1.0 2.0
perl | licen perl | same terms as perl(?: 5)? itself under its licen[cs]e |
psf | licen python foundation | python software foundation licen[cs]e | 2.0
php | licen php | php licen[cs]e | 3.0 3.01
ruby | licen ruby | ruby licen[cs]e |
zope | licen zope | zope public licen[cs]e | 1.1 2.0 2.1
zlib | licen zlib | zlib licen[cs]e |
libpng | licen libpng | libpng licen[cs]e | 2.0
boost | licen boost | boost software licen[cs]e | 1.0
ncsa | licen ncsa | (?:university of illinois )?ncsa(?: open source)? licen[cs]e |
w3c | licen w3c | w3c software(?: and document)?(?: notice and)? licen[cs]e |
openssl | licen openssl | openssl licen[cs]e |
ofl | licen font sil | sil open font licen[cs]e | 1.0 1.1
ms-pl | licen microsoft | microsoft public licen[cs]e |
ms-rl | licen microsoft | microsoft reciprocal licen[cs]e |
qpl | licen public | q public licen[cs]e | 1.0
lppl | licen latex | latex project public licen[cs]e | 1.0 1.1 1.2 1.3
vim | licen vim | vim licen[cs]e |
wtfpl | licen what want | do what the f\w*ck you want to public licen[cs]e | 1 2
wtfpl | wtfpl | wtfpl | 1 2
unlicense | unlicense | the unlicense |
beerware | beer ware licen | beer ware licen[cs]e |
json | licen json | json licen[cs]e |
sspl | licen server side | server side public licen[cs]e | 1.0
busl | licen business source | business source licen[cs]e | 1.0 1.1
elastic | licen elastic | elastic licen[cs]e | 1.0 2.0
commons-clause | commons clause | commons clause licen[cs]e condition | 1.0
upl | licen universal | universal permissive licen[cs]e | 1.0
mulan | licen mulan | mulan permissive software licen[cs]e | 1.0 2.0
rpl | licen reciprocal | reciprocal public licen[cs]e | 1.1 1.5
sleepycat | licen sleepycat | sleepycat licen[cs]e |
postgresql | licen postgresql | postgresql licen[cs]e |
intel | licen intel | intel open source licen[cs]e |
apple | licen apple | apple public source licen[cs]e | 1.0 1.1 1.2 2.0
sun | licen sun | sun public licen[cs]e | 1.0
nokia | licen nokia | nokia open source licen[cs]e | 1.0
watcom | licen watcom | sybase open watcom public licen[cs]e | 1.0
ecl | licen educational | educational community licen[cs]e | 1.0 2.0
naumen | licen naumen | naumen public licen[cs]e |
unicode | licen unicode | unicode(?: data files and software)? licen[cs]e |
icu | licen icu | icu licen[cs]e |
cc0 | cc0 | cc0 | 1.0
cc0 | creative zero | creative commons zero | 1.0
cc-by | creative attribution | creative commons attribution | 1.0 2.0 2.5 3.0 4.0
cc-by | cc by | cc by | 1.0 2.0 2.5 3.0 4.0
cc-by-sa | creative share | creative commons attribution share ?alike | 1.0 2.0 2.5 3.0 4.0
cc-by-sa | cc by sa | cc by sa | 1.0 2.0 2.5 3.0 4.0
cc-by-nd | creative deriv | creative commons attribution no ?deriv\w* | 1.0 2.0 2.5 3.0 4.0
cc-by-nd | cc by nd | cc by nd | 1.0 2.0 2.5 3.0 4.0
cc-by-nc | creative commercial | creative commons attribution non ?commercial | 1.0 2.0 2.5 3.0 4.0
cc-by-nc | cc by nc | cc by nc | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-sa | creative commercial share | creative commons attribution non ?commercial share ?alike | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-sa | cc by nc sa | cc by nc sa | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-nd | creative commercial deriv | creative commons attribution non ?commercial no ?deriv\w* | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-nd | cc by nc nd | cc by nc nd | 1.0 2.0 2.5 3.0 4.0
odbl | licen database | open database licen[cs]e | 1.0
odc-by | licen commons attribution | open data commons attribution licen[cs]e | 1.0
pddl | licen domain dedication | public domain dedication and licen[cs]e | 1.0
"""

# Signatures of licence texts and notices: label | keywords | signature.
TEXTS = r"""
mit | permission hereby obtaining | permission is hereby granted free of charge to any person obtaining a copy
mit | copyright permission notice | the above copyright notice and this permission notice shall be included in all copies
isc | permission purpose fee | permission to use copy modify and or distribute this software for any purpose with or without fee
bsd | redistribution binary | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse permission | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | advertising acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
apache-2.0 | licen compliance | you may not use this file except in compliance with the licen[cs]e
apache-2.0 | licen as is basis | distributed under the licen[cs]e is distributed on an as is basis without warranties or conditions of any kind
gpl | redistribute general public | you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl | copyleft licen | the gnu general public licen[cs]e is a free copyleft licen[cs]e for software
gpl | program warranty hope | this program is distributed in the hope that it will be useful but without any warranty
gpl-2.0 | licen public june | gnu general public licen[cs]e version 2 june 1991
gpl-3.0 | licen public june | gnu general public licen[cs]e version 3 29 june 2007
lgpl | redistribute general public | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
lgpl-2.1 | licen lesser february | gnu lesser general public licen[cs]e version 2 1 february 1999
lgpl-3.0 | licen lesser june | gnu lesser general public licen[cs]e version 3 29 june 2007
agpl | redistribute affero | you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
agpl-3.0 | licen affero november | gnu affero general public licen[cs]e version 3 19 november 2007
gfdl | permission documentation gnu | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
mpl-2.0 | mozilla source subject | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-1.1 | mozilla contents subject | the contents of this file are subject to the mozilla public licen[cs]e version 1 1
epl | eclipse accompanying | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
cddl | distribution common subject | the contents of this file are subject to the terms of the common development and distribution licen[cs]e
zlib | misrepresented origin | the origin of this software must not be misrepresented
zlib | altered plainly | altered source versions must be plainly marked as such
boost | permission obtaining accompanying | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
artistic | package intent copied | the intent of this document is to state the conditions under which a package may be copied
wtfpl | what want | you just do what the f\w*ck you want to
unlicense | unencumbered domain | this is free and unencumbered software released into the public domain
beerware | beer return | you can buy me a beer in return
perl | perl itself terms | under the same terms as perl(?: 5)? itself
ofl | font sil licen | this font software is licen[cs]ed under the sil open font licen[cs]e
cc0 | waive neighboring | has waived all copyright and related or neighboring rights
cc-by | attribution creative international | licen[cs]ed under a creative commons attribution 4 0 international licen[cs]e
json | good evil | the software shall be used for good not evil
openssl | openssl product | this product includes software developed by the openssl project
public-domain | domain public | (?:released|placed|dedicated) (?:in|into|in to|to) the public domain
proprietary | proprietary confidential | (?:this is )?proprietary and confidential
proprietary | rights reserved | all rights reserved
proprietary | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
"""

# Addresses of licence texts: label | keyword | address.
ADDRESSES = r"""
gpl | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl
lgpl | gnu.org | gnu\.org/licenses/(?:old-licenses/)?lgpl
agpl | gnu.org | gnu\.org/licenses/agpl
gfdl | gnu.org | gnu\.org/licenses/(?:old-licenses/)?fdl
apache-2.0 | apache.org | apache\.org/licenses/license-2\.0
apache-1.1 | apache.org | apache\.org/licenses/license-1\.1
mit | opensource.org | opensource\.org/licenses?/mit\b
bsd-2-clause | opensource.org | opensource\.org/licenses?/bsd-2-clause
bsd-3-clause | opensource.org | opensource\.org/licenses?/bsd-3-clause
isc | opensource.org | opensource\.org/licenses?/isc\b
mpl-1.1 | mozilla.org | mozilla\.org/mpl/mpl-1\.1
mpl-2.0 | mozilla.org | mozilla\.org/(?:en-us/)?mpl/2\.0
epl-1.0 | eclipse.org | eclipse\.org/legal/epl-v10
epl-2.0 | eclipse.org | eclipse\.org/(?:legal/epl-2\.0|legal/epl-v20)
boost-1.0 | boost.org | boost\.org/license_1_0\.txt
unlicense | unlicense.org | unlicense\.org\b
wtfpl | wtfpl.net | wtfpl\.net\b
ofl-1.1 | scripts.sil.org | scripts\.sil\.org/ofl
cc0 | creativecommons.org | creativecommons\.org/publicdomain/zero
cc-by | creativecommons.org | creativecommons\.org/licenses/by/
cc-by-sa | creativecommons.org | creativecommons\.org/licenses/by-sa/
cc-by-nd | creativecommons.org | creativecommons\.org/licenses/by-nd/
cc-by-nc | creativecommons.org | creativecommons\.org/licenses/by-nc/
cc-by-nc-sa | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/
cc-by-nc-nd | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/
odbl | opendatacommons.org | opendatacommons\.org/licenses/odbl
pddl | opendatacommons.org | opendatacommons\.org/licenses/pddl
"""


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str

    @property
    def strength(self) -> float:
        return STRENGTH[self.priority]


@dataclass(frozen=True)
class Hit:
    """A detection at code points ``start`` to ``end`` of the text."""

    label: str
    rule: str
    priority: int
    start: int
    end: int
    strength: float


def _table(text: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split("|", 2)] for line in text.strip().splitlines()]


def _families() -> list[tuple[str, tuple[str, ...], str, list[str]]]:
    out = []
    for line in FAMILIES.strip().splitlines():
        label, keywords, rest = (cell.strip() for cell in line.split("|", 2))
        name, versions = rest.rsplit("|", 1)
        out.append((label, tuple(keywords.split()), name.strip(), versions.split()))
    return out


def _spaced(signature: str) -> str:
    """A signature with any gap where it has a blank, or none where that is optional."""
    return signature.replace(" ?", f"(?:{GAP})?").replace(" ", GAP)


def _version(version: str) -> str:
    """3.0 as 3 or 3.0, 2.1 as 2.1, with or without a word before it."""
    whole, _, part = version.partition(".")
    number = whole + (r"(?:\.0)?" if part in ("", "0") else re.escape(f".{part}"))
    return rf"(?:[\W_]{{1,6}}licen[cs]e)?[\W_]{{0,6}}(?:version|ver|v)?[\W_]{{0,3}}{number}(?![\d.]*\d)"


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, those of higher priority first."""
    out = []
    for label, keywords, text in _table(TEXTS):
        out.append((label, TEXT, tuple(keywords.split()), rf"\b{_spaced(text)}"))
    for label, keyword, address in _table(ADDRESSES):
        out.append((label, ADDRESS, (keyword,), rf"\b{address}"))
    tags = set()
    for label, keywords, name, versions in _families():
        plain = rf"\b{_spaced(name)}"
        grant = _spaced(r"(?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of the )?")
        out.append((label, NAME, keywords, rf"{plain}\b"))
        out.append((label, GRANT, keywords, rf"\b{grant}{plain}\b"))
        tags.add(label)
        for version in versions:
            exact = f"{label}-{version}"
            out.append((exact, VERSION, keywords, plain + _version(version)))
            out.append((exact, GRANT, keywords, rf"\b{grant}{plain}{_version(version)}"))
            tags.add(exact)
    for label in sorted(tags):
        out.append((label, TAG, ("spdx",), rf"\bspdx-license-identifier:[^\n]{{0,80}}?\b(?P<at>{re.escape(label)}(?:-only|-or-later|\+)?)(?![\w.-])"))
    out.sort(key=lambda r: r[1])
    return tuple(Rule(f"r{number:03d}", *rule) for number, rule in enumerate(out))


class Scanner:
    """Compiled rules with their prefilter; one a worker."""

    def __init__(self):
        import ahocorasick

        self.rules = rules()
        self.compiled = [re.compile(r.pattern) for r in self.rules]
        self.anchors = sorted({r.keywords[0].encode() for r in self.rules}, key=lambda a: (a != b"licen", a))
        self.automaton = ahocorasick.Automaton()
        for keyword in {k for r in self.rules for k in r.keywords}:
            self.automaton.add_word(keyword, keyword)
        self.automaton.make_automaton()
        self.phrases = [(tuple(p.encode().split()), label) for p, label in BASE.items()]
        self.first_words = {p[0] for p, _ in self.phrases}

    def detections(self, data: bytes) -> list[Hit]:
        """All detections in a lower-cased text that overlap resolution keeps, in order of place."""
        if not any(anchor in data for anchor in self.anchors):
            return []
        text = data.decode("utf-8")
        present = {keyword for _, keyword in self.automaton.iter(text)}
        hits = []
        for rule, pattern in zip(self.rules, self.compiled):
            if present.issuperset(rule.keywords):
                at = "at" if "at" in pattern.groupindex else 0  # a tag's detection is the identifier
                hits += [Hit(rule.label, rule.name, rule.priority, *m.span(at), rule.strength) for m in pattern.finditer(text)]
        return resolved(hits)

    def base_places(self, data: bytes) -> tuple[int, list[tuple[int, str]]]:
        """Number of words, and the word places of the base phrases with their labels."""
        words = data.translate(WORD_BYTES).split()
        if not any(p[-1] in data and p[0] in data for p, _ in self.phrases):
            return len(words), []
        found = []
        for place, word in enumerate(words):
            if word in self.first_words:
                found += [(place, label) for p, label in self.phrases if tuple(words[place : place + len(p)]) == p]
        return len(words), found


def resolved(hits: list[Hit]) -> list[Hit]:
    """Hits that don't lie inside one of higher priority, or inside a longer one of the same.

    Of equal intervals with the same priority and label one stays; with other
    labels each does.
    """
    ordered = sorted(set(hits), key=lambda h: (h.start, -h.end, h.priority, h.label, h.rule))
    reach = [-1] * len(STRENGTH)  # furthest end so far, by priority
    spans = [(-1, -1)] * len(STRENGTH)  # the interval that reaches there
    kept, labels = [], set()
    for hit in ordered:
        inside = any(reach[p] >= hit.end for p in range(hit.priority))
        same = reach[hit.priority] >= hit.end and spans[hit.priority] != (hit.start, hit.end)
        if reach[hit.priority] < hit.end:
            reach[hit.priority], spans[hit.priority] = hit.end, (hit.start, hit.end)
        if not inside and not same and (hit.start, hit.end, hit.label) not in labels:
            labels.add((hit.start, hit.end, hit.label))
            kept.append(hit)
    return kept


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()),
    ("hits", pa.list_(pa.struct([
        ("label", pa.string()), ("rule", pa.string()), ("priority", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("strength", pa.float64()),
    ]))),
])
SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, "
    "hits array<struct<label:string,rule:string,priority:int,start:long,end:long,strength:double>>"
)


def scan_text(text: str | None) -> dict:
    data = text.encode("utf-8", "replace").translate(LOWER) if text else b""
    n_words, base = scanner().base_places(data)
    hits = scanner().detections(data)
    best = {label: BASE_STRENGTH for _, label in base}
    for hit in hits:
        best[hit.label] = max(best.get(hit.label, 0.0), hit.strength)
    doubt = 1.0
    for label in sorted(best):
        doubt *= 1.0 - best[label]
    places = [place for place, _ in base]
    return {
        "n_words": n_words, "n_base": len(base), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": sorted({label for _, label in base}), "labels": sorted(best), "score": 1.0 - doubt,
        "hits": [vars(h) for h in hits],
    }


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: word places of the base phrases, labels, score and all detections."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [scan_text(value.as_py()) for value in part.column(1)]
                made = pa.RecordBatch.from_pylist([{"doc_id": None} | r for r in rows], schema=RESULT)
                yield pa.RecordBatch.from_arrays([part.column(0), *made.columns[1:]], schema=RESULT)

    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(scan, SCANNED)


@query("op12_license_scan")
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(documents(spark, sf_dir, "doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )
