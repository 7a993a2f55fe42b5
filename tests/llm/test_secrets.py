import re
import time

import pytest
from pyspark.sql import functions as F

from sitepanel.llm.secrets import candidates, op4_secrets, redact, scan, sure_findings, with_features, dictionary

KEY = "AKIA" + "Q7ZJ2M4XK9PLW3RT"
HEX = "3f9a0b7c1d2e4f5a6b7c8d9e0f1a2b3c4d5e6f70"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, value string")


def prose(k):
    return f"some ordinary words here {k} and there"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"{prose(k)} {KEY[:-3]}{k:03d} more words follow\n\npassword=ab12cd{k:04d}ef9 end") for k in range(60)]
    rows += [(100 + k, f"{prose(k)} person.{k}@mail{k}.example.com and 192.168.100.{k + 100} then 4111111111{k:06d} so") for k in range(60)]
    rows += [(300, f'set token = "{HEX}" now, twice: "{HEX}".'), (301, None), (302, ""), (303, f"x {KEY}"), (303, f"x {KEY}"), (None, f"token = {HEX}")]
    rows += [(304, "pad " * 30000 + KEY)]
    return frame(spark, rows)


def test_candidates_lie_where_they_say(docs):
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    found = candidates(docs).collect()
    assert found
    for r in found:
        assert any(i == r.doc_id and t and t[r.start : r.start + len(r.value)] == r.value for i, t in texts), r
    brute = sum(len([w for w in re.split(r"[ \t\n\x0b\x0c\r]", t or "") if len(w) >= 12 and re.search(r"\d", w) and re.search(r"[A-Za-z0-9+/_=.\-]{12,}", w)]) for i, t in texts)
    assert len(found) == brute


def test_forest_keeps_secrets_and_drops_the_rest(docs):
    rows = scan(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert all({x.secret for x in by[k]} == {True} for k in range(60)) and all(len(by[k]) == 2 for k in range(60))
    assert all(not x.secret for k in range(100, 160) for x in by[k])
    assert [x.value for x in by[300]] == [HEX, HEX] and all(x.secret for x in by[300][:1])
    assert len(by[303]) == 1 and by[304][0].start == 4 * 30000


def test_redaction(spark, docs):
    clean = redact(docs.withColumn("n_chars", F.length("text").cast("long")), scan(docs))
    assert clean.columns == [*docs.columns, "n_chars"] and clean.count() == docs.count()
    for r in clean.collect():
        if r.text is not None:
            assert KEY not in r.text and "password=ab" not in r.text and r.n_chars == len(r.text)
            if r.doc_id is not None and 100 <= r.doc_id < 160:
                assert r.text.startswith("some ordinary") and "@mail" in r.text


def test_without_labels_and_empty(spark, docs):
    featured = with_features(candidates(docs), dictionary(docs))
    assert sure_findings(featured).filter("label = 1").count() > 100
    lone = frame(spark, [(1, "abcdef123456ghij and nothing else")])
    assert [(r.score, r.secret) for r in scan(lone).collect()] == [(0.5, False)]
    assert scan(docs.filter("false")).collect() == []


def test_query_finds_the_planted_forms(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op4_secrets(spark, folder).collect()
    kept = {(r.doc_id, texts[r.doc_id][r.start : r.start + r.length]) for r in got if r.secret}
    for i, t in texts.items():
        for form in (r"AKIA[0-9A-Z]{16}", r'(?<=token = ")[0-9a-f]{40}', r"(?<=password=)[0-9a-f]{18}"):
            for m in re.findall(form, t):
                assert (i, m) in kept
    planted = {(i, m) for i, t in texts.items() for m in re.findall(r'AKIA[0-9A-Z]{16}|(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}', t)}
    print(len(kept), len(planted), list(kept - planted)[:10])
    assert len(kept - planted) <= 0.1 * len(planted)


def test_all_runs_of_a_word_are_candidates(spark):
    texts = [
        f'{{"api_key":"{HEX}","id":"{KEY}"}}', f'login("{KEY}")', f"x,{KEY}", f"https://a.example/cb?token={HEX}&user=me", f"日本{KEY}語",
        "password=hunter now", '{"secret":"open-sesame"}', "postgres://me:s3cretpass99@db.example.com/x", "pwd : abc then", "token 12 more",
    ]
    found = candidates(frame(spark, list(enumerate(texts)))).collect()
    by = {k: {r.value for r in found if r.doc_id == k} for k in range(len(texts))}
    assert by[0] == {HEX, KEY} and by[1] == by[2] == by[4] == {KEY} and HEX in by[3]
    assert by[5] == {"hunter"} and by[6] == {"open-sesame"} and "s3cretpass99" in by[7] and by[8] == {"abc"} and by[9] == set()
    assert all(texts[r.doc_id][r.start :].startswith(r.value) for r in found)
    assert {r.name for r in found if r.value == HEX} == {'api_key":"', "token="}


def test_short_values_are_blanked_out_where_they_are(spark):
    docs = frame(spark, [(1, f"pass the passkey: password=pass, x,{KEY};y,{KEY}")])
    found = candidates(docs).withColumn("length", F.length("value")).withColumn("secret", F.lit(True))
    assert redact(docs, found.filter("value != 'y'")).first().text == "pass the passkey: password=[REDACTED], x,[REDACTED];y,[REDACTED]"


def test_dictionary_goes_by_share_and_language(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c for a in letters for b in letters for c in letters] + [a + b + c + "x" for a in letters for b in letters for c in letters]
    docs = frame(spark, [(k, " ".join(words[k::8])) for k in range(8)])
    assert dictionary(docs).count() == len(words) > 20_000
    rows = [(1, "word " * 900 + "seldom", "en")] + [(2, "wort selten", "de")]
    two = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.entry for r in dictionary(two, 0.01).collect()} == {"word", "wort", "selten"}


def test_redaction_keeps_columns_of_any_name(spark):
    rows = [(k, f"{prose(k)} token = {HEX[:-3]}{k:03d} end", f"p{k}", k, f"w{k}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _places string, _of int, row string")
    found = spark.createDataFrame([(1, 0, 3)], "doc_id long, start long, length int")
    found = found.join(docs.select("doc_id", F.xxhash64("text").alias("tie")), "doc_id")
    found = found.withColumn("value", F.lit("some")).withColumn("secret", F.lit(True))
    out = redact(docs, found, "*")
    assert out.columns == docs.columns
    got = sorted(tuple(r) for r in out.collect())
    assert got[0] == rows[0] and got[2] == rows[2]
    assert got[1] == (1, "*" + rows[1][1][3:], *rows[1][2:])


def test_many_candidates_of_one_text(spark):
    """Places in a text of 16,000 candidates, in time that doesn't grow with their square."""

    def taken(n):
        words = [f"k{i:05d}a{i * 7919 % 100003:06d}x" if i % 3 else f"word{'s' * (i % 5)}" for i in range(n)]
        text, began = " ".join(words), time.time()
        got = candidates(frame(spark, [(1, text)])).select("start", "value").collect()
        took = time.time() - began
        assert len(got) == sum(1 for w in words if w[0] == "k")
        assert all(text[r.start : r.start + len(r.value)] == r.value for r in got)
        return took

    taken(600)  # code is compiled
    short, long = taken(6000), taken(24000)
    print("seconds", short, long)
    assert long < 8 * short + 1
