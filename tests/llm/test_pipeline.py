import re

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")

from sitepanel.llm.bpe import vocabulary_path  # noqa: E402
from sitepanel.llm.langid import fit_language_model, identify, learnable  # noqa: E402
from sitepanel.llm.mixing import targets  # noqa: E402
from tests.llm.test_neardup import brute  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SECRET = r'AKIA[0-9A-Z]{16}|(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}'


@pytest.fixture(scope="module")
def stages(spark):
    """The table after each stage, all columns collected."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, tables = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, FOLDER)
        assert k == 4 or docs.columns == columns
        tables.append(docs.collect())
        docs = spark.createDataFrame(tables[-1], docs.schema)
    return tables


def test_language_stage(spark, stages):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    named = {r.doc_id: r.lang_pred for r in identify(docs, fit_language_model(learnable(docs))).collect()}
    assert {r.doc_id for r in stages[1]} == {r.doc_id for r in stages[0] if named[r.doc_id] != "und"}
    assert all(re.search(r"[^\W\d_]", r.text) for r in stages[1])
    assert len(stages[1]) >= 0.98 * len(stages[0])


def test_near_duplicate_stage(stages):
    groups = brute([(r.doc_id, r.text) for r in stages[1]])
    assert {r.doc_id for r in stages[2]} == {i for i, (_, _, kept) in groups.items() if kept}


def test_secret_stage(stages):
    before = {r.doc_id: r for r in stages[2]}
    assert {r.doc_id for r in stages[3]} == set(before)
    for r in stages[3]:
        assert not re.search(SECRET, r.text) and r.n_chars == len(r.text)
        if not re.search(SECRET, before[r.doc_id].text):
            assert r.text.count("[REDACTED]") <= 1


def test_mixture_stage(stages):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    of = {r.doc_id: r for r in stages[3]}
    names = sorted({r.source for r in stages[3]})
    sizes = [sum(size(r.text) for r in stages[3] if r.source == n) for n in names]
    want = targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])
    got = [sum(size(r.text) for r in stages[4] if r.source == n) for n in names]
    assert got == pytest.approx(want, abs=1)
    for r in stages[4]:
        assert r.text in of[r.doc_id].text or set(r.text.split()) <= set(of[r.doc_id].text.split())
    assert max(sum(x.doc_id == i for x in stages[4]) for i in of) <= 2


def test_token_stage(stages):
    library = tokenizers.Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    library.no_truncation()
    texts = sorted((r.doc_id, r.text) for r in stages[4])
    got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens, r.decoded) for r in stages[5])
    want = []
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, ids, len(ids), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_odd_rows_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(k, f"plain words of number {k} go on and on here", "en", "a", 9) for k in range(12)]
    rows += [(1, "plain words of number 1 go on and on here", "en", "a", 9), (50, None, None, None, None), (51, "", "en", None, 0)]
    rows += [(None, "no id here but words", "en", "b", 3), (52, "der hund und die katze", "de", "b", 3), (53, "12 34", None, "b", 3)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema), spark.createDataFrame([(1, None, None, None, None)], schema)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() <= 2 * table.count()
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, schema), FOLDER).select("doc_id")
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and None in ids and 51 in ids


def test_run_is_the_composition(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert rows.agg(F.sum("n_tokens")).first()[0] > 1000


def test_near_duplicate_stage_keeps_columns_of_any_name(spark):
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(1, words, "a", 77, 5), (2, words, "b", 78, 6), (2, words, "b", 79, 7), (3, "other words are here now", "c", 80, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, place int, kept int")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [rows[0], rows[3]]
