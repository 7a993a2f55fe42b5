import numpy as np
import pytest
from pyspark.sql import functions as F

from sitepanel.llm.langid import (
    DIMENSIONS, Vectors, fit_language_model, fit_temperature, gram_counts, identify, op9_language, softmax, train_ftrl, unit_vector,
)


def test_gram_counts_cover_the_whole_text(monkeypatch):
    text = "Élan vital, straße! " * 50
    want = gram_counts(text)
    monkeypatch.setattr("sitepanel.llm.langid.CHUNK", 17)
    got = gram_counts(text)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    n = len(text) + 2
    assert want[1].sum() == n + n - 1 + n - 2


def test_ftrl_separates_and_stays_sparse():
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for k in range(300):
        label = k % 3
        columns = np.unique(np.append(rng.integers(100, 400, 10), label))
        rows.append((columns, np.ones(len(columns)) / np.sqrt(len(columns))))
        labels.append(label)
    weights, bias = train_ftrl(rows, np.array(labels), 3)
    right = [int(np.argmax(weights[:, c] @ v + bias)) == y for (c, v), y in zip(rows, labels)]
    assert np.mean(right) > 0.99
    assert weights.shape == (3, DIMENSIONS) and (weights[:, 500:] == 0).all()


def test_temperature_recovers_a_scale():
    rng = np.random.default_rng(2)
    margins = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=p) for p in softmax(margins)])
    assert fit_temperature(margins * 5, labels) == pytest.approx(5, rel=0.15)


def test_held_out_accuracy_and_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = op9_language(spark, folder)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    unseen = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in unseen]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(k, "the cat and the dog", "en", "x") for k in range(40)] + [(k + 40, "der hund und die katze", "de", "x") for k in range(40)]
    rows += [(99, None, "en", "x"), (99, "the dog", None, "x"), (None, "die katze", "de", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = fit_language_model(docs)
    assert model.languages == ["de", "en"]
    odd = [(1, None), (2, ""), (3, "12 !? 34"), (4, "und die katze"), (4, "und die katze"), (5, "the dog " * 20000)]
    got = identify(spark.createDataFrame([(*r, "s") for r in odd], "doc_id long, text string, score string"), model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    assert [r.lang_pred for r in sorted(got.collect(), key=lambda r: r.doc_id)] == ["und", "und", "und", "de", "de", "en"]
    none = fit_language_model(docs.filter(F.lit(False)))
    assert {r.lang_pred for r in identify(docs, none).collect()} == {"und"}
    assert identify(docs.filter(F.lit(False)), model).collect() == []


def test_number_signs_are_no_letters():
    from sitepanel.llm.langid import LETTER

    assert not any(LETTER.search(t) for t in ("½ ² ①", "Ⅷ", "12_3", "٣", "!"))
    assert all(LETTER.search(t) for t in ("a", "É", "ß", "日", "ʰ"))


def test_more_languages_than_the_sample_and_a_hot_id(spark):
    rows = [(k * 10 + j, f"word{j} text", f"l{j}") for j in range(5) for k in range(40 if j in (0, 2, 4) else 3)]
    rows += [(0, "word0 text", "l0")] * 500  # one doc_id holds most rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert fit_language_model(docs, sample=3).languages == ["l0", "l2", "l4"]
    model = fit_language_model(docs, sample=60)
    assert model.languages == ["l0", "l1", "l2", "l3", "l4"]
    got = {r.doc_id: r.lang_pred for r in identify(docs, model).collect()}
    assert got[10] == "l0" and got[12] == "l2" and got[14] == "l4"


def test_rows_to_train_on_stay_packed():
    """A pass over the sample leaves nothing of it unpacked behind; every pass gives the same vectors."""
    import tracemalloc

    rng = np.random.default_rng(5)
    idf = rng.random(DIMENSIONS) + 1.0
    plain = [(np.sort(rng.choice(DIMENSIONS, 2000, replace=False)), rng.integers(1, 90, 2000)) for _ in range(300)]
    packed = [{"columns": c.astype("<u2").tobytes(), "counts": k.astype("<u4").tobytes()} for c, k in plain]
    rows = Vectors(packed, idf)
    tracemalloc.start()
    for _ in range(2):
        for (columns, values), (c, k) in zip(rows, plain):
            assert (columns == c).all() and (values == unit_vector(c, k.astype(np.float64), idf)).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(len(r["columns"]) + len(r["counts"]) for r in packed) / 4
