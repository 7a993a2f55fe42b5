import numpy as np
from pyspark.sql import functions as F

from sitepanel.llm.toxicity import (
    LEAD_IN, LEAD_OUT, Scorer, ToxicityModel, compressor, dictionary, fit_toxicity, fit_toxicity_model, op10_toxicity, score_toxicity,
)


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    for value in np.unique(scores):
        ranks[scores == value] = np.mean(np.flatnonzero(scores[order] == value)) + 1
    ones = labels == 1
    return (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_lead_in_and_out_make_savings_visible():
    toxic, plain = compressor(dictionary(["horrible", "villain"])), compressor(dictionary(["ordinary", "garden"]))
    cost = lambda c, w: len(c.compress(LEAD_IN + w + LEAD_OUT))
    assert cost(plain, b" villain ") - cost(toxic, b" villain ") >= 3
    assert cost(plain, b" garden ") - cost(toxic, b" garden ") <= -3


def test_scores_are_one_pass_over_the_whole_text():
    model = ToxicityModel(dictionary(["horrible"]), dictionary(["garden"]))
    scorer = Scorer(model)
    tail = scorer.features("garden " * 50000 + "horrible")
    assert tail.sum() > scorer.features("garden " * 50001).sum()


def test_held_out_ranking(spark):
    folder = "/root/testdata/sf0.1"
    got = op10_toxicity(spark, folder)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(rows) == 10000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    seen = [r for r in rows if r.held_out and r.toxic is not None]
    scores, labels = np.array([r.score for r in seen]), np.array([r.toxic for r in seen])
    print("auc", auc(scores, labels), "caught", np.mean(scores[labels == 1] >= 0.3), "false", np.mean(scores[labels == 0] >= 0.3))
    assert auc(scores, labels) > 0.9
    assert np.mean(scores[labels == 0] >= 0.3) < 0.05


def test_odd_inputs(spark):
    docs = spark.createDataFrame(
        [(1, "you villain", "s"), (2, None, "s"), (3, "", "s"), (3, "", "s"), (None, "garden path", "s"), (5, "x" * 100000, "s")],
        "doc_id long, text string, score string",
    )
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    rows = score_toxicity(docs, fit_toxicity_model(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    none = fit_toxicity_model(docs, labels.filter("false"))
    assert {r.score for r in score_toxicity(docs, none).collect()} == {0.0}
    one = fit_toxicity(["a", "b"], np.array([1, 1]))
    assert one.constant == 1.0
    assert score_toxicity(docs.filter(F.lit(False)), one).collect() == []


def test_sample_is_no_window(spark, monkeypatch):
    """The first rows of a class by hash, taken in every task and not in one sorted group."""
    from sitepanel.llm import toxicity

    docs = spark.createDataFrame([(k, f"word{k} again") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    seen, plans = [], []
    monkeypatch.setattr(toxicity, "TOXIC_SAMPLE", 7)
    monkeypatch.setattr(toxicity, "ORDINARY_SAMPLE", 9)
    monkeypatch.setattr(toxicity, "fit_toxicity", lambda texts, toxic, totals: seen.append((texts, toxic.tolist(), totals)))
    broadcast = F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or broadcast(df))
    fit_toxicity_model(docs, labels)
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    want = set([k for k in order if k % 4 == 0][:7] + [k for k in order if k % 4][:9])
    texts, toxic, totals = seen[0]
    assert {int(t.split()[0][4:]) for t in texts} == want and sum(toxic) == 7 and totals == (150, 50)
    assert "Window" not in plans[0] and "GlobalLimit" in plans[0]


def test_many_texts_of_one_id_give_the_same_sample(spark, monkeypatch):
    from sitepanel.llm import toxicity

    docs = spark.createDataFrame([(k % 3, f"word{k} again") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "TOXIC_SAMPLE", 7)
    monkeypatch.setattr(toxicity, "ORDINARY_SAMPLE", 9)
    monkeypatch.setattr(toxicity, "fit_toxicity", lambda texts, toxic, totals: seen.append((texts, toxic.tolist(), totals)))
    for rows in (docs, docs.orderBy(F.desc("text")), docs.repartition(7)):
        fit_toxicity_model(rows, labels)
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) == 32
