import numpy as np
import public_tokenizers
import pytest

from sitepanel.llm.bpe import vocabulary_path
from sitepanel.llm.lengths import (
    encoded_lengths,
    encoding,
    length_histogram,
    op6_token_counts,
    quantiles,
    totals,
    truncated_totals,
)

PATH = vocabulary_path("byte_bpe_50k.tiktoken")


def frame(spark, lengths):
    return spark.createDataFrame([(x,) for x in lengths], "n_tokens long")


def test_histogram_against_brute_force(spark):
    rng = np.random.default_rng(3)
    lengths = [*map(int, rng.integers(0, 5000, 900)), 0, 0, 1023, 1024, 1025, 70000]
    hist = length_histogram(frame(spark, lengths))
    a = np.array(lengths)
    for r in hist.collect():
        n = r.n_tokens
        assert r.n_docs == (a == n).sum()
        assert r.docs_at_least == (a >= n).sum()
        assert r.tokens_at_least == a[a >= n].sum()
        assert r.truncated_total == np.minimum(a, n).sum()
    assert totals(hist).first() == (len(a), a.sum())
    for r in truncated_totals(hist, (0, 1, 100, 1024, 4999, 10**6)).collect():
        assert r.kept_tokens == np.minimum(a, r.context_limit).sum(), r
        assert r.cut_docs == (a > r.context_limit).sum()
    for r in quantiles(hist, (0.0, 0.25, 0.5, 0.999, 1.0)).collect():
        s = np.sort(a)
        assert r.n_tokens == s[max(0, int(np.ceil(r.share * len(s) - 1e-9)) - 1)]


def test_lengths_of_texts(spark):
    docs = spark.createDataFrame([(1, "two words", 9), (2, None, 9), (3, "", 9), (3, "", 9)], "doc_id long, text string, n_tokens long")
    got = encoded_lengths(docs, PATH, public_tokenizers.PATTERN)
    assert sorted(r.n_tokens for r in got.collect()) == [0, 0, 0, 2]
    assert got.columns == docs.columns


def test_empty_table(spark):
    hist = length_histogram(frame(spark, []))
    assert hist.collect() == [] and totals(hist).first() == (0, 0)
    assert {r.kept_tokens for r in truncated_totals(hist).collect()} == {0}
    assert {r.n_tokens for r in quantiles(hist).collect()} == {None}


def test_query_counts_every_document(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    enc = encoding(PATH, public_tokenizers.PATTERN)
    lengths = [len(enc.encode_ordinary(r.text or "")) for r in docs]
    got = {r.n_tokens: r.n_docs for r in op6_token_counts(spark, folder).collect()}
    assert got == {n: lengths.count(n) for n in set(lengths)}
