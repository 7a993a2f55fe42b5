import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitepanel.llm.bpe import WordBpe, coded, decode, encode, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
PATH = vocabulary_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def own():
    return WordBpe(PATH)


def ids(own, text):
    return np.frombuffer(own.encode(text), "<u4").tolist()


def test_random_texts_equal_the_library(own, library):
    random.seed(7)
    letters = "abcxyzABCΣσςéİ ﬁ\n\t'sllre0129!!?…中文字🙂🏽\x85\xa0\x1c\x1f₀Ÿ"
    parts = [*letters, "<|startoftext|>", "<|endoftext|>", "<|", "don't", "  "]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 50)))
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids(own, text) == expected, text
        assert own.decode(own.encode(text)) == library.decode(expected, skip_special_tokens=False)


def test_every_code_point_of_the_first_planes(own, library):
    for c in [*range(0, 0xD800, 7), *range(0xE000, 0x20000, 13), 0xA7CB, 0x16EA3, 0x323B5]:
        text = f"a{chr(c)}b1{chr(c)}"
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_long_runs_without_white_space(own, library):
    for text in ("a" * 5000, "ab" * 3000 + "c", "xq" * 2000, "!" * 999):
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


def test_cuts_fall_only_where_no_token_spans(own):
    word = "thequickzxqj"
    parts = own.fragments(word)
    assert "".join(parts) == word
    spans = {a[-1] + b[0] for a, b in zip(parts, parts[1:])}
    assert spans and not any(s in token for s in spans for token in own.ids)


def test_query_rows(spark, library):
    texts = [(1, "Hello, World"), (2, None), (3, ""), (3, ""), (4, "x " * 3000), (None, "Ünï<|endoftext|>")]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in texts], "doc_id long, text string, ids string, decoded string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded(docs, PATH).collect())
    want = []
    for i, t in texts:
        e = library.encode(t or "", add_special_tokens=False).ids
        d = library.decode(e, skip_special_tokens=False)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i or 0, len(e), sha(np.array(e, "<u4").tobytes()), sha(d.encode())))
    assert got == sorted(want)
    both = decode(encode(docs, PATH), PATH)
    assert both.columns == docs.columns and both.count() == len(texts)
    assert coded(docs.filter(F.lit(False)), PATH).collect() == []
