"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that stand side by side inside no vocabulary token can
never be merged, so the text is certain to be cut between them.  Words are cut
there, the fragments are encoded on their own and the ids concatenated.  A
fragment's ids depend on the fragment alone, which lets one memory per worker
serve all texts.  It keeps the runs met lately, twice ``MEMORY`` at most, and has
no effect on results.

Defined results: a null text is encoded as the empty text; empty ids decode to
the empty text; null ids decode to null; rows are kept as they are, repeated
ones included; an output column of the same name as an input column replaces it.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepanel.llm.registry import query
from sitepanel.llm.store import documents

WORD_END = "</w>"
MEMORY = 250_000
LONG_FRAGMENT = 48

# Code points that the installed regex module counts as letters or
# digits and the vocabulary's own splitter doesn't yet, and capitals whose small
# letters are newer than Python's tables (first, last, distance).
NOT_LETTERS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    r"\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    r"\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    r"\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    r"\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
NOT_DIGITS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
NEW_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1),
    (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
#: Python's split() takes these for white space, the vocabulary's splitter doesn't.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others follow from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    kept = set(printable)
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary file with lower-cased words and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        pairs = (p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"])
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")"
        )
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        words = split["pattern"]["Regex"]
        for kind, newer in ((r"\p{L}", NOT_LETTERS), (r"\p{N}", NOT_DIGITS)):
            # inside the one negated class the newer code points come back as others
            words = words.replace(rf"[{kind}]", rf"[{kind}--[{newer}]]")
        words = words.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{NOT_LETTERS}{NOT_DIGITS}]]")
        self.word_pattern = regex.compile(words, regex.V1)
        # the same for lower-cased ASCII runs, where only a-z are letters
        self.ascii_pattern = re.compile(split["pattern"]["Regex"].replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.small = {0x3A3: 0x3C3} | {c: c + d for a, b, d in NEW_CAPITALS for c in range(a, b + 1)}
        self.letters = byte_letters()
        inside = {t[k - 1 : k + 1] for t in (x.removesuffix(WORD_END) for x in self.ids) for k in range(1, len(t))}
        self.joinable = frozenset(inside)
        tokens = self.ids | self.specials
        self.tokens = np.empty(max(tokens.values()) + 1, dtype=object)
        for token, number in tokens.items():
            self.tokens[number] = token
        self.rare_capitals = regex.compile("[" + "".join(map(chr, self.small)) + "]")
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def fragments(self, word: str) -> list[str]:
        """``word``, as byte letters, cut at every pair that no token holds."""
        joinable = self.joinable
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in joinable]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def encode_word(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode("utf-8", "replace")])
        *first, last = self.fragments(letters)
        symbols = [s for f in first for s in self.merged(list(f))]
        symbols += self.merged([*last[:-1], last[-1] + WORD_END])
        return np.array([self.ids[s] for s in symbols], dtype="<u4").tobytes()

    def merged(self, symbols: list[str]) -> list[str]:
        """All merges by rank, the leftmost of equal rank first."""
        if len(symbols) > LONG_FRAGMENT:
            return self._merged_long(symbols)
        rank, never = self.rank, len(self.rank)
        ranks = [rank.get(p, never) for p in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < never:
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get((symbols[at - 1], symbols[at]), never)
            if at < len(ranks):
                ranks[at] = rank.get((symbols[at], symbols[at + 1]), never)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        size = len(symbols)
        after, before = [*range(1, size), -1], [*range(-1, size - 1)]
        parts: list[str | None] = list(symbols)
        heap = [(self.rank[p], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = after[at] if parts[at] is not None else -1
            if right < 0 or self.rank.get((parts[at], parts[right])) != rank:
                continue
            parts[at], parts[right] = parts[at] + parts[right], None
            after[at] = after[right]
            if after[at] >= 0:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] >= 0:
                    pair = (parts[left], parts[after[left]])
                    if pair in self.rank:
                        heapq.heappush(heap, (self.rank[pair], left))
        return [p for p in parts if p is not None]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        out = []
        pieces = self.special_pattern.split(text) if "<|" in text else (text,)
        for piece in pieces:
            if piece in self.specials:
                out.append(np.array([self.specials[piece]], dtype="<u4").tobytes())
                continue
            plain = unicodedata.normalize("NFC", piece)
            if self.rare_capitals.search(plain):
                # one letter is lowered at a time: a capital sigma has a single small form then
                plain = plain.translate(self.small)
            plain = plain.lower()
            get = self.recent.get
            # no word holds white space, so each run without it is encoded on its own
            runs = regex.split(r"\s+", plain) if SEPARATORS.search(plain) else plain.split()
            out += [get(r) or self.encode_run(r) for r in runs]
        return b"".join(out)

    def encode_run(self, run: str) -> bytes:
        found = self.recent.get(run) or self.older.get(run)
        if found is None:
            words = (self.ascii_pattern if run.isascii() else self.word_pattern).findall(run)
            if words == [run]:
                found = self.encode_word(run)
            else:
                found = b"".join([self.recent.get(w) or self.encode_run(w) for w in words])
        if len(run) <= LONG_FRAGMENT:
            if len(self.recent) >= MEMORY:
                self.recent, self.older = {}, self.recent
            self.recent[run] = found
        return found

    def decode(self, ids: bytes) -> str:
        """The tokens with a space between them, as this vocabulary names no other decoder."""
        return " ".join(self.tokens[np.frombuffer(ids, dtype="<u4")].tolist())


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the packed ids of every whole text; ``vocabulary`` is a path on each machine."""

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = codec(vocabulary)
        for batch in batches:
            yield pd.Series([coder.encode(t or "") for t in batch], dtype=object)

    return docs.withColumn(ids, packed(F.col(text).cast("string")))


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the text that the packed ids stand for, special tokens included."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = codec(vocabulary)
        for batch in batches:
            yield pd.Series([None if b is None else coder.decode(bytes(b)) for b in batch], dtype=object)

    return docs.withColumn(decoded, text_of(F.col(ids)))


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def recoded(docs: DataFrame, vocabulary: str, slice_rows: int = 256) -> DataFrame:
    """``doc_id ids decoded`` in one pass; a worker holds the results of ``slice_rows`` texts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                ids = [coder.encode(t or "") for t in part.column("text").to_pylist()]
                texts = pa.array([coder.decode(i) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), texts], names=["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def coded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row: doc_id, token count and the digests of ids and decoded text."""
    return recoded(docs, vocabulary).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"))
