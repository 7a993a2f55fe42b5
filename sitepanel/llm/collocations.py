"""Collocations by counting phrases in burst tries.

Every task counts the phrases of its texts in a trie of word ids: a shallow
node per first word over hash containers.  Rare first words share one
container; a first word with many phrases bursts out of it into a container of
its own.  At its limit of entries a task spills whole subtrees, the largest
first, as runs sorted by word ids, and Spark merges the runs by prefix.  A hot
two-word prefix would fill one task, so the partition is that of the whole
phrase.

A phrase of three words can't be counted more often than the two-word phrases
in it.  So the second pass enters only those whose both halves are frequent,
by a Bloom filter of the frequent pairs: it has a fixed bound, and what it lets
through by mistake is only counted in vain.

Defined results: texts without a language count as ``und``; null and empty
texts have no words; repeated rows count each; an empty table has no
collocations.  Other columns are not looked at.  The score is exact: its
products are decimals of 38 digits, enough for counts below 5e15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitepanel.llm.registry import query
from sitepanel.llm.store import documents, durable
from sitepanel.llm.wordhash import mix

UNDETERMINED = "und"
# A trie holds at most this many phrases and half as many words, but for those of the texts just entered.
ENTRIES = 1 << 20
# Entries of one first word from which it gets a container of its own.
BURST = 1 << 12
BITS = 21  # of a word id; three fit a long
SLICE = 1 << 20  # bytes of a text that are taken apart at once
# The Bloom filter: bits for each frequent pair, the most bits, bits set for each.
PAIR_BITS, MOST_BITS, SET_BITS = 12, 1 << 27, 4
SLOT = 1 << 19  # bits that are put together at once

RUNS = "lang string, first string, second string, third string, count long"
RUN_SCHEMA = pa.schema([("lang", pa.string()), ("first", pa.string()), ("second", pa.string()), ("third", pa.string()), ("count", pa.int64())])

# Pieces end at . , ; : ! ? and at line ends; words are separated by blanks and tabs; only A-Z change case.
BREAK = b"."
_PLAIN = bytearray(b + 32 if 65 <= b <= 90 else b for b in range(256))
for _b in b".,;:!?\x0a\x0b\x0c\x0d":
    _PLAIN[_b] = 0x0A
_PLAIN[0x09] = 0x20
PLAIN = bytes(_PLAIN)


class WordIds(dict):
    """Ids of one language's words, given out by the trie that holds them; 0 is the end of a piece."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        super().__init__({BREAK: 0})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append((self.lang, word))
        return number


def slices(text: str) -> Iterator[list[bytes]]:
    """Words of a text, in slices of about SLICE bytes; BREAK stands between pieces."""
    data = text.encode("utf-8", "replace").translate(PLAIN)
    start = 0
    while start < len(data):
        end = len(data)
        if end - start > SLICE:
            cuts = [data.find(sign, start + SLICE) for sign in (b" ", b"\n")]
            end = min([c for c in cuts if c >= 0], default=end)
        # a word can't be BREAK, whose sign has become a line end
        yield data[start:end].replace(b"\n", b" . ").split()
        start = end


class BurstTrie:
    """Counts of phrases (as packed word ids) below a node per first word."""

    def __init__(self):
        self.words: list[tuple[str, bytes]] = [("", b"")]
        self.ids: dict[str, WordIds] = {}
        self.shared: Counter = Counter()
        self.own: dict[int, Counter] = {}
        self.burst = np.zeros(1, dtype=bool)
        self.unburst = ENTRIES // 4  # entries of the shared container from which it is looked through
        self._hashes = np.zeros(1, dtype=np.uint64)

    def hashes(self) -> np.ndarray:
        """Hashes of all words by id."""
        if len(self._hashes) < len(self.words):
            more = [word_hash(*word) for word in self.words[len(self._hashes) :]]
            self._hashes = np.append(self._hashes, np.array(more, dtype=np.uint64))
        return self._hashes

    def number(self, lang: str, word: bytes) -> int:
        return int(self.numbers(lang, [word])[0]) if word else 0

    def numbers(self, lang: str, words: list[bytes]) -> np.ndarray:
        if lang not in self.ids:
            self.ids[lang] = WordIds(lang, self.words)
        return np.fromiter(map(self.ids[lang].__getitem__, words), dtype=np.int64, count=len(words))

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        """Count phrases by first word and packed later words."""
        if len(self.burst) < len(self.words):
            self.burst = np.append(self.burst, np.zeros(2 * len(self.words) - len(self.burst), dtype=bool))
        burst = self.burst[first]
        self.shared.update(((first[~burst] << 2 * BITS) | rest[~burst]).tolist())
        first, rest = first[burst], rest[burst]
        order = np.argsort(first, kind="stable")
        first, rest = first[order], rest[order]
        starts = np.flatnonzero(np.diff(first, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(first)]):
            self.own[int(first[a])].update(rest[a:b].tolist())
        if len(self.shared) > self.unburst:
            self._burst()

    def _burst(self) -> None:
        """First words with BURST entries and more leave the shared container."""
        keys = np.fromiter(self.shared, dtype=np.int64, count=len(self.shared))
        first = keys >> 2 * BITS
        size = np.bincount(first, minlength=len(self.burst))
        leaving = size[first] >= BURST
        for word in np.unique(first[leaving]).tolist():
            self.own[word] = Counter()
            self.burst[word] = True
        mask = (1 << 2 * BITS) - 1
        for word, key in zip(first[leaving].tolist(), keys[leaving].tolist()):
            self.own[word][key & mask] = self.shared.pop(key)
        self.unburst = 2 * len(self.shared)

    def entries(self) -> int:
        return len(self.shared) + sum(map(len, self.own.values()))

    def full(self) -> bool:
        return self.entries() > ENTRIES or self._wordy()

    def _wordy(self) -> bool:
        return len(self.words) > ENTRIES // 2

    def spill(self) -> Iterator[pa.RecordBatch]:
        """Sorted runs of the largest subtrees until the trie is half empty; all of it if it has too many words."""
        everything = self._wordy()
        names = self._names()
        largest = sorted(self.own, key=lambda w: len(self.own[w]))
        while largest and (everything or self.entries() > ENTRIES // 2):
            word = largest.pop()
            yield from self._run(names, self.own[word], word << 2 * BITS)
            self.own[word] = Counter()
        if everything or self.entries() > ENTRIES // 2:
            yield from self._run(names, self.shared, 0)
            self.shared, self.unburst = Counter(), ENTRIES // 4
        if everything:
            self.__init__()

    def flush(self) -> Iterator[pa.RecordBatch]:
        names = self._names()
        for word, held in self.own.items():
            yield from self._run(names, held, word << 2 * BITS)
        yield from self._run(names, self.shared, 0)
        self.__init__()

    def _names(self) -> tuple[pa.Array, pa.Array]:
        words = pa.array([w for _, w in self.words], pa.binary()).cast(pa.string())
        return pa.array([lang for lang, _ in self.words], pa.string()), words

    @staticmethod
    def _run(names, held: Counter, prefix: int) -> Iterator[pa.RecordBatch]:
        keys = np.fromiter(held, dtype=np.int64, count=len(held)) | prefix
        counts = np.fromiter(held.values(), dtype=np.int64, count=len(held))
        order = np.argsort(keys)
        langs, words = names
        mask = (1 << BITS) - 1
        for start in range(0, len(order), 1 << 16):
            some = order[start : start + (1 << 16)]
            columns = [langs.take(pa.array(keys[some] >> 2 * BITS))]
            for shift in (2 * BITS, BITS, 0):
                number = (keys[some] >> shift) & mask
                columns.append(words.take(pa.array(number, mask=number == 0)))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[some])], schema=RUN_SCHEMA)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a pair of words from the hashes of the words, in the language of the first."""
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang.encode("utf-8", "replace")))


def bit_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of a pair in a filter of ``bits``, a power of two; a row per place."""
    step = mix(hashes) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(SET_BITS)])


def _phrases(trie: BurstTrie, ids: np.ndarray, seen: int, width: int, likely) -> None:
    """Enter the phrases of ``ids`` that end at place ``seen`` or later."""
    if width == 1:
        ones = ids[seen:]
        ones = ones[ones > 0]
        trie.add(ones, np.zeros(len(ones), dtype=np.int64))
    elif width == 2:
        a, b = ids[:-1], ids[1:]
        whole = (a > 0) & (b > 0)
        whole[: max(seen - 1, 0)] = False
        trie.add(a[whole], b[whole] << BITS)
    else:
        pair = likely(ids)
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        whole = (a > 0) & (b > 0) & (c > 0) & pair[:-1] & pair[1:]
        whole[: max(seen - 2, 0)] = False
        trie.add(a[whole], (b[whole] << BITS) | c[whole])


def phrase_runs(docs: DataFrame, widths: tuple[int, ...], filter_bits=None) -> DataFrame:
    """Runs of phrase counts (``lang first second third count``); a phrase may be in several runs.

    ``filter_bits`` is a broadcast Bloom filter of pairs for phrases of three words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie()

        def likely(ids: np.ndarray) -> np.ndarray:
            """Whether each two neighbours may be a frequent pair."""
            table = np.frombuffer(filter_bits.value, dtype=np.uint8)
            of = trie.hashes()[ids]
            held = np.ones(len(ids) - 1, dtype=bool)
            for places in bit_places(pair_hashes(of[:-1], of[1:]), 8 * len(table)):
                held &= (table[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1
            return held

        def enter(ids: np.ndarray, seen: int = 0) -> None:
            for width in widths:
                if len(ids) >= width:
                    _phrases(trie, ids, seen, width, likely)

        for batch in batches:
            group, size = [], 0  # whole texts and first slices, each behind the end of a piece
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                tail = None
                for words in slices(text.as_py() or ""):
                    if tail is None:
                        tail = trie.numbers(lang, [BREAK, *words])
                        group.append(tail)
                        size += len(tail)
                    else:  # the last two words before a slice are seen, not counted again
                        joined = np.append(tail, trie.numbers(lang, words))
                        enter(joined, len(tail))
                        tail = joined
                    tail = tail[-2:]
                    if size > 1 << 17:
                        enter(np.concatenate(group))
                        group, size = [], 0
                    if trie.full():
                        if group:
                            enter(np.concatenate(group))
                            group, size = [], 0
                        kept = [trie.words[i] for i in tail]
                        yield from trie.spill()
                        tail = np.array([trie.number(*word) for word in kept], dtype=np.int64)
            if group:
                enter(np.concatenate(group))
        yield from trie.flush()

    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNDETERMINED))
    return docs.select(F.col("text").cast("string").alias("text"), lang.alias("lang")).mapInArrow(count, RUNS)


def merged_runs(runs: DataFrame) -> DataFrame:
    key = ["lang", "first", "second", "third"]
    # the tries have combined what a task counts: a hash aggregate before the shuffle would find little
    return runs.repartition(*key).groupBy(*key).agg(F.sum("count").alias("count"))


def pair_filter(pairs: DataFrame) -> bytes:
    """Bloom filter of the pairs ``lang first second``, of at most MOST_BITS bits however many there are."""
    bits = SLOT
    wanted = min(PAIR_BITS * pairs.count(), MOST_BITS)
    while bits < wanted:
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, first, second = (batch.column(i).to_pylist() for i in range(3))
            left = np.array([word_hash(x, w.encode()) for x, w in zip(langs, first)], dtype=np.uint64)
            right = np.array([word_hash(x, w.encode()) for x, w in zip(langs, second)], dtype=np.uint64)
            set_bits = np.unique(bit_places(pair_hashes(left, right), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((set_bits // SLOT).astype(np.int32)), pa.array((set_bits % SLOT).astype(np.int32))], names=["slot", "place"]
            )

    def packed(frame):
        held = np.zeros(SLOT, dtype=bool)
        held[frame["place"].to_numpy()] = True
        data = np.packbits(held, bitorder="little").tobytes()
        return type(frame)({"slot": frame["slot"].iloc[:1].tolist(), "bits": [data]})

    set_bits = pairs.select("lang", "first", "second").mapInArrow(places, "slot int, place int").distinct()
    rows = set_bits.groupBy("slot").applyInPandas(packed, "slot int, bits binary").collect()  # at most MOST_BITS in all
    out = bytearray(bits // 8)
    for slot, data in rows:
        out[slot * (SLOT // 8) : (slot + 1) * (SLOT // 8)] = data
    return bytes(out)


def phrase_counts(docs: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Words with their counts by language (``lang first count``), and all phrases of
    two and three words with ``least`` and more (``lang first second third count``)."""
    spark = docs.sparkSession
    short = durable(merged_runs(phrase_runs(docs, (1, 2))).filter((F.col("count") >= least) | F.col("second").isNull()))
    pairs = short.filter(F.col("second").isNotNull())
    shared = spark.sparkContext.broadcast(pair_filter(pairs))
    long = durable(merged_runs(phrase_runs(docs, (3,), shared)).filter(F.col("count") >= least))
    shared.unpersist()
    return short.filter(F.col("second").isNull()).select("lang", "first", "count"), pairs.unionByName(long)


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, covered_percent: int = 50) -> DataFrame:
    """The best-scored phrases of every language: ``lang rank phrase a l r n score``.

    A phrase is left out if a longer one that contains it has at least
    ``covered_percent`` of its count.  ``docs`` has ``text`` and ``lang``.
    """
    words, phrases = phrase_counts(docs, least)
    total = words.groupBy("lang").agg(F.sum("count").alias("n"))
    is_long = F.col("third").isNotNull()
    pairs = phrases.filter(~is_long).select("lang", "first", "second", F.col("count").alias("a"))
    triples = phrases.filter(is_long).select("lang", "first", "second", "third", F.col("count").alias("a"))

    one = words.filter(F.col("count") >= least)
    starts = one.select("lang", "first", F.col("count").alias("word_first"))
    ends = one.select("lang", F.col("first").alias("last"), F.col("count").alias("word_last"))
    inside = triples.select(
        "lang", F.explode(F.array(F.struct("first", "second"), F.struct(F.col("second").alias("first"), F.col("third").alias("second")))).alias("p"), "a"
    )
    longest = inside.groupBy("lang", "p.first", "p.second").agg(F.max("a").alias("longer"))
    kept = pairs.join(longest, ["lang", "first", "second"], "left").filter(
        F.coalesce(100 * F.col("longer") < covered_percent * F.col("a"), F.lit(True))
    )

    two = kept.withColumn("last", F.col("second")).join(starts, ["lang", "first"]).join(ends, ["lang", "last"])
    scored_two = two.select(
        "lang", F.concat_ws(" ", "first", "second").alias("phrase"), "a", F.col("word_first").alias("l"), F.col("word_last").alias("r"),
        score_of("a", "word_first", "word_last").alias("score"),
    )
    left = pairs.select("lang", "first", "second", F.col("a").alias("pair_first"))
    right = pairs.select("lang", F.col("first").alias("second"), F.col("second").alias("third"), F.col("a").alias("pair_last"))
    three = (
        triples.join(left, ["lang", "first", "second"])
        .join(right, ["lang", "second", "third"])
        .withColumn("last", F.col("third"))
        .join(starts, ["lang", "first"])
        .join(ends, ["lang", "last"])
    )
    cut_one, cut_two = score_of("a", "word_first", "pair_last"), score_of("a", "pair_first", "word_last")
    at_one = F.col("cut_one") <= F.col("cut_two")
    scored_three = three.withColumns({"cut_one": cut_one, "cut_two": cut_two}).select(
        "lang",
        F.concat_ws(" ", "first", "second", "third").alias("phrase"),
        "a",
        F.when(at_one, F.col("word_first")).otherwise(F.col("pair_first")).alias("l"),
        F.when(at_one, F.col("pair_last")).otherwise(F.col("word_last")).alias("r"),
        F.least("cut_one", "cut_two").alias("score"),
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    scored = scored_two.unionByName(scored_three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = scored.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def score_of(a: str, left: str, right: str) -> F.Column:
    """floor(1000000 * a * a / (left * right)) without rounding."""
    wide = "cast({} as decimal(19, 0))"
    product = f"{wide.format(a)} * {wide.format(a)} * cast(1000000 as decimal(7, 0))"
    return F.expr(f"({product}) div ({wide.format(left)} * {wide.format(right)})")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATION_SQL = rf"""WITH texts AS (SELECT coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM texts),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS k FROM pieces WHERE len(w) > 0),
f1 AS (SELECT lang, w[k] AS w1, count(*) AS f FROM places GROUP BY ALL),
f2 AS (SELECT lang, w[k] AS w1, w[k + 1] AS w2, count(*) AS f FROM places WHERE k + 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w[k] AS w1, w[k + 1] AS w2, w[k + 2] AS w3, count(*) AS f FROM places WHERE k + 2 <= len(w)
       GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
inside AS (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3),
longer AS (SELECT lang, w1, w2, max(f) AS f FROM inside GROUP BY ALL),
cuts AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  LEFT JOIN longer q ON q.lang = p.lang AND q.w1 = p.w1 AND q.w2 = p.w2
  WHERE q.f IS NULL OR 100 * q.f < 50 * p.f
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, 1, x.f, y.f
  FROM f3 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1
  JOIN f2 y ON y.lang = p.lang AND y.w1 = p.w2 AND y.w2 = p.w3
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, 2, x.f, y.f
  FROM f3 p JOIN f2 x ON x.lang = p.lang AND x.w1 = p.w1 AND x.w2 = p.w2
  JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w3),
scored AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


@query("op13_collocations", COLLOCATION_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir, "text", "lang"))
