"""SimHash fingerprints of documents, in DataFrame functions alone.

The terms of a text are its shingles of three words, weighted by how often they
occur.  Each term's hash votes on every bit of a fingerprint of 128 bits, for
one or for zero by its own bit; the majority is the bit (a tie gives zero).
Votes are counted two to a long, in lanes of 32 bits: no text has 2**31 terms.
All terms of a text are counted in its own task, so that a row of counts, not
terms, is shuffled.

``within_radius`` finds all fingerprints within a Hamming radius of given ones:
the bits are cut into blocks, and for each choice of blocks that could have
stayed untouched a table is keyed by those blocks; fingerprints that agree with
a query on a key are compared in full.  ``near_counts`` says how many rows lie
there, without a row for each: a pair is counted in the first table it agrees in.

Defined results: a null text is empty; a text without words has one term, the
empty sequence, so all of these are alike; fewer than three words are one term;
rows of equal doc_id and text are one document; documents that share a doc_id
follow each other by a hash of their text; a null doc_id comes last.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitepanel.llm.mixing import word_list
from sitepanel.llm.registry import query
from sitepanel.llm.store import documents, durable

WORDS = 3
BITS = 128
LANES = "4294967297"  # the lowest bit of either half of a long
RANGE_ROWS = 1 << 20  # thin rows in a range
NEAR_RADIUS, NEAR_BLOCKS = 3, 5  # ten tables of 50 bits and more
QUERY_EVERY = 20


def terms(text: Column) -> Column:
    """Structs of three neighbouring words; a shorter sequence is padded with nulls."""
    words = word_list(text)
    count = F.greatest(F.size(words) - (WORDS - 1), F.lit(1))
    padded = F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(words)
    shifted = [F.slice(padded, k + 1, count) for k in range(WORDS)]
    return F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)])


def votes(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Per ``key`` the number of terms and how many vote for one: bits k and k + 32 of each hash share a long."""
    of = texts.select(*key, F.explode(terms(F.col(text))).alias("_term"))
    of = of.select(*key, F.xxhash64(*[F.col("_term")[f"w{k}"] for k in range(WORDS)]).alias("_h0"))
    of = of.withColumn("_h1", F.xxhash64(F.col("_h0"), F.lit(BITS)))
    lanes = [F.expr(f"sum(shiftrightunsigned(_h{half}, {k}) & {LANES}L)").alias(f"_v{half}_{k}") for half in range(2) for k in range(32)]
    return of.groupBy(*key).agg(F.count(F.lit(1)).alias("_terms"), *lanes)


def fingerprints(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key`` and ``high low``, the 128 bits as two longs; each key must stand for one text."""
    counted = votes(texts, key, text)

    def ones(half: int, bit: int) -> Column:
        lane = F.shiftrightunsigned(f"_v{half}_{bit % 32}", 32 * (bit // 32))
        return lane.bitwiseAND(F.lit(0xFFFFFFFF))

    def packed(half: int) -> Column:
        bits = [F.when(2 * ones(half, k) > F.col("_terms"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)) for k in range(64)]
        while len(bits) > 1:  # a balanced tree, not a chain of 63
            bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])]
        return bits[0].cast("long")

    return counted.select(*key, packed(1).alias("high"), packed(0).alias("low"))


def as_text(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The cosine that the share of differing bits stands for; 0 from half of the bits on."""
    turned = F.cos(distance(a, b) * (3.141592653589793 / BITS))
    return F.greatest(turned, F.lit(0.0)).cast("double")


def block_parts(high: str, low: str, first: int, stop: int) -> list[Column]:
    """The bits from ``first`` to ``stop`` of a fingerprint, in one part for each half they touch."""
    parts = []
    for name, offset in ((low, 0), (high, 64)):
        a, b = max(first, offset) - offset, min(stop, offset + 64) - offset
        if a < b:
            mask = (1 << (b - a)) - 1 if b - a < 64 else -1
            parts.append(F.shiftrightunsigned(name, a).bitwiseAND(F.lit(mask)))
    return parts


def block_bounds(radius: int, blocks: int) -> list[tuple[int, int]]:
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("more blocks than the radius are needed")
    return [(k * BITS // blocks, (k + 1) * BITS // blocks) for k in range(blocks)]


def table_keys(high: str, low: str, radius: int, blocks: int) -> Column:
    """An array with one struct for each table: ``chosen`` blocks and ``upto`` their last one, as bit sets, and the ``key``."""
    bounds = block_bounds(radius, blocks)
    keys = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(1 << k for k in chosen)
        bits = [part for k in chosen for part in block_parts(high, low, *bounds[k])]
        keys.append(F.struct(F.lit(mask).alias("chosen"), F.lit((2 << chosen[-1]) - 1).alias("upto"), F.xxhash64(F.lit(mask), *bits).alias("key")))
    return F.array(*keys)


def agreeing_blocks(high: str, low: str, radius: int, blocks: int) -> Column:
    """The blocks without a set bit, as a bit set; ``high`` and ``low`` are the differing bits."""
    total = F.lit(0)
    for k, bound in enumerate(block_bounds(radius, blocks)):
        same = F.lit(True)
        for part in block_parts(high, low, *bound):
            same = same & (part == 0)
        total = total + F.when(same, F.lit(1 << k)).otherwise(F.lit(0))
    return total


def near_pairs(distinct: DataFrame, asked: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``asked`` (q_high, q_low) with all rows of ``distinct`` (high, low, ...) within ``radius`` bits, each pair once.

    With ``blocks`` blocks and at most ``radius`` differing bits, ``blocks -
    radius`` blocks at least are equal; each choice of so many is a table.  A
    pair may agree in several: the one of its first equal blocks yields it.
    """
    tables = F.explode(table_keys("high", "low", radius, blocks))
    rows = distinct.select("*", tables.alias("_t")).select(*distinct.columns, "_t.chosen", "_t.key")
    wanted = asked.select("q_high", "q_low", F.explode(table_keys("q_high", "q_low", radius, blocks)).alias("_t"))
    wanted = wanted.select("q_high", "q_low", "_t.*")
    met = rows.join(wanted, ["chosen", "key"])
    apart = distance((F.col("high"), F.col("low")), (F.col("q_high"), F.col("q_low")))
    met = met.withColumn("distance", apart).filter(F.col("distance") <= radius)
    met = met.withColumn("_x", F.col("high").bitwiseXOR(F.col("q_high"))).withColumn("_y", F.col("low").bitwiseXOR(F.col("q_low")))
    met = met.filter(agreeing_blocks("_x", "_y", radius, blocks).bitwiseAND(F.col("upto")) == F.col("chosen"))
    return met.drop("chosen", "upto", "key", "_x", "_y")


def within_radius(fingerprinted: DataFrame, queries: DataFrame, radius: int = 6, blocks: int = 9) -> DataFrame:
    """``query_id id distance``: all rows (id, high, low) within ``radius`` bits of a query's fingerprint.

    Rows of equal fingerprints are searched as one and listed at the end.
    """
    distinct = durable(fingerprinted.select("high", "low").distinct())
    asked = durable(queries.select(F.col("high").alias("q_high"), F.col("low").alias("q_low")).distinct())
    near = near_pairs(distinct, asked, radius, blocks)
    named = queries.select(F.col("id").alias("query_id"), F.col("high").alias("q_high"), F.col("low").alias("q_low"))
    near = near.join(named, ["q_high", "q_low"]).join(fingerprinted.select("id", "high", "low"), ["high", "low"])
    return near.select("query_id", "id", "distance")


def near_counts(fingerprinted: DataFrame, queries: DataFrame, radius: int = NEAR_RADIUS, blocks: int = NEAR_BLOCKS) -> DataFrame:
    """``high low n_near``: for each fingerprint of ``queries`` the rows of ``fingerprinted`` within ``radius`` bits.

    Rows of equal fingerprints are counted first, so copies are one row of the search.
    """
    distinct = durable(fingerprinted.groupBy("high", "low").agg(F.count(F.lit(1)).alias("rows")))
    asked = queries.select(F.col("high").alias("q_high"), F.col("low").alias("q_low")).distinct()
    near = near_pairs(distinct, asked, radius, blocks).groupBy("q_high", "q_low").agg(F.sum("rows").alias("n_near"))
    return near.withColumnsRenamed({"q_high": "high", "q_low": "low"})


def following(keys: DataFrame, partitions: int) -> DataFrame:
    """``keys`` (doc_id, tie, half) with the next row's key by descending doc_id; the last row's is the first's.

    Thin rows are dealt by range and numbered inside each range; the first row
    of the next range that has rows follows the last of a range.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    ranged = durable(keys.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy("_part").orderBy(*order)
    key = F.struct("doc_id", "tie")
    placed = ranged.withColumn("_next", F.lead(key).over(inside))
    firsts = ranged.withColumn("_place", F.row_number().over(inside)).filter("_place = 1")
    firsts = firsts.select("_part", key.alias("_key"))
    parts = W.orderBy("_part")  # a row per range
    ends = firsts.select("_part", F.coalesce(F.lead("_key").over(parts), F.first("_key").over(parts)).alias("_then"))
    chained = placed.join(ends, "_part").withColumn("_next", F.coalesce("_next", "_then"))
    return chained.select("doc_id", "tie", "half", F.col("_next.doc_id").alias("next_id"), F.col("_next.tie").alias("next_tie"))


def number(doc_id: str) -> Column:
    """A doc_id that isn't null; the tie tells a null from the number in its place."""
    return F.coalesce(F.col(doc_id), F.lit(-(1 << 63)))


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next n_near``.

    ``n_near`` is asked for documents whose doc_id is divisible by
    ``QUERY_EVERY`` and null for others: how many other documents have a
    fingerprint within ``NEAR_RADIUS`` bits.
    """
    # plain keys without nulls: one dealing out of the texts serves both joins
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text", F.col("doc_id").isNull()))
    thin = docs.select("doc_id", "tie", F.expr("char_length(text) div 2").cast("long").alias("half")).distinct()
    thin = durable(thin)
    spread = max(8, -(-thin.count() // RANGE_ROWS))
    chain = following(thin, spread)
    chain = durable(chain.select("doc_id", number("doc_id").alias("k_id"), F.col("tie").alias("k_tie"), "half", number("next_id").alias("next_id"), "next_tie"))
    own = docs.select(number("doc_id").alias("k_id"), F.col("tie").alias("k_tie"), "text")
    # what the predecessor takes from the beginning of a document
    wants = chain.select(F.col("next_id").alias("k_id"), F.col("next_tie").alias("k_tie"), F.col("k_id").alias("for_id"), F.col("k_tie").alias("for_tie"), "half")
    heads = own.join(wants, ["k_id", "k_tie"])
    heads = heads.select(F.col("for_id").alias("k_id"), F.col("for_tie").alias("k_tie"), F.expr("substring(text, 1, cast(half as int))").alias("head"))
    heads = heads.groupBy("k_id", "k_tie").agg(F.first("head").alias("head"))
    both = own.join(heads, ["k_id", "k_tie"])
    length = F.char_length("text").cast("long")
    both = both.select("k_id", "k_tie", length.alias("n_chars"), "text", F.expr("concat(substring(text, 1, cast(char_length(text) - char_length(text) div 2 as int)), head)").alias("edited"))
    digests = both.select("k_id", "k_tie", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    two = digests.select(
        "k_id", "k_tie", "n_chars", "edited_sha256",
        F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("text").alias("t")), F.struct(F.lit(1).alias("form"), F.col("edited").alias("t")))).alias("v"),
    ).select("k_id", "k_tie", "n_chars", "edited_sha256", F.col("v.form").alias("form"), F.col("v.t").alias("t"))
    marks = fingerprints(two, ["k_id", "k_tie", "n_chars", "edited_sha256", "form"], "t")
    pick = lambda form, name: F.max(F.when(F.col("form") == form, F.col(name)))
    wide = durable(
        marks.groupBy("k_id", "k_tie", "n_chars", "edited_sha256").agg(
            pick(0, "high").alias("high"), pick(0, "low").alias("low"), pick(1, "high").alias("e_high"), pick(1, "low").alias("e_low")
        )
    )
    after = wide.select(F.col("k_id").alias("next_id"), F.col("k_tie").alias("next_tie"), F.col("high").alias("n_high"), F.col("low").alias("n_low"))
    asked = wide.filter(F.col("k_id") % QUERY_EVERY == 0).select("k_id", "k_tie", "high", "low")
    found = asked.join(near_counts(wide, asked), ["high", "low"]).select("k_id", "k_tie", (F.col("n_near") - 1).alias("n_near"))
    linked = wide.join(chain, ["k_id", "k_tie"]).join(found, ["k_id", "k_tie"], "left").join(after, ["next_id", "next_tie"])
    mine = (F.col("high"), F.col("low"))
    return linked.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(*mine).alias("fingerprint"),
        as_text(F.col("e_high"), F.col("e_low")).alias("edited_fingerprint"),
        likeness(mine, (F.col("e_high"), F.col("e_low"))).alias("near_edited"),
        likeness(mine, (F.col("n_high"), F.col("n_low"))).alias("near_next"),
        "n_near",
    )


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(documents(spark, sf_dir, "doc_id", "text"))
