"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct shingles of five words.  Documents with
equal sets form a class and go on as one.  Each class has a sketch; classes
that agree on a band of registers meet in a bucket.  A link is a pair whose
likeliest similarity isn't hopeless and whose full sets, formed from the whole
texts, are at least 75 % alike.

Buckets are not paired off.  First every member is compared with the bucket's
hub, the member that meets most others over all bands; these links are
verified and give components.  Only where members of one bucket are still in
different components are pairs looked for again.  There the shingles that a
member alone has bound what it can share with anyone, exactly, and most strays
drop out; the others are compared sketch against sketch in blocks of bounded
size, and only pairs that join two components and look alike are verified.  So
a group of many copies costs about a comparison a member, and no link between
different components is lost.

All tables here grow with the documents, so their joins are merges: a broadcast
would pass through the driver, however small it is.

Bands: with 32 bands of 4 registers a pair of similarity 0.75 shares no band
with probability 5e-6; the estimate's floor lies 4 standard errors below 0.75.

Defined results: a document without words or text has an empty set and is
linked with nothing; a row without doc_id is linked with nothing, has no
component and is kept; repeated rows fall into one class; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepanel.llm.components import components
from sitepanel.llm.registry import query
from sitepanel.llm.setsketch import REGISTERS, band_keys, likeliest_jaccard, sketches
from sitepanel.llm.store import documents, durable
from sitepanel.llm.wordhash import GOLDEN, in_pieces, mix, shingle_sets

WORDS = 5
PERCENT = 75
BANDS, WIDTH = 32, 4
FLOOR = 0.60
BLOCK = 256
STRAY_ROUNDS = 3
SLICE = 256  # partners that follow one copy of an anchor's text, about


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id n_shingles first second sketch`` of every whole text; ``first second`` identify the set."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].astype("Int64")
            for start, piece in in_pieces(list(batch["text"])):
                sets = shingle_sets(piece, words)
                rows = sketches(sets)
                yield pd.DataFrame(
                    {
                        "doc_id": ids.iloc[start : start + len(piece)].to_numpy(dtype=object, na_value=None),
                        "n_shingles": [len(s) for s in sets],
                        "first": [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets],
                        "second": [int(mix(s ^ GOLDEN).sum(dtype=np.uint64).view(np.int64)) for s in sets],
                        "sketch": [r.tobytes() for r in rows],
                    }
                )

    schema = "doc_id long, n_shingles long, first long, second long, sketch binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(sign, schema)


def bucket_members(classes: DataFrame) -> DataFrame:
    """``key id size``: in which buckets of two or more a class is."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys = band_keys(registers(batch["sketch"]), BANDS, WIDTH)
                yield pd.DataFrame({"key": keys.ravel(), "id": np.repeat(batch["id"].to_numpy(), BANDS)})

    members = classes.select("id", "sketch").mapInPandas(cut, "key long, id long")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return members.join(sizes.hint("merge"), "key")


def registers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint16).reshape(-1, REGISTERS)


def size_fits(n: Column, m: Column, percent: int) -> Column:
    """Sets of too different size can't be alike."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a b`` whose sizes fit and whose likeliest similarity reaches the floor."""
    one = classes.select(F.col("id").alias("a"), F.col("n_shingles").alias("n"), F.col("sketch").alias("s"))
    two = classes.select(F.col("id").alias("b"), F.col("n_shingles").alias("m"), F.col("sketch").alias("t"))
    joined = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").filter(size_fits(F.col("n"), F.col("m"), percent))

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                j = likeliest_jaccard(registers(x["s"]), registers(x["t"]), x["n"].to_numpy(float), x["m"].to_numpy(float))
                yield x.loc[j >= floor(percent), ["a", "b"]]

    return joined.mapInPandas(estimate, "a long, b long")


def floor(percent: int) -> float:
    return FLOOR * percent / PERCENT


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id text`` of the classes ``ids``: all texts are dealt out once, the needed ones written."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    return durable(texts.join(ids.hint("merge"), "id").dropDuplicates(["id"]))


def dealt_out(pairs: DataFrame) -> DataFrame:
    """``anchor slice id`` for each of the pairs ``a b``: the end with more partners, which come in slices, and the other.

    An anchor with many partners has a slice for about every ``SLICE`` of them, so none is one task's alone.
    """
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    partners = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    counted = pairs.join(partners.toDF("a", "n").hint("merge"), "a").join(partners.toDF("b", "m").hint("merge"), "b")
    more = F.col("n") >= F.col("m")
    slices = F.ceil(F.greatest("n", "m") / SLICE)
    ends = counted.select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("anchor"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("id"), slices.alias("_slices"))
    return ends.select("anchor", F.pmod(F.xxhash64("id"), "_slices").alias("slice"), "id")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a b`` whose full sets are alike, formed anew from the whole ``texts`` (id, text).

    Rows are sorted so that an anchor's text is followed by those of a slice of
    its partners: a task holds one anchor's set and a batch of texts, and an
    anchor's text travels once a slice and not once a pair.
    """
    dealt = durable(dealt_out(pairs))
    leads = dealt.select("anchor", "slice").distinct().join(texts.toDF("anchor", "text").hint("merge"), "anchor")
    leads = leads.select("anchor", "slice", F.lit(None).cast("long").alias("id"), "text")
    rows = leads.union(dealt.join(texts.hint("merge"), "id").select("anchor", "slice", "id", "text"))
    rows = rows.repartition("anchor", "slice").sortWithinPartitions("anchor", "slice", F.col("id").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            lead = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            alike = np.zeros(len(lead), dtype=bool)
            for start, piece in in_pieces(text.as_py() for text in batch.column(2)):
                for place, x in enumerate(shingle_sets(piece, words), start):
                    if lead[place]:
                        own = x
                    else:
                        both = len(np.intersect1d(x, own, assume_unique=True))
                        alike[place] = 100 * both >= percent * (len(x) + len(own) - both) > 0
            yield batch.select([0, 1]).filter(pa.array(alike))

    found = rows.select("anchor", "id", "text").mapInArrow(compare, "anchor long, id long")
    return found.select(F.least("anchor", "id").alias("a"), F.greatest("anchor", "id").alias("b"))


def hub_pairs(members: DataFrame) -> DataFrame:
    """``a b``: every member of a bucket with the bucket's hub, each pair once."""
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    hubs = members.join(degree.hint("merge"), "id").groupBy("key").agg(F.max(F.struct("degree", -F.col("id"), "id")).alias("_hub"))
    pairs = members.join(hubs.select("key", F.col("_hub.id").alias("hub")).hint("merge"), "key").filter("id != hub")
    return pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def lone_shingles(texts: DataFrame, words: int) -> DataFrame:
    """``id lone``: how many shingles of a text are in none of the other ``texts`` (id, text)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for start, piece in in_pieces(list(x["text"])):
                sets = shingle_sets(piece, words)
                owner = np.repeat(x["id"].to_numpy()[start : start + len(piece)], [len(s) for s in sets])
                yield pd.DataFrame({"shingle": np.concatenate(sets).view(np.int64), "id": owner})

    shingles = texts.mapInPandas(cut, "shingle long, id long")
    lone = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("id")).filter("_n = 1")
    return lone.groupBy("id").agg(F.count(F.lit(1)).alias("lone"))


def mixed_buckets(named: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component, with the bucket's present size."""
    kinds = named.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("component").alias("_low"), F.max("component").alias("_high")
    )
    return named.drop("size").join(kinds.filter("_low != _high").select("key", "size").hint("merge"), "key")


def pairs_between(
    members: DataFrame, classes: DataFrame, labels: DataFrame, tried: DataFrame, texts: DataFrame, words: int, percent: int
) -> DataFrame:
    """Untried pairs ``a b`` of one bucket and two components that look alike, by blocks of members.

    A class shares at most its shingles that are not its own alone; where too
    few are left for ``percent`` % with anyone, it takes no further part.  What
    it had in common with others like it is then theirs alone, so this is done
    ``STRAY_ROUNDS`` times.
    """
    named = members.join(labels.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    # the hub has been compared with all: a bucket of two holds nothing new
    rows = durable(mixed_buckets(named.filter("size > 2")))
    about = classes.select("id", "n_shingles", "sketch").join(rows.select("id").distinct().hint("merge"), "id")
    for _ in range(STRAY_ROUNDS):
        lone = lone_shingles(texts.join(about.select("id").hint("merge"), "id"), words)
        counted = about.drop("lone").join(lone.hint("merge"), "id", "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
        about = counted.filter(F.expr(f"100 * (n_shingles - lone) >= {percent} * n_shingles"))
        rows = durable(mixed_buckets(rows.join(about.select("id").hint("merge"), "id")))
        about = durable(about.join(rows.select("id").distinct().hint("merge"), "id"))
    rows = rows.withColumn("_blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.expr("sequence(0, _blocks - 1)")).alias("_other"))
    rows = rows.join(about.hint("merge"), "id")
    rows = rows.select(
        "key", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"), "_block", "id", "component", "n_shingles", "lone", "sketch"
    )

    def look(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        x = x.sort_values("id")
        left, right = (np.flatnonzero(x["_block"].to_numpy() == k) for k in (i, j))
        r, ids, parts, n = registers(x["sketch"]), x["id"].to_numpy(), x["component"].to_numpy(), x["n_shingles"].to_numpy(float)
        lone = x["lone"].to_numpy(float)
        a, b = [], []
        for at in range(0, len(left), 32):
            p, q = left[at : at + 32, None], right[None, :]
            most = np.minimum(n[p] - lone[p], n[q] - lone[q])  # in common
            go = (parts[p] != parts[q]) & (most * 100 >= np.maximum(n[p] + lone[q], n[q] + lone[p]) * percent)
            if i == j:
                go &= ids[p] < ids[q]
            if not go.any():
                continue
            ties = r[p[:, 0]][:, None, :] == r[right][None, :, :]
            go &= ties.sum(axis=2) >= (floor(percent) - 0.05) * REGISTERS
            # the first band that a pair shares is this one, or another bucket lists it
            first, second = np.nonzero(go)
            shared = ties[first, second, : BANDS * WIDTH].reshape(len(first), BANDS, WIDTH).all(axis=2)
            mine = band_keys(r[p[:, 0]], BANDS, WIDTH)[first, np.argmax(shared, axis=1)] == key[0]
            a.append(p[first[mine], 0])
            b.append(right[second[mine]])
        if not a or not sum(map(len, a)):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        a, b = np.concatenate(a), np.concatenate(b)
        like = likeliest_jaccard(r[a], r[b], n[a], n[b]) >= floor(percent)
        a, b = ids[a[like]], ids[b[like]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    found = rows.groupBy("key", "i", "j").applyInPandas(look, "a long, b long").distinct()
    return found.join(tried.hint("merge"), ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id n_shingles component_id kept`` for every row of ``docs`` (doc_id, text)."""
    signed = durable(signatures(docs, words))
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "first", "second"]
    least = durable(usable.groupBy(*same).agg(F.min("doc_id").alias("id")))
    mine = usable.withColumnRenamed("doc_id", "id").join(least.hint("merge"), [*same, "id"])
    classes = durable(mine.select("id", "n_shingles", "sketch").dropDuplicates(["id", "n_shingles", "sketch"]))
    members = durable(bucket_members(classes))
    tried = durable(hub_pairs(members))
    texts = texts_of(docs, members.select("id").distinct())
    links = durable(verified(durable(likely(tried, classes, percent)), texts, words, percent))
    labels = durable(components(links))
    more = durable(pairs_between(members, classes, labels, tried, texts, words, percent))
    more = durable(verified(more, texts, words, percent))
    named = more.join(labels.select(F.col("id").alias("a"), F.col("component").alias("ca")).hint("merge"), "a", "left")
    named = named.join(labels.select(F.col("id").alias("b"), F.col("component").alias("cb")).hint("merge"), "b", "left")
    over = durable(components(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))))
    over = over.select(F.col("id").alias("_of"), F.col("component").alias("_over"))
    named = least.join(labels.hint("merge"), "id", "left").withColumn("_of", F.coalesce("component", "id")).join(over.hint("merge"), "_of", "left")
    named = durable(named.select(*same, F.coalesce("_over", "_of").alias("component_id")))
    found = signed.select("doc_id", *same).join(named.hint("merge"), same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


SQL = r"""
with recursive words as materialized (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
sets as materialized (
  select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) end) as s
  from words),
shingles as materialized (select doc_id, unnest(s) as x from sets),
common as materialized (
  select p.doc_id as a, q.doc_id as b, count(*) as n from shingles p join shingles q on p.x = q.x and p.doc_id < q.doc_id group by all),
links as materialized (
  select a, b from common join sets p on p.doc_id = a join sets q on q.doc_id = b where 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
both_ways as materialized (select a, b from links union all select b, a from links),
reach as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
least as (select a, min(b) as m from reach group by a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) as component_id,
  s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) as kept
from sets s left join least on s.doc_id = a
"""


@query("op5_neardup", SQL)
def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
