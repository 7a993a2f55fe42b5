"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of key characters, of which a word may hold several: one of
at least ``LEAST`` characters with a digit in it, or any that a credential's
name is assigned to.  The name is looked for just before each run.  Its features are the length, the transitions between kinds
of characters, the share of each kind and of different characters, how much of
it is made of words of the corpus' dictionary, whether it looks like a path, an
address or a number, and the words beside it.  The forest is trained on
labelled findings.  Where no audited ones are given, ``sure_findings`` labels
those that rules can be sure of: keys of a provider's fixed form and values
assigned to a credential's name are secrets; addresses, numbers, paths, dates,
identifiers and runs made of dictionary words are not.  The provider's prefix
is no feature, so that the forest has to tell by the other traits.

All of it are DataFrame functions and Spark's own forest; texts are looked at
as a whole, the dictionary counts the words of all of them.

Defined results: null and empty texts have no candidates; each occurrence is a
finding of its own; rows of equal doc_id and text are scanned as one; with only
one kind of labelled findings, or none, a candidate's score is its label by
rule, 0.5 where the rules aren't sure.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepanel.llm.registry import query
from sitepanel.llm.store import documents, durable

LEAST = 12
BLOCK = 256  # words whose lengths are summed up once
SHARE = 2e-6  # of the words of a language, from which on a word is in the dictionary
SALTS = 16  # places that a part of candidates is dealt to, however common it is
FINDINGS = 20_000  # most labelled findings to train on
TREES, DEPTH = 24, 6
SECRET_FROM = 0.5
REDACTED = "[REDACTED]"
BREAK = r"[\x20\x09-\x0D]"
RUN = r"[A-Za-z0-9+/_=.\-]{12,}"
# a run of key characters: an address, but not a password before a host, or else a run with its padding
PIECE = (
    r"(?<![:A-Za-z0-9+/_.%\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"
    r"|[A-Za-z0-9+/_.\-]*[A-Za-z0-9+/_\-](?:={1,2}(?![A-Za-z0-9+/_.=\-]))?"
)
ASSIGNS = r"^[^,;&|?]*[=:][^,;&|?]*$"  # what may stand between a name and its value
# fixed values: names that credentials are assigned to, and forms of providers' keys
NAMES = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)"
PROVIDERS = r"(AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_\-]{35}|sk_live_[0-9a-zA-Z]{24}"
FEATURES = [
    "n", "runs", "transitions", "digits", "capitals", "symbols", "different", "covered", "slashes", "dots", "at_sign",
    "only_digits", "hexadecimal", "dashed_groups", "assigned", "named", "quoted", "word_before", "word_after",
]


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id tie place start value word before before2 after``: every candidate of every whole text.

    ``start`` is the value's first character, counted from 0; ``tie`` tells texts of one doc_id apart.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    named = lambda c: F.coalesce(c, F.lit("")).rlike(NAMES)
    rows = rows.filter(F.col("text").rlike(RUN) | named(F.col("text"))).dropDuplicates(["doc_id", "tie"])
    rows = rows.withColumn("_words", F.split("text", BREAK)).withColumn("_named", named(F.col("text")))
    shaped = lambda w: (F.length(w) >= LEAST) & w.rlike("[0-9]") & w.rlike(RUN)

    def credential(k: Column) -> Column:
        """A credential's name is assigned something in the word, or the word begins with what it is assigned."""
        word, last = F.get("_words", k), F.coalesce(F.get("_words", k - 1), F.lit(""))
        near = F.concat_ws(" ", F.get("_words", k - 2), last)
        return (word.rlike("[=:]") & (named(word) | (word.rlike(r"^[^A-Za-z0-9]*[=:]") & named(last)))) | (last.rlike("[=:]$") & named(near))

    places = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda k: shaped(F.get("_words", k)) | (F.col("_named") & credential(k)))
    # lengths of blocks of words: what is before a word is then a short sum, not one over all words
    length = lambda words, first, n: F.aggregate(F.slice(words, first + 1, n), F.lit(0).cast("long"), lambda a, w: a + F.length(w) + 1)
    number = F.floor(F.size("_words") / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), number), lambda b: length(F.col("_words"), b * BLOCK, F.lit(BLOCK)))

    def about(sums: Column, k: Column) -> Column:
        """The word at place ``k`` with its neighbours; rows don't carry the other words on."""
        whole = F.floor(k / BLOCK).cast("int")
        before = F.aggregate(F.slice(sums, F.lit(1), whole), F.lit(0).cast("long"), lambda a, n: a + n)
        before = before + length(F.col("_words"), whole * BLOCK, k % BLOCK)
        at = {"word": 0, "before": -1, "before2": -2, "after": 1}
        words = [F.coalesce(F.get("_words", k + d), F.lit("")).alias(name) for name, d in at.items()]
        return F.struct(k.alias("place"), before.alias("_before"), *words)

    # the array of one binds the sums, so that they are formed once a text
    found = F.flatten(F.transform(F.array(blocks), lambda sums: F.transform(places, lambda k: about(sums, k))))
    rows = rows.select("doc_id", "tie", F.explode(found).alias("_found")).select("doc_id", "tie", "_found.*")
    # between the runs are the gaps, one more than there are runs
    rows = rows.withColumn("_runs", F.regexp_extract_all("word", F.lit(PIECE), F.lit(0))).withColumn("_gaps", F.split("word", PIECE, -1))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<k:int,at:bigint>>)").alias("out"))
    walked = F.aggregate(
        F.sequence(F.lit(0), F.size("_runs") - 1),
        first,
        lambda a, k: F.struct(
            (a["at"] + F.length(F.get("_gaps", k)) + F.length(F.get("_runs", k))).alias("at"),
            F.concat(a["out"], F.array(F.struct(k.alias("k"), (a["at"] + F.length(F.get("_gaps", k))).alias("at")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    rows = rows.filter(F.size("_runs") > 0).select("*", F.explode(walked).alias("_run"))
    k = F.col("_run.k")
    gap, last = F.get("_gaps", k), F.coalesce(F.get("_runs", k - 1), F.lit(""))
    assigns = gap.rlike(ASSIGNS) & ((k == 0) | last.rlike("[A-Za-z]"))
    rows = rows.withColumn("name", F.when(assigns, F.concat(last, gap)).otherwise("")).withColumn("value", F.get("_runs", k))
    # the words around belong to the first run, or the first that has a name, and to the last one
    lead = (k == 0) | ((k == 1) & assigns)
    rows = rows.withColumns(
        {
            "before": F.when(lead, F.col("before")).otherwise(""),
            "before2": F.when(lead, F.col("before2")).otherwise(""),
            "after": F.when(k == F.size("_runs") - 1, F.col("after")).otherwise(""),
        }
    )
    given = ((F.col("name") != "") | F.col("before").rlike("[=:]$")) & named(F.concat_ws(" ", "before2", "before", "name"))
    # a word that is only a name is no value
    given = given & ~F.coalesce(F.get("_gaps", k + 1).rlike(ASSIGNS), F.lit(False))
    rows = rows.filter(((F.length("value") >= LEAST) & F.col("value").rlike("[0-9]")) | given)
    return rows.select(
        "doc_id", "tie", "place", (F.col("_before") + F.col("_run.at")).alias("start"), "value", "word", "name", "before", "before2", "after"
    )


def dictionary(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """``entry``: the words of three letters and more that are at least ``share`` of the words of a language.

    Without a column ``lang`` all texts are of one language.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    words = F.filter(F.split(F.lower(F.col("text").cast("string")), BREAK), lambda w: w.rlike(r"^\p{Ll}{3,}$"))
    counts = durable(docs.select(lang.alias("lang"), F.explode(words).alias("entry")).groupBy("lang", "entry").agg(F.count(F.lit(1)).alias("c")))
    totals = counts.groupBy("lang").agg(F.sum("c").alias("n")).withColumnRenamed("lang", "_lang")  # a row per language
    rows = counts.join(F.broadcast(totals), F.col("lang").eqNullSafe(F.col("_lang")))
    return rows.filter(F.col("c") >= share * F.col("n")).select("entry").distinct()


def with_features(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Candidates with the columns ``FEATURES``."""
    key = ["doc_id", "tie", "start"]
    parts = found.select(*key, F.explode(F.expr(r"regexp_extract_all(lower(value), '[a-z]{3,}', 0)")).alias("entry"))
    # a part of many candidates goes to several places; of the dictionary only what candidates hold is sent along
    known = parts.select("entry").distinct().join(entries, "entry", "left_semi")
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = parts.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int"))
    covered = parts.join(known, ["entry", "_salt"]).groupBy(*key).agg(F.sum(F.length("entry")).alias("_covered"))
    covered = covered.select(*[F.col(k).alias(f"_{k}") for k in key], "_covered")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("tie") == F.col("_tie")) & (F.col("start") == F.col("_start"))
    rows = found.join(covered, same, "left").drop(*[f"_{k}" for k in key])
    value, n = F.col("value"), F.length("value")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "l"), "[A-Z]", "U"), "[0-9]", "0"), "[^lU0]", "-")
    count = lambda pattern: F.length(F.regexp_replace(value, f"[^{pattern}]", ""))
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    return rows.withColumns(
        {
            "n": n.cast("double"),
            "runs": runs.cast("double"),
            "transitions": (runs - 1) / F.greatest(n - 1, F.lit(1)),
            "digits": count("0-9") / n,
            "capitals": count("A-Z") / n,
            "symbols": count(r"+/_=.@:\-") / n,
            "different": F.size(F.array_distinct(F.split(value, ""))) / n,
            "covered": F.coalesce(F.col("_covered"), F.lit(0)) / n,
            "slashes": count("/").cast("double"),
            "dots": count(".").cast("double"),
            "at_sign": flag(value.contains("@")),
            "only_digits": flag(value.rlike(r"^[0-9.:\-]+$")),
            "hexadecimal": flag(value.rlike("^[0-9a-fA-F]+$")),
            "dashed_groups": flag(value.rlike(r"^[0-9A-Fa-f]{2,}(-[0-9A-Fa-f]{2,}){2,}$")),
            "assigned": flag((F.col("name") != "") | F.col("before").rlike("[=:]$")),
            "named": flag(F.concat_ws(" ", "before2", "before", "name").rlike(NAMES)),
            "quoted": flag(F.col("word").rlike("[\"']")),
            "word_before": flag(F.col("before").rlike(r"^\p{L}+[,.;]?$")),
            "word_after": flag(F.col("after").rlike(r"^\p{L}+[,.;]?$")),
        }
    ).drop("_covered")


def rule_label() -> Column:
    """1 or 0 where a rule is sure, else null."""
    scattered = (F.col("digits") > 0.1) & (F.col("covered") < 0.3) & (F.col("at_sign") == 0) & (F.col("only_digits") == 0)
    secret = F.col("value").rlike(f"^({PROVIDERS})$") | ((F.col("assigned") == 1) & (F.col("named") == 1) & scattered)
    harmless = (
        (F.col("at_sign") == 1) | (F.col("only_digits") == 1) | (F.col("dashed_groups") == 1) | (F.col("covered") >= 0.6)
        | (F.col("slashes") >= 2) | F.col("value").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}") | (F.col("value").rlike(r"\.[a-z]{2,}$") & (F.col("dots") >= 2))
    )
    return F.when(secret, 1).when(harmless, 0)


def sure_findings(featured: DataFrame) -> DataFrame:
    return featured.withColumn("label", rule_label()).filter("label is not null")


def fit_forest(labelled: DataFrame, most: int = FINDINGS, seed: int = 7):
    """A forest from featured findings with ``label``, at most ``most`` of them, half of either kind at most; None for one kind."""
    order = F.xxhash64(F.lit(seed), "value", "doc_id", "start")
    some = [labelled.filter(F.col("label") == k).orderBy(order).limit(most // 2).select("label", *FEATURES) for k in (0, 1)]
    sample = durable(some[0].unionByName(some[1]).withColumn("label", F.col("label").cast("double")))
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featuresCol="_features", labelCol="label")
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(sample))


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id tie place start length value score secret``: all candidates of ``docs`` (doc_id, text, and lang if there).

    ``labelled`` are audited findings: featured candidates with a ``label`` of 0 or 1.
    """
    featured = durable(with_features(candidates(docs), durable(dictionary(docs))))
    forest = fit_forest(sure_findings(featured) if labelled is None else labelled)
    if forest is None:
        scored = featured.withColumn("score", F.coalesce(rule_label().cast("double"), F.lit(0.5)))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(featured)
        scored = forest.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        "doc_id", "tie", "place", "start", F.length("value").alias("length"), "value", "score", (F.col("score") > SECRET_FROM).alias("secret")
    )


def redact(docs: DataFrame, findings: DataFrame, mark: str = REDACTED) -> DataFrame:
    """``docs`` with every secret's value replaced by ``mark``; ``n_chars``, if there, follows the text.

    A value of ``LEAST`` characters and more is replaced wherever else the text holds it, too.
    """
    wanted = findings.filter("secret").groupBy(F.col("doc_id").alias("of"), "tie").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("places"),
        F.sort_array(F.collect_set(F.when(F.length("value") >= LEAST, F.struct(-F.length("value"), "value")))).alias("secrets"),  # longest first
    )
    # the caller's columns travel as one, so no name of theirs can meet one of these
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text, hit = F.col("row.text").cast("string"), F.col("places").isNotNull()
    rows = packed.join(wanted, F.col("row.doc_id").eqNullSafe(F.col("of")) & (F.xxhash64(text) == F.col("tie")), "left")
    # the text up to each place and the mark, then what is left
    begun = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    cut = lambda first, n: F.substring(text, (first + 1).cast("int"), n.cast("int"))
    clean = F.aggregate(
        "places",
        begun,
        lambda a, s: F.struct((s["start"] + s["length"]).cast("long").alias("at"), F.concat(a["out"], cut(a["at"], s["start"] - a["at"]), F.lit(mark)).alias("out")),
        lambda a: F.concat(a["out"], cut(a["at"], F.length(text))),
    )
    clean = F.aggregate("secrets", clean, lambda t, s: F.replace(t, s["value"], F.lit(mark)))
    rows = rows.withColumn("clean", F.when(hit, clean))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    own = {c: F.col("row").getField(c) for c in docs.columns}
    return rows.select(*[(F.when(hit, new[c]).otherwise(own[c]) if c in new else own[c]).alias(c) for c in docs.columns])


@query("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir, "doc_id", "text", "lang")).select("doc_id", "start", "length", "score", "secret")
