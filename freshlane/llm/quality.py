"""Operator 1, quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Tokens are lower-case runs of letters, digits and underscores, or of other non-space characters. The
unigrams and bigrams of all documents are hashed into ``buckets``; one multinomial is estimated
from all documents, one from the trusted ones (label quality 1). A document's score is the mean, over
its n-grams, of ln p_target - ln p_raw, and it is kept if that is at least ``threshold`` and it
passes the base rules (enough words, not mostly repeated three-word windows).

The texts are shuffled once, to meet their labels; counting is partial per task, so only buckets are
shuffled, and the weights (one number per bucket) reach the second pass as a scalar subquery.

Edge cases: a null or empty text has no words and fails the base rules; a text without n-grams
scores 0; without trusted documents all scores are 0; a document is trusted if any label row for
it is; null label ids and null labels are ignored; repeated rows count and are judged again.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshlane.llm.common import words

#: ASCII punctuation, each character named: the regular expression engine looks them up in one table, but tries ranges in turn.
PUNCTUATION_RUN = "[" + "".join("\\" + c for c in string.punctuation) + "]+"
PUNCTUATION = f"({PUNCTUATION_RUN})"
SYMBOLS = r"[#*$%&|<>]"
WHITE = " \t\n\x0b\x0c\r"
BUCKETS = 16384
THRESHOLD = -0.25
#: Up to so many different repeated windows are looked up one by one; more are found by sorting.
FEW = 32


def grams(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per token of ``df`` (text): its other columns, and the buckets of the unigram (one) and of
    the bigram it begins (two; null at the end). A text without tokens gives one row of nulls."""
    spaced = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), PUNCTUATION_RUN, " $0 ")
    rest = [c for c in df.columns if c != "text"]
    df = df.select(*rest, words(spaced).alias("__tokens"))
    pairs = F.arrays_zip(F.col("__tokens").alias("a"), F.slice("__tokens", F.lit(2), F.greatest(
        F.size("__tokens") - 1, F.lit(0))).alias("b"))
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    return df.select(*rest, F.explode_outer(pairs).alias("__p")).select(
        *rest, F.when(F.col("__p").isNotNull(), bucket(F.col("__p")["a"])).alias("one"),
        F.when(F.col("__p")["b"].isNotNull(), bucket(F.col("__p")["a"], F.col("__p")["b"])).alias("two"))


def zipped(c: str, n: int) -> Column:
    """Array of the runs of ``n`` neighbours of array column ``c``, as structs; empty if it is shorter."""
    size = F.size(c) - (n - 1)
    return F.when(size > 0, F.arrays_zip(*[F.slice(c, F.lit(i + 1), F.greatest(size, F.lit(0))) for i in range(n)]))


def with_repeat_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words to ``df`` (w: words): words inside three-word windows that occur twice or more.

    Windows are hashed and, if any is there twice, sorted; neighbours that are equal give the repeated hashes. The positions
    of a few of those are looked up directly, those of many by sorting hashes with their positions.
    """
    df = df.withColumn("win", F.coalesce(F.transform(zipped("w", 3), lambda x: F.xxhash64(x)),
                                         F.array().cast("array<bigint>")))
    df = df.withColumn("sorted", F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array("win"))
                       .otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("twice", F.array_distinct(F.filter("sorted", lambda h, i: h == F.get("sorted", i + 1))))
    df = df.withColumn("byhash", F.when(F.size("twice") > FEW, F.array_sort(
        F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: (x["h"] == F.get("byhash", i + 1)["h"]) | (x["h"] == F.get("byhash", i - 1)["h"])
    df = df.withColumn("starts", F.when(F.size("twice") == 0, F.array().cast("array<int>")).when(
        F.size("twice") <= FEW, F.filter(F.transform("win", lambda h, i: F.when(
            F.array_contains("twice", h), i)), lambda i: i.isNotNull())).otherwise(
        F.array_sort(F.transform(F.filter("byhash", same), lambda x: x["i"]))))
    covered = F.aggregate(F.transform("starts", lambda s, i: F.least(F.lit(3), F.coalesce(
        F.get("starts", i + 1) - s, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", covered).drop("win", "sorted", "twice", "byhash", "starts")


def base_rules(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed to ``docs`` (text)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")
    df = docs.withColumn("w", words(F.col("text")))
    df = df.withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
    df = with_repeat_words(df.withColumn("n_words", F.size("w").cast("long")))
    return (df.drop("w")
            .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"))
            .withColumn("lines", lines)
            .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
            .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))


def gram_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0) -> DataFrame:
    """One row, one array: ln p_target - ln p_raw of each bucket, by bucket number."""
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    marked = docs.select("doc_id", "text").join(   # hashing the ids spares a sort of the texts
        trusted.withColumn("trusted", F.lit(1)).hint("shuffle_hash"), "doc_id", "left")
    found = grams(marked.select("text", "trusted"), buckets)
    found = found.select(F.explode(F.array("one", "two")).alias("bucket"), "trusted")
    counts = found.where("bucket IS NOT NULL").groupBy("bucket").agg(
        F.count("*").alias("raw"), F.count("trusted").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct(       # exactly ``buckets`` entries
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))).alias("c"))
    zero = F.lit(0).cast("long")
    row = row.select("c", F.aggregate("c", zero, lambda a, x: a + x["raw"]).alias("n_raw"),
                     F.aggregate("c", zero, lambda a, x: a + x["target"]).alias("n_target"))
    share = lambda x, n: F.ln((x[n] + smoothing) / (F.col("n_" + n) + smoothing * buckets))
    return row.select(F.transform("c", lambda x: F.when(F.col("n_target") > 0, share(x, "target") - share(x, "raw"))
                                  .otherwise(F.lit(0.0))).alias("weights"))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the base columns, score and kept of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    weights = gram_weights(docs, labels, buckets).scalar()
    base = base_rules(docs).withColumn("__row", F.monotonically_increasing_id())
    found = grams(base, buckets)
    weight = lambda c: F.coalesce(F.get(weights, F.col(c)), F.lit(0.0))
    keys = [c for c in found.columns if c not in ("one", "two")]
    scored = found.groupBy(*keys).agg(F.sum(weight("one") + weight("two")).alias("__sum"),
                                      (F.count("one") + F.count("two")).alias("__n"))
    return (scored.withColumn("score", F.when(F.col("__n") > 0, F.col("__sum") / F.col("__n")).otherwise(F.lit(0.0)))
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
            .drop("__sum", "__n", "__row"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns (a repeated id: if one of its texts is; a null id: always)."""
    verdicts = judged(docs.select("doc_id", "text"), labels, threshold, buckets)
    bad = verdicts.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select(F.col("doc_id").alias("__id"))
    return docs.join(bad, docs["doc_id"] == F.col("__id"), "left_anti")
