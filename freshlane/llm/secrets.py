"""Operator 9, secret scans with a random forest for false-positive removal.

Candidates are runs of at least 16 letters, digits and ``+/_.-`` that do not end in a point (``=`` may follow). A forest judges
each by its length, its character transitions and make-up, the share of it that dictionary words cover, the
path it may stand in, and its neighbouring words. The dictionary is the corpus itself: letter runs of
candidates that stand as words of their own at least ``MIN_WORD`` times in all documents.

The forest learns from labelled findings: a table (doc_id, start, end, secret), or, without one, the
candidates that a format or an assignment decides beyond doubt (``decided``). It is fitted on at most
``max_labelled`` of them, the first by a hash; every candidate of every whole text is judged.

Edge cases: a null or empty text has no candidates; equal candidates at several places are several
findings; with labels of one class only, or none, undecided candidates score 0 and decided ones
0 or 1; repeated rows repeat their findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshlane.llm.common import packed_rows, unpacked, written
from freshlane.llm.private import matches, may_be, term_filter

CANDIDATE = r"(?:\G|(?<![A-Za-z0-9+/_.-]))[A-Za-z0-9+/_.-]{15,}[A-Za-z0-9+/_-]={0,2}"
#: Formats that name their issuer, and assignments to a telling name (fixed values).
ISSUED = (r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}"
          r"|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)$")
ASSIGNED = r"(?i)(token|secret|passw(or)?d|pwd|api_?key|access_?key|private_?key)[\"']?\s*(=|:|=>)\s*[\"']?$"
HOST_OR_FILE = r"(?i)\.(com|org|net|io|html?|php|py|js|txt|pdf|png|jpe?g)$"
REACH, MIN_WORD, MAX_LABELLED, NEIGHBOURS = 40, 20, 20_000, 16


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, value, before, after of every candidate of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).where(F.col("text").rlike(CANDIDATE))
    rows = found.select("doc_id", "text", F.explode(matches(F.col("text"), F.lit(CANDIDATE), "candidate", 0)).alias("s"))
    return rows.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"),
                       F.col("s.value").alias("value"),
                       F.expr(f"substring(text, greatest(s.start - {REACH}, 0) + 1, s.start - greatest(s.start - {REACH}, 0))").alias("before"),
                       F.expr(f"substring(text, s.end + 1, {REACH})").alias("after"))


def decided() -> Column:
    """1 or 0 for a candidate whose format or place leaves no doubt, else null."""
    v = F.col("value")
    return (F.when(v.rlike(ISSUED), 1)
            .when(v.rlike("[0-9]") & F.col("before").rlike(ASSIGNED), 1)
            .when(v.rlike(r"^[\p{Alpha}_.-]+$") | v.rlike(r"^[0-9.+/_-]+$") | v.rlike(HOST_OR_FILE)
                  | F.col("before").rlike(r"(://|www\.)\S*$"), 0))


def with_coverage(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Add ``covered``, the letters of a candidate's runs of four letters or more that are words of the corpus."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{4,}"), F.lit(0)))
    pieces = written(found.select("value").distinct().select("value", F.explode(runs).alias("term")), "pieces")
    maybe = term_filter(pieces.select("term").distinct())
    every = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}+/_=.-]+")).alias("w"))
    every = every.select(F.regexp_replace("w", r"[.]+$", "").alias("term")).where(may_be(maybe, F.col("term")))
    known = every.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_WORD).select("term")
    cover = pieces.join(known, "term").groupBy("value").agg(F.sum(F.length("term")).alias("covered"))
    return found.join(cover, "value", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def features() -> Column:
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    n = F.length(v).cast("double")
    share = lambda pattern: (n - F.length(F.regexp_replace(v, pattern, ""))) / n
    runs = F.size(F.regexp_extract_all(v, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0)))
    chars = F.split(v, "")
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(
        (n - F.length(F.replace(v, c, F.lit("")))) / n * F.ln((n - F.length(F.replace(v, c, F.lit("")))) / n)))
    flag = lambda c: c.cast("double")
    last = F.lower(F.regexp_extract(before, r"([\p{L}\p{N}_]+)[^\p{L}\p{N}_]*$", 1))
    next_ = F.lower(F.regexp_extract(after, r"^[^\p{L}\p{N}_]*([\p{L}\p{N}_]+)", 1))
    near = [flag(F.pmod(F.xxhash64(w), F.lit(NEIGHBOURS)) == k) for w in (last, next_) for k in range(NEIGHBOURS)]
    return array_to_vector(F.array(
        n, share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[0-9a-f]"), share("[^A-Za-z0-9]"),
        F.size(F.array_distinct(chars)) / n, entropy,
        (runs - 1) / n,                                                     # transitions between character classes
        share("[a-z](?=[0-9])"), share("[0-9](?=[a-z])"), share("[A-Z](?=[0-9])"), share("[0-9](?=[A-Z])"),
        share("[a-z](?=[A-Z])"),
        F.col("covered") / n,
        share("/"), share("[.]"), flag(before.rlike(r"/$")), flag(before.rlike(r"(://|www\.)\S*$")), flag(v.rlike(HOST_OR_FILE)),
        flag(before.rlike(r"[=:]\s*[\"']?$")), flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")), *near))


def scan(docs: DataFrame, labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED,
         trees: int = 20, depth: int = 6) -> DataFrame:
    """doc_id, start, end, value, score (the forest's probability, 4 digits), secret (score >= 0.5) of every candidate."""
    found = written(candidates(docs), "candidates")
    shown = written(with_coverage(found, docs).withColumn("features", features()).withColumn("label", decided())
                    .drop("before", "after"), "findings")
    if labelled is None:
        taught = shown.where("label IS NOT NULL")
    else:
        told = labelled.select("doc_id", "start", "end", F.col("secret").cast("int").alias("label")).where("label IS NOT NULL")
        taught = shown.drop("label").join(told, ["doc_id", "start", "end"])
    sample = (taught.select("features", F.col("label").cast("double").alias("label"), F.xxhash64("value", "doc_id", "start").alias("h"))
              .orderBy("h").limit(max_labelled))
    sample = written(sample, "labelled")
    if sample.select("label").distinct().count() < 2:
        judged = shown.withColumn("score", F.coalesce(F.col("label").cast("double"), F.lit(0.0)))
    else:
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, labelCol="label").fit(sample)
        judged = forest.transform(shown).withColumn("score", F.round(vector_to_array("probability")[1], 4))
    return judged.select("doc_id", "start", "end", "value", "score", (F.col("score") >= 0.5).alias("secret"))


def redacted(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """``docs`` with each finding that is a secret replaced by ``[SECRET]`` in ``text``."""
    spans = (findings.where("secret").groupBy(F.col("doc_id").alias("__id"))
             .agg(F.sort_array(F.collect_set("value"), asc=False).alias("__v")))         # values of one document
    text = F.aggregate("__v", F.col("text"), lambda t, v: F.replace(t, v, F.lit("[SECRET]")))
    joined = packed_rows(docs).join(spans, F.expr("doc_id <=> __id"), "left")
    return unpacked(joined, docs.columns, text=F.when(F.col("__v").isNotNull(), text).otherwise(F.col("text")))
