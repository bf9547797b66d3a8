"""Operator 13, source divergence audit by one-hot level products.

Every language keeps the terms that stand in at least ``min_docs`` of its documents. A term's count in a group
(language, source) is its level there, from 0 on, and a level has a price p, an exact integer. The kept terms of a
language are cut into blocks; in a block an indicator column stands for every (group, level) that occurs, and the
matrix of these columns, times its transpose, holds the joint table of levels of every two groups: how many terms
have this level here and that level there. Priced entry by entry and added up, the tables give the divergence of
all pairs of groups. Blocks are multiplied in pieces of at most ``columns`` columns, of terms of like frequency,
so that a column stands for many terms; the entries are counts below 2^24, exact as 32-bit floats.

Counting is per task before it is per term; only counts of (language, source, term) are shuffled. A block is
bounded by rows, and only sums of pairs leave it. The number of rows of part ``pair`` is the result's own size.

Edge cases: null text, language and source are ''; documents without terms still make their group; a language
without kept terms has pairs of value 0; one group alone has no pairs; repeated rows count as documents of their
own; ties go by the bytes of the item; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshlane.llm.common import arrow_map, written
from freshlane.llm.tokens import slices

MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Rows (term, source) of a block, and columns multiplied at once.
BLOCK_ROWS, COLUMNS = 400_000, 1024
#: Different (group, term) that a task holds before it hands on its counts (memory, not a result bound).
HELD = 500_000

#: ASCII by byte: letters lower case, all else ASCII a gap; other bytes stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents) of every term of every group."""
    def run(batches):
        held = defaultdict(lambda: (Counter(), Counter()))

        def out():
            for (lang, source), (n, in_docs) in held.items():
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()),
                         pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()),
                         pa.array([in_docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for whole in batches:
            for b in slices(whole):
                for text, lang, source in zip(*[b.column(c).to_pylist() for c in ("text", "lang", "source")]):
                    terms = text.encode().translate(LETTERS).split()
                    n, in_docs = held[lang, source]
                    n.update(terms)
                    in_docs.update(set(terms))
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield from out()
        yield from out()

    found = arrow_map(docs.select("text", "lang", "source"), run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)), in exact decimals."""
    above = (n.cast("decimal(18,0)") + 2) * F.lit(UNIT).cast("decimal(10,0)")
    below = total.cast("decimal(18,0)") + 2 * terms.cast("decimal(18,0)")
    return F.call_function("div", above, below) + 1


def gap(p, q):
    """floor((p - q)^2 / (p + q)) of integers below 2^31; of columns or arrays."""
    if isinstance(p, Column):
        return F.call_function("div", (p - q) * (p - q), p + q)
    return (p - q) ** 2 // (p + q)


def joint_tables(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Non-zero entries (column, other column, number of terms) for columns of ascending groups, and the columns.

    ``levels`` has a row for each term and a column for each group; a returned column is group << 32 | level.
    """
    groups = np.arange(levels.shape[1], dtype=np.int64) << 32
    columns, place = np.unique(levels + groups, return_inverse=True)
    hot = np.zeros((len(levels), len(columns)), np.float32)
    hot[np.arange(len(levels))[:, None], place.reshape(levels.shape)] = 1
    table = hot.T @ hot
    i, j = np.nonzero(table)
    later = columns[i] >> 32 < columns[j] >> 32
    i, j = i[later], j[later]
    return i, j, table[i, j].astype(np.int64), columns


def pair_sums(levels: np.ndarray, most: int) -> np.ndarray:
    """Summed prices of all pairs of groups (upper triangle); ``levels`` holds the price of every term and group."""
    sums = np.zeros((levels.shape[1],) * 2, np.int64)
    todo = [(0, len(levels))]
    while todo:
        start, stop = todo.pop()
        part = levels[start:stop]
        if stop - start > 1 and (stop - start >= 1 << 24 or sum(len(np.unique(c)) for c in part.T) > most):
            middle = (start + stop) // 2
            todo += [(start, middle), (middle, stop)]
        elif stop > start:
            i, j, n, columns = joint_tables(part)
            p, q = columns[i] & 0xFFFFFFFF, columns[j] & 0xFFFFFFFF
            np.add.at(sums, (columns[i] >> 32, columns[j] >> 32), n * gap(p, q))
    return sums


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block_rows: int = BLOCK_ROWS,
               columns: int = COLUMNS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank of ``docs`` (text, lang, source)."""
    filled = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = written(term_counts(filled), "term-counts")
    kept = (counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"))
            .where(F.col("docs") >= min_docs).select("lang", "term", "in_lang"))
    rows = written(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-terms")

    langs = (rows.groupBy("lang", "term").agg(F.first("in_lang").alias("in_lang"), F.count("*").alias("n"))
             .groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"), F.sum("n").alias("rows")))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (filled.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .fillna(0, ["total", "terms", "lang_total", "rows"]))
    groups = written(groups.withColumn("blocks", F.greatest(F.ceil(F.col("rows") / block_rows), F.lit(1)).cast("int")), "groups")

    priced = rows.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "in_lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"),
        price(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        price(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q"))
    priced = written(priced, "priced")

    nought = F.when(F.col("terms") > 0, price(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0)
    dealt = groups.select(F.col("lang").alias("g_lang"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("g_block"),
                          F.col("source").alias("g_source"), nought.alias("p0"))

    def multiply(left, right):
        lang = right.column("g_lang")[0].as_py()
        order = np.argsort(np.array(sources := right.column("g_source").to_pylist(), object))
        sources = [sources[i] for i in order]
        at = {s: i for i, s in enumerate(sources)}
        terms = left.column("term").dictionary_encode().combine_chunks()
        term, n = terms.indices.to_numpy(), len(terms.dictionary)
        often = np.zeros(n, np.int64)
        often[term] = left.column("in_lang").to_numpy()
        levels = np.tile(right.column("p0").to_numpy()[order], (n, 1))
        levels[term, np.array([at[s] for s in left.column("source").to_pylist()], np.int64)] = left.column("p").to_numpy()
        sums = pair_sums(levels[np.argsort(often, kind="stable")], columns)
        i, j = np.triu_indices(len(sources), 1)
        return pa.table([pa.array([lang] * len(i), pa.string()), pa.array([sources[k] for k in i], pa.string()),
                         pa.array([sources[k] for k in j], pa.string()), pa.array(sums[i, j])], names=["lang", "a", "b", "value"])

    sums = (priced.select("lang", "block", "source", "term", "in_lang", "p").groupBy("lang", "block")
            .cogroup(dealt.groupBy("g_lang", "g_block")).applyInArrow(multiply, "lang string, a string, b string, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = F.explode(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")]))
    pairs = sums.select("lang", both.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    terms = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                         gap(F.col("p"), F.col("q")).alias("value"))
    ranks = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", ranks).unionByName(terms.select("*", ranks).where(F.col("rank") <= top))


#: The whole result in SQL.
ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents),
words AS (
  SELECT row_no, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row_no) >= 10),
size_of AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (
  SELECT g.lang, g.source, k.term, k.n AS in_lang, CAST(coalesce(c.n, 0) AS HUGEINT) AS n
  FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL) c
    ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM counts GROUP BY lang, source),
priced AS (
  SELECT c.lang, c.source, c.term, c.n,
         1 + (1000000000 * (c.n + 2)) // (t.total + 2 * s.v) AS p,
         1 + (1000000000 * (c.in_lang + 2)) // (s.total + 2 * s.v) AS q
  FROM counts c JOIN totals t ON c.lang = t.lang AND c.source = t.source JOIN size_of s ON s.lang = c.lang),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
             FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) x
    ON x.lang = g.lang AND x.source = g.source AND x.item = h.source),
terms AS (
  SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM priced WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank
FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value,
         CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM terms) WHERE rank <= 10
"""
