"""Operator 12, benchmark decontamination by a prefix-filtered set join.

An item is the set of its windows of ``window`` consecutive words (an item of fewer words is one window), and a
window the set of its shingles of ``shingle`` words (or of all its words, if it has fewer). A window occurs where
all its shingles do, so with its shingles ordered by rarity in the corpus the necessary prefix is the rarest one:
only occurrences of that shingle are joined, and a window with a shingle that no text holds is out. The place of
the shingle in the window gives the only place where the window can start (positional bound) and the words that
the text must have (length bound); what is left is verified word for word over a window of the item's size.

Shingles of texts pass a filter of fixed size before any shuffle; the joins behind it are exact. Equal texts are
searched once. Words are runs of letters, digits and characters beyond ASCII, with A-Z in lower case.

Edge cases: null and empty texts have no words and no hits; items without words are nowhere; a null item_id marks
words but is not listed; repeated items count once, repeated rows give repeated rows, null doc_ids stay; a text's
own windows are bounded by its words; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshlane.llm.common import text_key, written
from freshlane.llm.private import may_be, term_filter

WINDOW, SHINGLE = 10, 5
#: Words of 64 bits in the filter of the benchmark's shingles (1 MB, whatever the input).
SHINGLE_FILTER = 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-/:-`{-\x7f]+"


def item_words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, GAP, -1), "")         # empty at the ends only


def pieces(words: Column, size: Column, make) -> Column:
    """``make(start)`` for every start of ``size`` consecutive words, as an array; empty if there are fewer words."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), make)).otherwise(F.array())


def joined(words: Column, start: Column, size: Column) -> Column:
    """Identity of the words: their MD5 with spaces between them, which no word holds."""
    return F.unhex(F.md5(F.array_join(F.slice(words, start + 1, size), " ")))


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """item (string), win (identity), size, words of every window of ``items`` (item_id, text)."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("all"))
    size = F.least(F.size("all"), F.lit(window))
    rows = rows.where("size(all) > 0").select("item", "all", size.alias("size"))
    starts = F.explode(F.sequence(F.lit(0), F.size("all") - F.col("size"))).alias("start")
    rows = rows.select("item", "size", starts, "all").withColumn("words", F.expr("slice(all, start + 1, size)"))
    return rows.select("item", joined(F.col("words"), F.lit(0), F.col("size")).alias("win"), "size", "words")


def contaminated_texts(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """key (``text_key``), spots (start, size, win of every window in the text, by start) of the texts that hold any."""
    found = written(windows_of(items, window), "windows")
    part = F.least(F.col("size"), F.lit(shingle))
    shingles = found.dropDuplicates(["win"]).select("win", "size", part.alias("part"), F.posexplode(
        pieces(F.col("words"), part, lambda i: F.xxhash64(F.slice("words", i + 1, part)))).alias("offset", "shingle"))
    shingles = written(shingles, "window-shingles")
    parts = [r.part for r in shingles.select("part").distinct().collect()]      # at most ``shingle`` numbers
    maybe = term_filter(shingles.select(F.col("shingle").alias("term")), SHINGLE_FILTER)

    texts = docs.select(text_key(F.col("text")).alias("key"), item_words(F.col("text")).alias("words"))
    rows = texts.select("key", "words", F.size("words").alias("n"))

    def placed(size: int) -> Column:
        return pieces(F.col("words"), F.lit(size), lambda i: F.struct(
            i.alias("at"), F.xxhash64(F.slice("words", i + 1, size)).alias("shingle")))

    every = F.concat(F.array().cast("array<struct<at:int,shingle:bigint>>"), *map(placed, parts))
    hits = rows.select("key", "n", F.explode(every).alias("x")).where(may_be(maybe, F.col("x.shingle"), SHINGLE_FILTER))
    hits = hits.select("key", "n", "x.at", "x.shingle").distinct()
    hits = written(hits.join(shingles.select("shingle").distinct(), "shingle", "left_semi"), "shingle-hits")

    often = hits.groupBy("shingle").agg(F.count("*").alias("often"))
    rarity = F.struct(F.coalesce("often", F.lit(0)).alias("often"), "shingle", "offset")
    prefix = (shingles.join(often, "shingle", "left").groupBy("win", "size").agg(F.min(rarity).alias("r"))
              .where("r.often > 0").select("win", "size", "r.shingle", "r.offset"))
    start = F.col("at") - F.col("offset")
    spots = (hits.join(prefix, "shingle").where((start >= 0) & (start + F.col("size") <= F.col("n")))
             .groupBy("key").agg(F.sort_array(F.collect_set(F.struct(start.alias("start"), "size", "win"))).alias("spots")))
    spots = written(spots, "spots")

    holders = term_filter(spots.select(F.col("key").alias("term")))
    held = (docs.select(text_key(F.col("text")).alias("key"), "text").where(may_be(holders, F.col("key")))
            .groupBy("key").agg(F.first("text").alias("text")))
    held = held.join(spots, "key").select("key", "spots", item_words(F.col("text")).alias("words"))
    same = F.filter("spots", lambda s: joined(F.col("words"), s["start"], s["size"]) == s["win"])
    same = F.when(F.size("words") > 0, same)        # a second use of the words: else each spot would split the text anew,
    return written(held.select("key", same.alias("spots")), "verified").where("size(spots) > 0")    # as a pushed filter would


def covered(spots: Column) -> Column:
    """Words in any of the spots, which are sorted by start."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(s, x):
        end = x["start"] + x["size"]
        more = F.greatest(end - F.greatest(x["start"], s["end"]), F.lit(0))
        return F.struct(F.greatest(end, s["end"]).alias("end"), (s["n"] + more).alias("n"))

    return F.aggregate(spots, state, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (ids, sorted) of every row of ``docs``."""
    found = contaminated_texts(docs, items, window, shingle)
    which = found.select("key", F.explode(F.array_distinct(F.transform("spots", lambda s: s["win"]))).alias("win"))
    holders = windows_of(items, window).select("win", "item").where("item IS NOT NULL").distinct()
    ids = which.join(holders, "win").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    judged = found.select("key", covered(F.col("spots")).alias("n_hit")).join(ids, "key", "left")
    judged = written(judged, "judged").withColumnRenamed("key", "of")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    rows = rows.join(judged, F.col("key") == F.col("of"), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
                       F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), listed.alias("items"))


#: The query's whole result in SQL.
ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_starts AS (SELECT item, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i + 1:i + 10], ' ') AS win FROM item_starts),
doc_starts AS (
  SELECT row_no, w, size, unnest(range(0, len(w) - size + 1)) AS i
  FROM docs JOIN (SELECT DISTINCT size FROM windows) ON len(w) >= size),
spots AS (
  SELECT s.row_no, s.i, s.size, v.item
  FROM (SELECT row_no, i, size, array_to_string(w[i + 1:i + size], ' ') AS win FROM doc_starts) s
  JOIN windows v ON v.win = s.win AND v.size = s.size),
hit AS (
  SELECT row_no, count(DISTINCT at_word) AS n_hit FROM (SELECT row_no, unnest(range(i, i + size)) AS at_word FROM spots) GROUP BY row_no),
held AS (
  SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT row_no, item FROM spots WHERE item IS NOT NULL) GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit ON docs.row_no = hit.row_no LEFT JOIN held ON docs.row_no = held.row_no
"""
