"""Operator 5, near-duplicates by DartMinHash signatures and banded joining.

A text is the bag of its five-word shingles. Shingle x with weight w owns the region of height w
over a time axis; hashed darts hit regions as a Poisson process that depends only on x and the unit
of height, so two texts share every dart that hits both. Each dart names one of ``coordinates``
signature places, and the earliest dart of a place is its value: two texts agree on a place with
the probability of their weighted Jaccard similarity. All first darts of a text are tested at
once, only the few that fall before the expected filling time are followed further.

Equal texts are one node. Bands of the signature are joined; in each band bucket every node is
compared with one centre, not with every other node (``graph.links_within_buckets``). Links are verified on
the exact weighted Jaccard similarity. Nodes that the rounds of centres leave in different components meet in
blocks of a bucket, where longer signatures of one byte a place tell which pairs may reach the
similarity (SKETCH places, 4 standard deviations off: 3 such pairs in 10**5 are missed); only those are verified,
inside the block, and those that are connected already are not.

Words are runs of anything but white space (U+0020, U+0009..D), as they are written. Fewer than five words
are one shingle. A text without words, or null, has no shingles: it is alone in its class, except
that equal non-null texts always share one. Rows that repeat doc_id and text are the same document.
Ties need no rule: a class is named by its smallest doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshlane.llm.common import arrow_map, packed_rows, text_key, unpacked, written
from freshlane.llm.graph import connected_components, links_within_buckets
from freshlane.llm.private import may_be, term_filter
from freshlane.llm.tokens import slices

SHINGLE, SIMILARITY = 5, 0.8
#: 26 bands of 5 places miss a pair at similarity 0.8 with probability 0.67 ** 26 = 3e-5.
BANDS, ROWS = 26, 5
SKETCH, BLOCK = 1536, 256
#: Characters of a block; a longer text is a block by itself.
BLOCK_CHARS = 4_000_000
MAX_REMEMBERED = 500_000

_U = np.uint64
_FACTORS = [_U(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                            0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash
        if len(self) >= MAX_REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def cells(text: str | None, known: WordHashes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the unit cells of a text: its c-th copy of a shingle is cell (shingle, c), so
    the Jaccard index of two cell sets is the weighted Jaccard similarity of the shingle bags."""
    text = text or ""
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(known.__getitem__, words), _U, len(words))
    if len(words) < shingle:
        total = np.array([len(words)], _U)
        for i in range(len(h)):
            total = mix(total * _FACTORS[0] ^ h[i:i + 1])
        return total
    s = np.zeros(len(words) - shingle + 1, _U)
    for i in range(shingle):
        s = s * _FACTORS[0] + h[i:len(h) - shingle + 1 + i] * (_FACTORS[i % 5] + _U(2 * (i // 5)))
    s = np.sort(mix(s))
    at = np.arange(len(s))
    copy = at - np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], at, 0))
    return np.sort(mix(s + copy.astype(_U) * _FACTORS[1]))


def dart_signature(cell: np.ndarray, coordinates: int) -> np.ndarray:
    """Earliest dart of each coordinate, for a non-empty set of unit cells."""
    horizon = (coordinates * np.log(coordinates) + 2 * coordinates) / len(cell)
    while True:
        darts, times = [], []
        alive, now, nth = cell, np.zeros(len(cell)), 0
        rounds = max(1, int(1.5 * horizon))         # most cells are done then; the loop follows the others
        while len(alive):
            h = mix(alive[:, None] + np.arange(nth + 1, nth + rounds + 1, dtype=_U) * _FACTORS[2])
            gaps = -np.log1p(-(h >> _U(11)).astype(np.float64) * 2.0 ** -53)      # exponential
            at = now[:, None] + np.cumsum(gaps, axis=1)
            early = at < horizon
            darts.append(h[early])
            times.append(at[early])
            more = early[:, -1]
            alive, now, nth, rounds = alive[more], at[more, -1], nth + rounds, 1
        darts, times = mix(np.concatenate(darts) ^ _FACTORS[3]), np.concatenate(times)
        place = (darts >> _U(32)) % _U(coordinates)
        order = np.argsort((place << _U(53)) | (times.view(_U) >> _U(11)))       # by place, then time
        place = place[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        if len(first) == coordinates:
            return darts[order[first]]
        horizon *= 2


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = signature.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=_U) * _FACTORS[4]
    for i in range(rows):
        key = mix(key * _FACTORS[0] ^ s[:, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, node (text key), keys (array<long>: one per band, empty without words)."""
    def run(batches):
        known = WordHashes()
        for whole in batches:
            for b in slices(whole):
                keys = []
                for text in b.column("text").to_pylist():
                    c = cells(text, known, shingle)
                    keys.append(band_keys(dart_signature(c, bands * rows), bands, rows) if len(c) else [])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("node"), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "node", "keys"])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("node"), "text")
    return arrow_map(rows_, run, "doc_id long, node binary, keys array<long>")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the distinct ``nodes``; a filter of fixed size spares most other texts the shuffle."""
    maybe = term_filter(nodes.select(F.col("node").alias("term")))
    return (docs.where(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("node"), "text")
            .where(may_be(maybe, F.col("node"))).join(nodes, "node", "left_semi").dropDuplicates(["node"]))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The rows of ``pairs`` (a, b: text keys) whose texts (node, text) are at least ``similarity`` alike, with it."""
    joined = (pairs.select("a", "b")
              .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text")), "a")
              .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))

    def run(batches):
        known = WordHashes()
        for whole in batches:
            for b in slices(whole):
                sims, last, last_cells = [], None, None
                for ta, tb in zip(b.column("text").to_pylist(), b.column("text_b").to_pylist()):
                    if tb != last:
                        last, last_cells = tb, cells(tb, known, shingle)
                    ca = cells(ta, known, shingle)
                    both = len(np.intersect1d(ca, last_cells, assume_unique=True))
                    union = len(ca) + len(last_cells) - both
                    sims.append(both / union if union else 0.0)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sims, pa.float64())],
                                                 names=["a", "b", "similarity"])

    return arrow_map(joined, run, "a binary, b binary, similarity double").where(F.col("similarity") >= similarity)


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """node, sketch: one byte of each of SKETCH signature places."""
    def run(batches):
        known = WordHashes()
        for whole in batches:
            for b in slices(whole):
                places = [(dart_signature(cells(t, known, shingle), SKETCH) & _U(255)).astype(np.uint8).tobytes()
                          for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(places, pa.binary())], names=["node", "sketch"])

    return arrow_map(texts.select("node", "text"), run, "node binary, sketch binary")


def links_by_sketch(rest: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links (a, b) that join the components of ``rest`` (key, node, root) which links inside a key join.

    A bucket is cut into blocks of about BLOCK nodes, or BLOCK_CHARS characters, by a hash; each two blocks meet in one
    group of bounded size. There the pairs whose sketches agree enough are verified on their texts, unless they are
    connected already, so that a group puts out fewer links than it has nodes.
    """
    least = similarity - 4 * np.sqrt(similarity * (1 - similarity) / SKETCH)
    long = texts.join(rest.select("node").distinct(), "node", "left_semi")
    sketched = written(sketches(long, shingle).join(long, "node"), "sketches")
    rows = rest.select("key", "node", "root").join(sketched, "node")
    sizes = rows.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("text")) / BLOCK_CHARS)).cast("int").alias("n"))
    rows = (rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "root", "sketch", "text"))
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def groups(batches):
        held, at = [], None
        for whole in batches:
            for b in slices(whole):
                for r in zip(*[b.column(c).to_pylist() for c in ("key", "lo", "hi", "own", "node", "root", "sketch", "text")]):
                    if r[:3] != at and held:
                        yield held
                        held = []
                    at = r[:3]
                    held.append(r)
        if held:
            yield held

    def joined(rows, known):
        """The links of one group, a spanning forest over its components."""
        lo, hi, own = rows[0][1], rows[0][2], np.array([r[3] for r in rows])
        places = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), -1)
        parent = {r[5]: r[5] for r in rows}

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, r in enumerate(rows[:-1]):
            near = (places[i + 1:] == places[i]).mean(axis=1) >= least
            if lo != hi:
                near &= own[i + 1:] != own[i]
            mine = None
            for j in i + 1 + np.flatnonzero(near):
                if top(r[5]) != top(rows[j][5]):
                    mine = cells(r[7], known, shingle) if mine is None else mine
                    theirs = cells(rows[j][7], known, shingle)
                    both = len(np.intersect1d(mine, theirs, assume_unique=True))
                    if both and both / (len(mine) + len(theirs) - both) >= similarity:
                        parent[top(r[5])] = top(rows[j][5])
                        yield tuple(sorted((r[4], rows[j][4])))

    def run(batches):
        known = WordHashes()
        for rows in groups(batches):
            found = list(joined(rows, known))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return arrow_map(rows, run, "a binary, b binary").distinct()


def bucket_methods(docs: DataFrame, similarity: float, shingle: int):
    """What ``links_within_buckets`` needs: verification on texts, and the search among unsettled nodes."""
    def methods(members):
        texts = written(texts_of(docs, members.select("node").distinct()), "candidate-texts")
        return (lambda pairs: verified(pairs, texts, similarity, shingle).select("a", "b"),
                lambda rest: links_by_sketch(rest, texts, similarity, shingle))

    return methods


def classes(docs: DataFrame, similarity: float, shingle: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, node of every row (written), and root, node, class_id, class_size of every text."""
    signed = written(signatures(docs, bands, rows, shingle), "signatures")
    nodes = signed.where("size(keys) > 0").select("node", "keys").dropDuplicates(["node"])
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    links = links_within_buckets(buckets, bucket_methods(docs, similarity, shingle))
    roots = connected_components(links)
    of_node = (signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
               .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    found = of_node.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    return signed, of_node.join(found, "root").select("root", "node", "class_id", "class_size")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), class_size, kept (doc_id is class_id) per row."""
    signed, named = classes(docs, similarity, shingle, bands, rows)
    return (signed.join(named.drop("root"), "node", "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                    F.coalesce("class_size", F.lit(1)).alias("class_size"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id"))))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE,
                         bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of ``docs``, all columns, of every class: that of the smallest doc_id (null last), then text key.

    Rows are told apart by doc_id and text, so a text is never lost with another one of the same doc_id; of rows that
    repeat both, one stays. Null texts are classes of their own.
    """
    signed, named = classes(docs, similarity, shingle, bands, rows)
    each = signed.groupBy("doc_id", "node").agg(F.count("*").alias("n")).join(named.select("node", "root"), "node", "left")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    first = each.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("first"))
    each = written(each.join(first, "root", "left").withColumn("stays", F.col("first").isNull() | order.eqNullSafe(F.col("first"))), "decided")
    left = packed_rows(docs).withColumn("__node", text_key(F.col("text")))

    def of(decided):
        return decided.select(F.col("doc_id").alias("__id"), F.col("node").alias("__of"))

    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__node").eqNullSafe(F.col("__of"))
    left = left.join(of(each.where("NOT stays")), same, "left_anti")
    again = of(each.where("stays AND n > 1"))
    if not again.isEmpty():
        one = left.join(again, same, "left_semi").groupBy("doc_id", "__node").agg(F.first("__row").alias("__row"))
        left = left.join(again, same, "left_anti").select("__row").unionByName(one.select("__row"))
    return unpacked(left, docs.columns)
