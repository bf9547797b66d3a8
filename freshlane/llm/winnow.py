"""Operator 4, winnowing document fingerprints.

Every run of ``gram`` code points gets a rolling hash; of each ``window`` consecutive hashes the
smallest is kept, the rightmost of equal ones, with its position. Any passage of at least
``gram + window - 1`` code points that two texts share gives both the same kept hash, and any match
is at least ``gram`` long. A text shorter than a window keeps its smallest hash, one shorter than a
gram the hash of all it has, an empty or null one nothing. Likeness is the Jaccard index of kept
hashes; two empty fingerprints are alike (1), an empty and another are not (0).

The digest query needs each document's successor by descending doc_id. Texts are dealt into ranges
of doc_id once; the first document of each range is also dealt to the range before it, so every
successor is met inside one task, and only one row per range (never a text) visits the driver.
Null ids come last; repeated ids are ordered by text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshlane.llm.common import arrow_map
from freshlane.llm.tokens import slices

GRAM, WINDOW = 16, 64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_U = np.uint64


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(n: int, base: np.uint64, cache: dict = {}) -> np.ndarray:
    known = cache.get(int(base))
    if known is None or len(known) < n:
        size = max(1024, 1 << int(n).bit_length())
        known = cache[int(base)] = np.concatenate([[_U(1)], np.cumprod(np.full(size, base, _U))])
        while len(cache) > 2:
            cache.pop(next(iter(cache)))
    return known[:n]


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hashes of all runs of ``gram`` code points (of the whole text if it is shorter):
    polynomial prefix sums modulo 2**64, so each next hash costs a fixed few operations."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.uint64)
    gram = min(gram, n)
    sums = np.concatenate([[_U(0)], np.cumsum((points.astype(_U) + _U(1)) * _powers(n, _BASE))])
    h = (sums[gram:] - sums[:-gram]) * _powers(n - gram + 1, _BASE_INVERSE)
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    return h >> _U(32)


def winnow(text: str | None, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their positions, by position."""
    h = gram_hashes(code_points(text or ""), gram)
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    # hash above, reversed position below: the smallest key is the rightmost smallest hash
    key = (h << _U(32)) | (_U(0xFFFFFFFF) - np.arange(n, dtype=_U))
    if n > window:
        full = np.full(-(-n // window) * window, _U(0xFFFFFFFFFFFFFFFF))
        full[:n] = key
        blocks = full.reshape(-1, window)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n - window + 1], ahead[window - 1:n])
        least = least[np.r_[True, least[1:] != least[:-1]]]
    else:
        least = key.min(keepdims=True)
    return (least >> _U(32)).astype(np.uint32), (_U(0xFFFFFFFF) - (least & _U(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sets of kept hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_string(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A digest that equal fingerprints share: number of kept hashes and the SHA-256 of hash:position."""
    body = np.stack([hashes.astype("<u8"), positions.astype("<u8")], axis=1).tobytes()
    return f"{len(hashes)}-{hashlib.sha256(body).hexdigest()}"


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes (array<long>), positions (array<long>) of every row of ``docs`` (doc_id, text)."""
    def run(batches):
        for whole in batches:
            for b in slices(whole):
                kept = [winnow(t, gram, window) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([h.astype(np.int64) for h, _ in kept], pa.list_(pa.int64())),
                     pa.array([p for _, p in kept], pa.list_(pa.int64()))],
                    names=["doc_id", "hashes", "positions"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, hashes array<long>, positions array<long>")


DIGEST_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                 "edited_fingerprint string, near_edited double, near_next double")


def fingerprint_digest(docs: DataFrame, ranges: int | None = None, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """DIGEST_SCHEMA for every row: its fingerprint, that of its text with the last half replaced from
    the next document by descending doc_id (after the last: the first), and both likenesses."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 1000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)      # range i ends where doc_id < cuts[i]; bounded by ``ranges``
    cut_list = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    bucket = (F.when(F.col("doc_id").isNull(), F.lit(len(cuts)))
              .otherwise(F.size(F.filter(cut_list, lambda c: c > F.col("doc_id"))))).cast("int")
    placed = docs.withColumn("bucket", bucket)
    first = sorted(tuple(r) for r in placed.groupBy("bucket").agg(F.max("doc_id")).collect())
    seams = [(first[i][0], first[(i + 1) % len(first)][1], first[(i + 1) % len(first)][0]) for i in range(len(first))]
    follow = spark.createDataFrame(seams, "to_bucket int, doc_id long, from_bucket int")
    extra = (placed.alias("d").join(F.broadcast(follow.alias("f")),   # one row per range
                                    F.expr("d.bucket = f.from_bucket AND d.doc_id <=> f.doc_id"))
             .select("d.doc_id", "d.text", F.col("f.to_bucket").alias("bucket"), F.lit(1).alias("extra")))
    dealt = (placed.select("doc_id", "text", "bucket", F.lit(0).alias("extra")).unionByName(extra)
             .repartitionByRange(max(1, len(first)), "bucket")
             .sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "text"))

    def run(batches):
        last = None         # (bucket, doc_id, text, hashes, positions) that waits for its successor
        for whole in batches:
            for b in slices(whole):
                out = []
                cols = [b.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text")]
                for at, extra_row, doc, text in zip(*cols):
                    if extra_row and last is None:
                        continue        # a further row of a repeated id
                    kept = winnow(text, gram, window)
                    if last is not None:
                        out.append(digest(last, text, kept))
                    last = None if extra_row else (at, doc, text, kept)
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=NAMES)

    def digest(last, next_text, next_kept):
        _, doc, text, (hashes, positions) = last
        half = len(text) // 2
        edited = text[:len(text) - half] + next_text[:half]
        e_hashes, e_positions = winnow(edited, gram, window)
        return (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_string(hashes, positions),
                as_string(e_hashes, e_positions), likeness(hashes, e_hashes), likeness(hashes, next_kept[0]))

    return arrow_map(dealt, run, DIGEST_SCHEMA)


NAMES = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
