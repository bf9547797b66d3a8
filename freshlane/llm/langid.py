"""Operator 6, multilingual mixture language identification.

Training counts hashed letter trigrams per language over all labelled training documents. A document
is then a mixture of languages: expectation-maximisation finds the proportions that explain its
trigrams best. The language set grows from the best single language, taking in the next most
likely one as long as the log-likelihood rises by more than ``penalty`` times the information
criterion's share for one more parameter; the prediction is the largest proportion of the set.

The model is languages x FEATURES numbers, whatever the corpus holds; the counts that build it are
summed inside each task first. Edge cases: a null text, or one without letters, is ``und`` with
score 0; without any training label every document is; null languages are not learned; a tie goes
to the language that sorts first; repeated rows count again.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshlane.llm.common import arrow_map
from freshlane.llm.tokens import slices

FEATURES = 1 << 14
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(text: str | None) -> np.ndarray:
    """Feature numbers of the lower-case letter trigrams of a text; other characters are breaks."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[c]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    c = np.concatenate([[0], np.where(is_letter, c, 0), [0]]).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
         ^ c[2:] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h[is_letter] >> np.uint64(50)).astype(np.int64)       # 14 bits; the middle one is a letter


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities (FEATURES x languages), from all rows of ``docs``
    (text, lang)."""
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in slices(whole):
                for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                    if lang not in sums:
                        sums[lang] = np.zeros(FEATURES, np.int64)
                    sums[lang] += np.bincount(trigrams(text), minlength=FEATURES)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])],
                                             names=["lang", "feature", "n"])

    counts = (arrow_map(docs.where(F.col("lang").isNotNull()).select("text", "lang"), run, "lang string, feature long, n long")
              .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow())
    languages = sorted(set(counts.column("lang").to_pylist()))
    n = np.zeros((FEATURES, len(languages)))
    n[counts.column("feature").to_numpy(), [languages.index(x) for x in counts.column("lang").to_pylist()]] = \
        counts.column("n").to_numpy()
    return languages, (n + 0.5) / (n.sum(axis=0) + 0.5 * FEATURES)


def proportions(p: np.ndarray, n: np.ndarray, rounds: int = 25, close: float = 1e-3) -> tuple[np.ndarray, float]:
    """EM: mixture weights of the columns of ``p`` for features seen ``n`` times; the log-likelihood."""
    weights = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        mixed = p @ weights
        new = weights * ((n / mixed) @ p) / total
        done = np.abs(new - weights).max() < close
        weights = new
        if done:
            break
    return weights, float(n @ np.log(p @ weights))


def language_set(features: np.ndarray, probabilities: np.ndarray, penalty: float) -> list[tuple[int, float]]:
    """(language, proportion) of the chosen set, largest proportion first."""
    at, n = np.unique(features, return_counts=True)
    p = probabilities[at]
    single = n @ np.log(p)
    chosen = [int(np.argmax(single))]
    best, weights = float(single[chosen[0]]), np.ones(1)
    if p.shape[1] > 1:
        overall, _ = proportions(p, n)
        step = penalty * 0.5 * np.log(n.sum() + 1)
        for k in np.argsort(-overall, kind="stable"):
            if int(k) in chosen:
                continue
            new, value = proportions(p[:, [*chosen, int(k)]], n)
            if value <= best + step:
                break
            chosen, best, weights = [*chosen, int(k)], value, new
    return sorted(zip(chosen, weights.tolist()), key=lambda x: (-x[1], x[0]))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], penalty: float = 4.0) -> DataFrame:
    """Columns of ``docs`` (text among them) but text, and lang_pred, score (its proportion),
    languages (``lang:proportion`` of the set, comma-joined)."""
    languages, probabilities = model
    rest = [f for f in docs.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + \
        ", lang_pred string, score double, languages string"
    names = [f.name for f in rest] + ["lang_pred", "score", "languages"]

    def one(text):
        found = trigrams(text) if languages else ()
        if not len(found):
            return UNKNOWN, 0.0, ""
        chosen = language_set(found, probabilities, penalty)
        return languages[chosen[0][0]], min(1.0, chosen[0][1]), ",".join(f"{languages[k]}:{w:.3f}" for k, w in chosen)

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                lang, score, mix = zip(*[one(t) for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(f.name) for f in rest], pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(mix, pa.string())], names=names)

    return arrow_map(docs, run, schema)


def identify_held_out(docs: DataFrame, penalty: float = 4.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages of every row; learned from the rows whose
    crc32(doc_id) mod 4 is not 2 (a null id counts as the text '')."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    rows = docs.select("doc_id", "text", "lang", (fold == 2).alias("held_out"))
    model = train(rows.where(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), model, penalty)
