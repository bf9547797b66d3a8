"""Personal data in texts with very many spans: same spans and contexts as plain Python, in near-linear time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from freshlane.llm import private

KIND = "array<struct<start:int,k:int,end:int,kind:string,value:string>>"


def _texts():
    rng = random.Random(4)
    parts = ["a.b@c.de", "10.0.0.1", "+49 30 1234567890", "4111 1111 1111 1111", "Grüße", "name", "\U0001F600", "x-y", ",", "  "]
    yield from ("", "nothing here", "a@b.c", "a@b.c a@b.c", "é a@b.c")
    for n in (3, 15, 16, 17, 33, 200, 1500):
        yield " ".join(rng.choice(parts) for _ in range(n))
    yield "".join("q@r.st " for _ in range(700))


def test_positions_by_blocks(spark):
    texts = list(_texts())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for pattern in (r"[a-z]+@[a-z.]+", r"[0-9]+", "zzz"):
        got = df.select("doc_id", private.matches(F.col("text"), F.lit(pattern), "kind", 3).alias("s")).collect()
        for r in got:
            assert [(s.start, s.k, s.end, s.kind, s.value) for s in r.s] == [
                (m.start(), 3, m.end(), "kind", m.group()) for m in re.finditer(pattern, texts[r.doc_id])]


@pytest.mark.parametrize("segment", [7, 50, 16_384])
def test_masks_and_surroundings_by_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(private, "SEGMENT", segment)
    texts = [t[:3000] for t in _texts()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("spans", private.base_spans(F.col("text")))
    df = df.where(F.size("spans") > 0)
    around = private.surroundings(private.masked(F.col("text"), F.col("spans")), F.col("spans"), 9)
    rows = df.select("doc_id", "spans", private.masked(F.col("text"), F.col("spans")).alias("masked"), around.alias("around")).collect()
    assert len(rows) >= 8
    for r in rows:
        plain = list(texts[r.doc_id])
        for s in r.spans:
            plain[s.start:s.end] = " " * (s.end - s.start)
        plain = "".join(plain)
        assert r.masked == plain
        assert [(x.kind, x.start, x.value, x.left, x.right) for x in r.around] == [
            (s.kind, s.start, s.value, plain[max(0, s.start - 9):s.start], plain[s.end:s.end + 9]) for s in r.spans]


def test_a_hundred_thousand_spans_in_one_text(spark):
    n = 100_000
    df = spark.createDataFrame([(1, "ab@c.de " * n)], "doc_id int, text string")
    start = time.time()
    got = df.select(private.base_spans(F.col("text")).alias("s")).select(
        F.size("s").alias("n"), F.col("s")[n - 1]["start"].alias("last")).first()
    spans = time.time() - start
    spotted = df.withColumn("spans", private.base_spans(F.col("text"))).select("text", "spans")
    contexts = private.context_terms(spotted, 64).count()
    print(f"spans {spans:.1f} s, contexts {time.time() - start - spans:.1f} s")
    assert (got.n, got.last, contexts) == (n, 8 * (n - 1), 0)      # near an address there are only blanked addresses
    assert time.time() - start < 120
