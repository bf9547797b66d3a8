"""Operators 11 to 13: against plain Python (11) and the registered SQL (12, 13), on whole small tables and odd rows."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from freshlane.llm import align, decontaminate, divergence, queries
from freshlane.llm.common import tokenizer_path

SF, BIGGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


def sql(name, **tables):
    c = duckdb.connect()
    for table, rows in tables.items():
        c.register(table, rows) if isinstance(rows, pa.Table) else c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{rows}'")
    return in_order(c.sql(queries.oracle_sql()[name]).fetchall())


# ---- 11
ODD = [(-1, None), (-2, ""), (-3, "a▁ b"), (None, "x y"), (-5, "<|endoftext|> <s> a  b \n c"), (-5, "<|endoftext|> <s> a  b \n c"),
       (-6, "é\U0001f600 ßß" * 50), (-7, " "), (-8, "word " * 20000 + "z" * 5000)]


def by_hand(docs):
    """What the contract says, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    from freshlane.llm.tokens import byte_letters
    letters = byte_letters()
    bytes_a = {i: bytes(letters.get(c, 63) for c in s) for s, i in a.get_vocab().items()}
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
               for i in range(b.get_piece_size())]
    rows = []
    for doc, text in docs:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        tokens = [[(i, t[i]) for i in x] for x, t in zip(ids, (bytes_a, bytes_b))]
        if not text or any(b"".join(s for _, s in t) != (" " + text).encode() for t in tokens):
            rows.append((doc, 0, 0, 0, [], ""))
            continue
        links, groups, group, k, ends = [], [], ([], []), [0, 0], [0, 0]
        while k[0] < len(tokens[0]) or k[1] < len(tokens[1]):
            side = 0 if ends[0] <= ends[1] and k[0] < len(tokens[0]) else 1      # the token that starts first
            if ends[0] == ends[1] and group[0]:
                groups.append(group)
                group = ([], [])
            i, s = tokens[side][k[side]]
            group[side].append(i)
            if ends[0] != ends[1]:          # the other side's last token goes on under it
                links.append((group[0][-1], group[1][-1]))
            elif side == 0:                 # both start here
                other = tokens[1][k[1]]
                group[1].append(other[0])
                k[1] += 1
                ends[1] += len(other[1])
                links.append((i, other[0]))
            k[side] += 1
            ends[side] += len(s)
        groups.append(group)
        text = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        rows.append((doc, len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(text.encode()).hexdigest()))
    count, highest = Counter(x for r in rows for x in r[4]), Counter()
    for (_, y), n in count.items():
        highest[y] = max(highest[y], n)
    return in_order((*r[:4], len(r[4]), sum(count[x] == highest[x[1]] for x in r[4]), sum(count[x] for x in r[4]), r[5]) for r in rows)


def test_alignment(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = by_hand(rows)
    assert in_order(queries.queries()["op11_token_alignment"](spark, SF).collect()) == want


@pytest.mark.parametrize("block", [300, 10 ** 9])
def test_alignment_odd_texts(spark, block):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS units", "3 AS of")
    found = align.aligned(docs.coalesce(2), block_chars=block)
    want = by_hand(ODD)
    assert in_order(found.drop("groups").collect()) == want
    for r in found.collect():       # the digest is that of the groups
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") and (r.n_a > 0 or r.groups == "")
    assert align.aligned(docs.limit(0)).count() == 0


def test_pointer_jumping():
    a, b = align.terminals(np.array([3, 5, 9, 12]), np.array([1, 4, 9, 10, 11, 12]))
    assert a.tolist() == [2, 2, 2, 5] and b.tolist() == [2, 2, 2, 5, 5, 5]
    n = 3000       # one chain
    a, b = align.terminals(np.r_[np.arange(1, n) * 2 + 1, 2 * n + 2], np.r_[np.arange(1, n) * 2 + 2, 2 * n + 2])
    assert set(a) == set(b) == {n - 1} or len(set(a)) == len(set(b))


# ---- 12
TALE = "a b c d e f g h i j k l m"
TEXTS = [(1, "A  b-c d e f g h i j"), (1, "A  b-c d e f g h i j"), (2, None), (3, ""), (None, TALE + " " + TALE), (4, "zz YY é1"),
         (5, "x " * 14), (6, "one"), (7, "l m a b c d e f g h i j k l"), (8, "q zz yy é1 one zz"), (9, "x " * 9000 + "zz yy é1")]
ITEMS = [(1, TALE), (1, "other words here"), (None, "x " * 11), (10, "one"), (2, "ZZ yy"), (3, "zz yy é1"), (4, None), (5, ""), (6, TALE),
         (7, "e f g h i j")]


def table(rows, name):
    return pa.table({name: pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows])})


@pytest.mark.parametrize("folder", [SF, BIGGER])
def test_decontamination(spark, folder):
    want = sql("op12_decontamination", documents=f"{folder}/documents.parquet", benchmark=f"{folder}/benchmark.parquet")
    assert in_order(queries.queries()["op12_decontamination"](spark, folder).collect()) == want
    assert any(r[5] for r in want)


@pytest.mark.parametrize("shingle", [5, 2])
def test_decontamination_odd_rows(spark, shingle):
    want = sql("op12_decontamination", documents=table(TEXTS, "doc_id"), benchmark=table(ITEMS, "item_id"))
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS spots", "3 AS words")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS win")
    found = decontaminate.contamination(docs, items, shingle=shingle)
    assert in_order(found.drop("items").collect()) == want
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


# ---- 13
@pytest.mark.parametrize("folder", [SF, BIGGER])
def test_divergence(spark, folder):
    want = sql("op13_source_divergence", documents=f"{folder}/documents.parquet")
    found = queries.queries()["op13_source_divergence"](spark, folder)
    assert in_order(found.collect()) == want


def test_divergence_odd_rows(spark):
    rows = [(None, None, None), ("", "en", "t"), ("ab Ab x", "en", "s"), ("Été 1 AB", None, "s")] + [
        (f"alpha beta{'x' * (i % 3)} gamma " * (i % 5), "de", f"s{i % 4}") for i in range(60)] + [("ab x y z ab", "en", "s")] * 12
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS block", "2 AS p", "3 AS term")
    want = sql("op13_source_divergence", documents=pa.table({c: [r[i] for r in rows] for i, c in enumerate(("text", "lang", "source"))}))
    for block_rows, columns in ((400_000, 1024), (3, 4)):
        assert in_order(divergence.divergence(docs, block_rows=block_rows, columns=columns).collect()) == want
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_joint_tables():
    rng = np.random.default_rng(1)
    levels = rng.integers(0, 4, (200, 3))
    i, j, n, columns = divergence.joint_tables(levels)
    want = Counter((g, h, levels[t, g], levels[t, h]) for t in range(200) for g in range(3) for h in range(g + 1, 3))
    got = {(columns[x] >> 32, columns[y] >> 32, columns[x] & 0xFFFFFFFF, columns[y] & 0xFFFFFFFF): k for x, y, k in zip(i, j, n)}
    assert got == want
