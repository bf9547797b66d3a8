"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import pytest

from freshlane.llm import langid, line_dedup, mixing, near_dup, packing, private, quality, secrets, tokens, winnow

LONG = "alpha beta gamma delta " * 6000 + "\n" + "x" * 40000 + "\n" + "9" * 3000 + " a@b.co"
ROWS = [
    (1, "one two three four five six\nseven", "en", "s"), (1, "one two three four five six\nseven", "en", "s"),
    (2, "", "en", "s"), (3, None, "de", "s"), (None, "one two three four five six", None, None),
    (4, LONG, "en", None), (5, " \t\n\n", "fr", "s"), (5, "another text with the same id here", "fr", "s"),
    (6, "é" * 10 + " 😀 ß <|endoftext|> | || password=e3b3ed3cc8548923d6 1.2.3.4 a@b.co", "de", "s"), (7, "a", "en", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ["node", "key", "kept", "bucket", "removed", "copies", "w", "line", "value", "n_chars", "score", "__copies", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", *[f"cast(7 AS int) AS `{c}`" for c in CLASH]).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 0, 0), (7, 1, 1), (None, 1, 0), (4, None, None)],
                                 "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": lambda d, t: quality.judged(d, t), "private": lambda d, t: private.span_digest(d),
    "lines": lambda d, t: line_dedup.line_digest(d), "winnow": lambda d, t: winnow.fingerprint_digest(d),
    "near": lambda d, t: near_dup.near_duplicates(d), "lang": lambda d, t: langid.identify_held_out(d),
    "mixing": lambda d, t: mixing.mixing_rates(d, mixing.label_domains(t)), "tokens": lambda d, t: tokens.token_counts(d),
}
STAGES = {
    "quality": lambda d, t: quality.keep_good(d, t), "lines": lambda d, t: line_dedup.without_repeated_lines(d),
    "near": lambda d, t: near_dup.drop_near_duplicates(d), "mixing": lambda d, t: mixing.mixed(d, mixing.label_domains(t)),
    "redacted": lambda d, t: secrets.redacted(d, secrets.scan(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(name, docs, labels):
    found = [tuple(r) for r in OPERATORS[name](docs, labels).collect()]
    assert len(found) == len(ROWS)
    same = [r for r in found if r[0] == 1]      # repeated rows get the same verdict
    assert len(same) == 2 and same[0] == same[1]


@pytest.mark.parametrize("name", [*OPERATORS, "packing", "secrets"])
def test_empty_table(name, docs, labels):
    run = OPERATORS | {"packing": lambda d, t: packing.pack_documents(d), "secrets": lambda d, t: secrets.scan(d)}
    assert run[name](docs.limit(0), labels.limit(0)).count() == 0
    if name in ("quality", "mixing"):           # no labels at all
        assert run[name](docs, labels.limit(0)).count() == len(ROWS)


@pytest.mark.parametrize("name", STAGES)
def test_stage_keeps_columns(name, docs, labels):
    out = STAGES[name](docs, labels)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert out.count() <= len(ROWS)
    assert STAGES[name](docs.limit(0), labels.limit(0)).count() == 0


def test_edge_verdicts(docs, labels):
    near = {(r.doc_id, r.class_id) for r in near_dup.near_duplicates(docs).collect()}
    assert (3, 3) in near and (2, 2) in near and (1, 1) in near
    lang = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_held_out(docs).collect()}
    assert lang[2] == lang[3] == ("und", 0.0)
    packed = packing.pack_documents(docs).toPandas()
    assert packed[packed.doc_id == 3].length.tolist() == [1] and packed[packed.doc_id == 2].doc_tokens.tolist() == [1]
    digest = {r.doc_id: r for r in private.span_digest(docs).collect()}
    assert digest[4].n_email == 1 and digest[6].n_ip == 1 and digest[3].spans == ""
    lines = {r.doc_id: r.removed for r in line_dedup.line_digest(docs).collect()}
    assert lines[None] == "" and lines[1] == "0"        # the null id comes first and stays
    secret = secrets.scan(docs).where("secret").collect()
    assert [(r.doc_id, r.value) for r in secret] == [(6, "e3b3ed3cc8548923d6")]


def test_text_columns_only(spark):
    """Texts equal but for the id, and ties of length."""
    rows = spark.createDataFrame([(i, "same words in each of these texts") for i in range(40)], "doc_id long, text string")
    near = near_dup.near_duplicates(rows).collect()
    assert {r.class_id for r in near} == {0} and {r.class_size for r in near} == {40}
    packed = packing.pack_documents(rows, room=16).toPandas()
    sums = packed.groupby("sequence_id").length.sum()
    assert sums.max() <= 16 and packed.length.sum() == 40 * packed.doc_tokens.iloc[0]


def test_stages_act_by_row(spark):
    """Texts that share a doc_id are told apart; repeated rows and null ids are deduplicated."""
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a), (5, a), (5, b), (7, "x y z u v w"), (7, "x y z u v w"), (None, a), (3, None), (3, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node")
    left = sorted(((r.doc_id, r.text) for r in near_dup.drop_near_duplicates(docs).collect()), key=str)
    assert left == sorted([(1, a), (5, b), (7, "x y z u v w"), (3, None), (4, None)], key=str)
    lines = spark.createDataFrame([(1, f"{a}\nhead"), (5, f"{a}\ntail"), (5, f"{b}\nother")], "doc_id long, text string")
    cut = {r.text for r in line_dedup.without_repeated_lines(lines).collect()}
    assert cut == {f"{a}\nhead", "tail", f"{b}\nother"}
    digest = sorted((r.doc_id, r.removed) for r in line_dedup.line_digest(lines).collect())
    assert digest == [(1, ""), (5, ""), (5, "0")]
