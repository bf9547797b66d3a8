"""Operator 2, information-theoretic sanitisation of personal data.

Pattern matches (e-mail, IP, card, phone) are the protected entities. Terms (runs of letters, digits,
``_``, ``'`` and ``-``, lower case) that stand within ``reach`` code points of an entity co-occur with it.
With W terms in the corpus, n_c of them in contexts of entity c, n_t occurrences of term t and n_tc in
contexts of c, t reveals the share PMI(t, c) / IC(c) = ln(n_tc W / (n_t n_c)) / ln(W / n_c) of what c
tells: 1 if t occurs only near c. A term seen in at least ``min_contexts`` different contexts of an entity
is generalised from the share ``generalise`` on and removed from ``remove`` on, wherever it stands.

All counts are over the whole corpus. Texts are scanned for terms with a filter of fixed size (a
bitmap of hashed terms, as a scalar subquery); it only lets rows through that joins then check exactly.
Contexts are linear in entity occurrences: no pairs of entities or of terms are formed.

Edge cases: a null text is empty and has no spans; spans of a kind do not overlap; overlapping spans of
different kinds all count; term spans that touch a base span are dropped; equal contexts (copies) count
as one context; repeated rows are judged alike; documents without spans keep their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshlane.llm.common import written

#: Possessive loops and the look-behind only spare backtracking; they match as the plain patterns do.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
NOT_TERM = r"[^\p{L}\p{N}_'-]+"
REACH, MIN_CONTEXTS, GENERALISE, REMOVE = 64, 2, 0.9, 0.97
#: Words of 64 bits in the term filter.
FILTER_WORDS = 1 << 14
#: Code points of a text that are blanked and looked around in together.
SEGMENT = 16_384

SPAN = "array<struct<start:int,k:int,end:int,kind:string,value:string>>"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: Column, kind: str, k: int) -> Column:
    """Array of (start, k, end, kind, value) of the matches of ``pattern``: what stands between matches
    and the matches themselves have lengths whose running sums are the positions (code points).

    Sums run inside blocks of some (2 n)^(1/3) matches and over the blocks, as growing an array copies it.
    """
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def span(start, end, value):
        return F.struct(start.cast("int").alias("start"), F.lit(k).alias("k"), end.cast("int").alias("end"),
                        F.lit(kind).alias("kind"), value.alias("value"))

    def step(state, x):
        start = state["at"] + F.length(x["gap"])
        end = (start + F.length(x["value"])).cast("int")
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span(start, end, x["value"]))).alias("spans"))

    def before(state, block):
        return F.struct((state["at"] + block["at"]).cast("int").alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

    def placed(pairs):
        n = F.greatest(F.lit(16), F.ceil(F.cbrt(F.size(pairs) * 2.0))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(pairs), n), lambda b: F.aggregate(F.slice(pairs, b, n), first, step))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        moved = let(blocks, lambda bs: F.flatten(F.zip_with(bs, F.aggregate(bs, none, before)["starts"], lambda b, at: F.transform(
            b["spans"], lambda s: span(s["start"] + at, s["end"] + at, s["value"])))))
        return F.when(F.size(pairs) == 0, F.array().cast(SPAN)).otherwise(moved)

    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(values)), values)
    return let(F.transform(pairs, lambda p: F.struct(p["0"].alias("gap"), p["1"].alias("value"))), placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits (at most 19) pass Luhn's check."""
    padded = F.lpad(number, 20, "0")

    def term(total, i):
        d = F.substring(padded, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), term) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind. Cheap tests spare most texts the patterns."""
    none = F.array().cast(SPAN)
    small = lambda v: F.forall(F.split(v, r"\."), lambda p: (
        F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    n = lambda v: F.length(digits(v))
    parts = [
        (text.contains("@"), EMAIL, None),
        (text.rlike(r"[0-9]\.[0-9]"), IP, small),
        (text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), CARD, lambda v: n(v).between(12, 19) & luhn(F.substring(digits(v), 1, 19))),
        (text.contains("+"), PHONE, lambda v: n(v).between(9, 15)),
    ]
    found = []
    for k, (may, pattern, good) in enumerate(parts):
        spans = matches(text, F.lit(pattern), KINDS[k], k)
        if good is not None:
            spans = only(spans, good)
        found.append(F.when(may, spans).otherwise(none))
    return F.array_sort(F.concat(*found))


def only(spans: Column, good) -> Column:
    return F.filter(spans, lambda s: good(s["value"]))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def segments(text: Column) -> Column:
    """First code points (from 0) of the segments of a text."""
    return F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(SEGMENT))


def masked(text: Column, spans: Column) -> Column:
    """The text with base spans blanked, every other character in its place; segment by segment, as every
    blanking copies what it works on."""
    def blanked(a, part, inside):
        def blank(t, s):
            start = F.greatest(s["start"] - a, F.lit(0))
            n = F.least(s["end"] - a, F.lit(SEGMENT)) - start
            return F.overlay(t, F.repeat(F.lit(" "), n), start + 1, n)
        return F.aggregate(inside, part, blank)

    return let(F.struct(text.alias("text"), spans.alias("spans")), lambda x: F.array_join(F.transform(
        segments(x["text"]), lambda a: blanked(a, F.substring(x["text"], a + 1, F.lit(SEGMENT)), F.filter(
            x["spans"], lambda s: (s["start"] < a + SEGMENT) & (s["end"] > a)))), ""))


def surroundings(text: Column, spans: Column, reach: int) -> Column:
    """(kind, start, value, left, right) of every span: up to ``reach`` code points before and after it. They are cut
    from the span's segment of the text, but for the right side of spans that leave it."""
    def of_span(s, a, window, whole):
        off, start = F.greatest(a - reach, F.lit(0)), F.greatest(s["start"] - reach, F.lit(0))
        right = F.when(s["end"] <= a + SEGMENT, F.substring(window, s["end"] - off + 1, F.lit(reach))).otherwise(
            F.substring(whole, s["end"] + 1, F.lit(reach)))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["value"].alias("value"),
                        F.substring(window, start - off + 1, s["start"] - start).alias("left"), right.alias("right"))

    def of_segment(x, a):
        window = F.substring(x["text"], F.greatest(a - reach, F.lit(0)) + 1, F.least(a, F.lit(reach)) + SEGMENT + reach)
        return let(window, lambda w: F.transform(
            F.filter(x["spans"], lambda s: (s["start"] >= a) & (s["start"] < a + SEGMENT)), lambda s: of_span(s, a, w, x["text"])))

    return let(F.struct(text.alias("text"), spans.alias("spans")), lambda x: F.flatten(F.transform(
        segments(x["text"]), lambda a: of_segment(x, a))))


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_TERM), lambda t: t.rlike(r"\p{L}"))


def term_filter(names: DataFrame, size: int = FILTER_WORDS) -> Column:
    """``size`` longs (a power of two) with a bit for the hash of every ``term`` of ``names``, as a scalar subquery."""
    h = F.xxhash64("term")
    bits = (names.select(F.shiftright(h, 6).bitwiseAND(F.lit(size - 1)).cast("int").alias("word"),
                         F.expr("shiftleft(1L, CAST(xxhash64(term) & 63 AS int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    every = names.sparkSession.range(size).select(F.col("id").cast("int").alias("word")).join(bits, "word", "left")
    packed = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("b"))
    return packed.select(F.col("b")["bits"]).scalar()


def may_be(names_filter: Column, term: Column, size: int = FILTER_WORDS) -> Column:
    """Whether the term may be one of the filter's (made with the same size)."""
    h = F.xxhash64(term)
    word = F.get(names_filter, F.shiftright(h, 6).bitwiseAND(F.lit(size - 1)).cast("int"))
    return F.call_function("shiftright", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def context_terms(spotted: DataFrame, reach: int) -> DataFrame:
    """(entity, term, context): one row per term occurrence near an entity of ``spotted`` (text, spans)."""
    s = F.col("s")
    entity = F.concat(s["kind"], F.lit(":"), F.when(s["kind"].isin("card", "phone"), digits(s["value"])).otherwise(F.lower(s["value"])))
    around = surroundings(masked(F.col("text"), F.col("spans")), F.col("spans"), reach)
    rows = spotted.select(F.explode(around).alias("s"))
    left, right = s["left"], s["right"]
    # a term cut by the border of the context does not count
    whole_left = F.when(s["start"] > reach, F.regexp_replace(left, r"^[\p{L}\p{N}_'-]+", "")).otherwise(left)
    whole_right = F.when(F.length(right) == reach, F.regexp_replace(right, r"[\p{L}\p{N}_'-]++$", "")).otherwise(right)
    both = F.concat(whole_left, F.lit(" "), whole_right)
    return (rows.select(entity.alias("entity"), both.alias("both"))
            .select("entity", F.xxhash64("both").alias("context"), F.explode(terms(F.col("both"))).alias("term")))


def disclosing_terms(docs: DataFrame, spotted: DataFrame, reach: int = REACH, min_contexts: int = MIN_CONTEXTS,
                     generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(term, share, action): terms of ``docs`` (text) that reveal an entity of ``spotted``."""
    near = written(context_terms(spotted, reach), "contexts")
    of_entity = near.groupBy("entity").agg(F.count("*").alias("n_c"))
    once = near.groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = (once.groupBy("entity", "term").agg(F.sum("n").alias("n_tc"), F.count("*").alias("contexts"))
             .where(F.col("contexts") >= min_contexts))
    pairs = written(pairs.join(of_entity, "entity"), "pairs")
    maybe = term_filter(pairs.select("term").distinct())
    every = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term"))
    counts = written(every.groupBy(F.when(may_be(maybe, F.col("term")), F.col("term")).alias("term"))
                     .agg(F.count("*").alias("n_t")), "terms")
    total = counts.agg(F.sum("n_t").cast("double")).scalar()
    share = F.try_divide(F.ln(F.col("n_tc") * total / (F.col("n_t") * F.col("n_c"))), F.ln(total / F.col("n_c")))
    return (pairs.join(counts, "term").withColumn("share", share).groupBy("term").agg(F.max("share").alias("share"))
            .where(F.col("share") >= generalise)
            .withColumn("action", F.when(F.col("share") >= remove, "remove").otherwise("generalise")))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text) with spans (all, by start and kind), base (the pattern matches only) and
    clean_text: base spans become ``[KIND]``, terms ``[TERM]`` or nothing."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.withColumn("spans", base_spans(F.col("text")))
    spotted = written(found.where(F.size("spans") > 0).select("text", "spans"), "spotted")
    names = written(disclosing_terms(docs, spotted, **options), "disclosing")
    maybe = term_filter(names)
    hits = (docs.select("doc_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
            .where(may_be(maybe, F.col("term"))).join(names, "term")
            .groupBy("doc_id").agg(F.collect_set(F.struct("term", "action")).alias("terms")))     # terms of one document
    hits = hits.select(F.col("doc_id").alias("hit_id"), "terms")
    joined = docs.join(hits.hint("shuffle_hash"), F.expr("doc_id <=> hit_id"), "left").drop("hit_id")
    base = joined.withColumn("base", base_spans(F.col("text")))
    word = r"(?iu)(?<![\p{L}\p{N}_'-])\Q"
    named = F.flatten(F.transform("terms", lambda t: F.transform(
        matches(F.col("text"), F.concat(F.lit(word), t["term"], F.lit(r"\E(?![\p{L}\p{N}_'-])")), "term", len(KINDS)),
        lambda s: F.struct(s["start"], s["k"], s["end"], F.lit("term").alias("kind"), t["action"].alias("value")))))
    free = F.filter(named, lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    base = base.withColumn("spans", F.array_sort(F.concat("base", F.coalesce(free, F.array().cast(SPAN)))))
    return base.withColumn("clean_text", replaced(F.col("text"), F.col("spans"))).drop("terms")


def replaced(text: Column, spans: Column) -> Column:
    """Replace spans, from the left; a span that begins inside an earlier one goes with it."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state, s):
        label = F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(
            s["value"] == "remove", "").otherwise("[TERM]")
        kept = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        new = F.struct(s["end"].alias("at"), F.concat(state["parts"], F.array(kept, label)).alias("parts"))
        return F.when(s["start"] >= state["at"], new).otherwise(
            F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["parts"].alias("parts")))

    state = F.aggregate(spans, first, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(
        F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text))))


def span_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term of every row of ``docs``."""
    found = sanitised(docs, **options)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
                        as_text(F.col("spans")).alias("spans"), count("term"))
