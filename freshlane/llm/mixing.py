"""Operator 8, soft-membership mixing of sources to target weights.

A naive-Bayes classifier over hashed tokens learns domains from a labelled table and gives each document
posteriors over them. Document rates r in [0, max_rate] are then fitted so that the expected token
totals of the domains, E_d = sum r_i n_i p_id, come near the targets T_d: projected gradient steps on
sum (E_d - T_d)^2 / N_d, where N_d is the total at rate 1. The largest target sets the scale
(its domain is wanted as often as it is there), so T_d = N_a w_d / w_a.

A step depends on a document only through its posteriors, which are kept to three digits, so the steps run
over the table of distinct posterior vectors with their token sums (bounded by the digits, not by the
documents), and each step's gradient is one number per domain. A document's rate replays the steps.

The classifier learns from at most ``max_labelled`` labelled documents, the first by a hash of their id
(a bounded sample of labelled rows, broadcast); everything else covers all documents.

Edge cases: null and empty texts have no tokens and the prior as posterior; without labelled documents
all rates are 1; a document with labels of several domains takes the first by name; null ids and
domains teach nothing; repeated rows are mixed alike; a domain without labels gets posterior 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshlane.llm.common import packed_rows, unpacked, words, written
from freshlane.llm.quality import PUNCTUATION_RUN

BUCKETS = 65536
MAX_LABELLED = 20_000
#: Tokens of background (all labelled documents) added to each domain, times its own: keeps rare buckets from deciding.
BACKGROUND = 0.5
#: A bucket's log ratio for a domain counts z^4 / (z^4 + HALF_Z^4), where z is how many standard deviations lie between the
#: domain's documents that hold it and what the share of all labelled documents lets expect: chance adds up to little,
#: weak evidence still speaks.
HALF_Z = 4.0
STEPS = 60
TARGETS = {"clean": 0.96, "low": 0.03, "toxic": 0.01}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of quality and toxic labels."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low")
                         .when(F.col("quality") == 1, "clean").alias("domain"))


def token_buckets(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A row per token of ``df`` (text): its other columns and the token's bucket (null without tokens)."""
    spaced = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), PUNCTUATION_RUN, " $0 ")
    rest = [c for c in df.columns if c != "text"]
    df = df.select(*rest, F.explode_outer(words(spaced)).alias("__t"))
    return df.select(*rest, F.when(F.col("__t").isNotNull(), F.pmod(F.xxhash64("__t"), F.lit(buckets)).cast("int")).alias("bucket"))


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], buckets: int = BUCKETS,
          max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, dict[str, int]]:
    """One row ``weights`` (array by bucket: null, or a struct d0, d1, ... of ln p(bucket | domain) / p(bucket), shrunk),
    and the labelled documents of each domain."""
    sample = (labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
              .groupBy("doc_id").agg(F.min("domain").alias("domain"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    sample = written(sample, "labelled")
    known = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    found = token_buckets(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), buckets)
    once = found.where("bucket IS NOT NULL").groupBy("doc_id", "domain", "bucket").agg(F.count("*").alias("n"))
    each = [(F.col("domain") == d, f"n{i}", f"f{i}") for i, d in enumerate(domains)]
    counts = once.groupBy("bucket").agg(*[c for own, n, f in each for c in (
        F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias(n), F.count(F.when(own, 1)).alias(f))])
    counts = written(counts, "buckets")
    tokens = list(counts.agg(*[F.coalesce(F.sum(n), F.lit(0)) for _, n, _ in each]).first())
    documents = [known.get(d, 0) for d in domains]
    all_n = sum((F.col(n) for _, n, _ in each[1:]), F.col("n0"))
    all_f = sum((F.col(f) for _, _, f in each[1:]), F.col("f0"))
    back = (all_n + 1.0) / float(sum(tokens) + buckets)
    usual = all_f / float(max(1, sum(documents)))
    trust = []
    for (_, _, f), m in zip(each, documents):
        z4 = F.pow((F.col(f) - usual * m) / F.sqrt(F.lit(1.0) + usual * m * (1 - usual)), F.lit(4.0))
        trust.append(z4 / (z4 + HALF_Z ** 4))
    weights = F.struct(*[(q * F.ln((F.col(n) + BACKGROUND * max(1, t) * back) / ((1 + BACKGROUND) * max(1, t)) / back)).alias(f"d{i}")
                         for i, ((_, n, _), t, q) in enumerate(zip(each, tokens, trust))])
    telling = counts.select("bucket", weights.alias("w"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(telling, "bucket", "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "w"))).alias("c"))      # exactly ``buckets`` entries
    return written(row.select(F.col("c")["w"].alias("weights")), "weights"), known


def posteriors(docs: DataFrame, weights: DataFrame, known: dict[str, int], domains: list[str],
               buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_tokens and m0, m1, ...: thousandths of the posterior of each domain, per row of ``docs``."""
    table = weights.scalar()
    rows = docs.select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id())
    found = token_buckets(rows, buckets)
    sums = [F.sum(F.coalesce(F.get(table, F.col("bucket"))[f"d{i}"], F.lit(0.0))).alias(f"s{i}") for i in range(len(domains))]
    scored = found.groupBy("__row", "doc_id").agg(F.count("bucket").alias("n_tokens"), *sums)
    labelled = max(1, sum(known.values()))
    logs = [F.col(f"s{i}") + F.log(F.lit(known[d] / labelled)) if known.get(d) else F.lit(None).cast("double")
            for i, d in enumerate(domains)]
    top = F.greatest(*logs, F.lit(-1e308))
    shares = [F.coalesce(F.exp(x - top), F.lit(0.0)) for x in logs]
    whole = sum(shares[1:], shares[0])
    return scored.select("doc_id", "n_tokens", *[
        F.when(whole > 0, F.round(1000 * s / whole)).otherwise(0).cast("int").alias(f"m{i}") for i, s in enumerate(shares)])


def rate(steps: list[list[float]], max_rate: float) -> Column:
    """A document's rate after the projected-gradient ``steps``, from its posteriors m0, m1, ..."""
    if not steps:
        return F.lit(1.0)
    taken = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])

    def move(r, g):
        down = sum((F.col(f"m{i}") / 1000 * g[i] for i in range(1, len(steps[0]))), F.col("m0") / 1000 * g[0])
        return F.least(F.lit(max_rate), F.greatest(F.lit(0.0), r - down))

    return F.round(F.aggregate(taken, F.lit(1.0), move), 6)


def fit_steps(members: DataFrame, targets: list[float], max_rate: float, steps: int = STEPS,
              close: float = 1e-4) -> list[list[float]]:
    """Gradients of the steps, one number per domain each; ``members`` has n_tokens and m0, m1, ..."""
    ms = [f"m{i}" for i in range(len(targets))]
    binned = written(members.groupBy(*ms).agg(F.sum("n_tokens").alias("n")), "posterior-bins")

    def totals(taken):
        r = binned.withColumn("r", rate(taken, max_rate))
        return list(r.agg(*[F.coalesce(F.sum(F.col("r") * F.col("n") * F.col(m) / 1000), F.lit(0.0)).alias(m) for m in ms]).first())

    at_one = totals([])
    anchor = max(range(len(targets)), key=lambda i: targets[i])
    if not at_one[anchor] or not targets[anchor]:
        return []
    wanted = [at_one[anchor] * t / targets[anchor] for t in targets]
    taken: list[list[float]] = []
    for _ in range(steps):
        now = totals(taken)
        g = [(e - t) / n if n else 0.0 for e, t, n in zip(now, wanted, at_one)]
        taken.append(g)
        if len(taken) > 1 and max(abs(a - b) for a, b in zip(g, taken[-2])) < close:
            break
    return taken


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, max_rate: float = 1.0,
                 max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, n_tokens, p_<domain> for each domain, rate and copies of every row of ``docs`` (doc_id, text).

    Copies are the rate's whole part, and one more with its fraction as the chance, by a hash of the id, so that the
    copies' token totals are those of the rates but for chance.
    """
    targets = targets or TARGETS
    domains = sorted(targets)
    weights, known = train(docs, labelled, domains, max_labelled=max_labelled)
    members = written(posteriors(docs, weights, known, domains), "posteriors")
    steps = fit_steps(members, [targets[d] for d in domains], max_rate) if known else []
    chance = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    part = F.col("rate") - F.floor("rate")
    return (members.withColumn("rate", rate(steps, max_rate))
            .withColumn("copies", (F.floor("rate") + F.when(chance < part, 1).otherwise(0)).cast("int"))
            .select("doc_id", "n_tokens", *[(F.col(f"m{i}") / 1000).alias(f"p_{d}") for i, d in enumerate(domains)],
                    "rate", "copies"))


def mixed(docs: DataFrame, labelled: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, as often as their copies say (a repeated id: the most)."""
    found = written(mixing_rates(docs, labelled, **options).select("doc_id", "copies"), "copies")
    changed = (found.groupBy("doc_id").agg(F.max("copies").alias("__copies")).where("__copies <> 1")
               .withColumnRenamed("doc_id", "__id"))
    joined = packed_rows(docs).join(changed.hint("shuffle_hash"), F.expr("doc_id <=> __id"), "left")
    copies = F.coalesce("__copies", F.lit(1))
    return unpacked(joined.select("__row", F.explode(F.array_repeat(F.lit(1), copies))), docs.columns)
