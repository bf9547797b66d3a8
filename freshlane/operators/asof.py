"""As-of / nearest / latest lookups (A1..A8), three different rules kept apart.

Many-target lookups never use a non-equi self-join: requests and facts are
unioned and a window over (store, product) ordered by date carries the last
(or next) fact forward with ``last/first(..., ignorenulls)``. One shuffle on
the pair keys, no pair explosion. Per-pair "latest" is a grouped ``max_by``
with map-side partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["store_id", "product_id"]


def latest_by(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str] | None = None) -> DataFrame:
    """A4/A5: the row with the greatest ``order`` per key (``max_by`` of a struct)."""
    cols = [c for c in (cols or df.columns) if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def asof_backward(requests: DataFrame, facts: DataFrame, keys: Sequence[str], req_date: str,
                  fact_date: str, fact_cols: Sequence[str]) -> DataFrame:
    """Each request row + the latest fact row with fact_date <= req_date (NULLs when none).

    Facts sort before requests on equal dates, so an exact-date fact counts.
    """
    keys = list(keys)
    req_cols = [c for c in requests.columns if c not in keys]
    payload = F.struct(F.col(fact_date).alias("_fdate"), *[F.col(c) for c in fact_cols])
    r = requests.select(*keys, F.col(req_date).alias("_t"), F.lit(1).alias("_side"),
                        F.struct(*req_cols).alias("_req"), F.lit(None).cast(payload_type(facts, fact_date, fact_cols)).alias("_fact"))
    f = facts.select(*keys, F.col(fact_date).alias("_t"), F.lit(0).alias("_side"),
                     F.lit(None).cast(requests.select(F.struct(*req_cols)).schema[0].dataType).alias("_req"),
                     payload.alias("_fact"))
    w = (Window.partitionBy(*keys).orderBy("_t", "_side")
         .rowsBetween(Window.unboundedPreceding, 0))
    u = r.unionByName(f).withColumn("_hit", F.last("_fact", ignorenulls=True).over(w))
    out = u.where(F.col("_side") == 1)
    return out.select(*keys, *[F.col(f"_req.{c}").alias(c) for c in req_cols],
                      F.col("_hit._fdate").alias("matched_date"),
                      *[F.col(f"_hit.{c}").alias(c) for c in fact_cols])


def asof_forward(requests: DataFrame, facts: DataFrame, keys: Sequence[str], req_date: str,
                 fact_date: str, fact_cols: Sequence[str]) -> DataFrame:
    """Each request row + the earliest fact row with fact_date >= req_date."""
    keys = list(keys)
    req_cols = [c for c in requests.columns if c not in keys]
    payload = F.struct(F.col(fact_date).alias("_fdate"), *[F.col(c) for c in fact_cols])
    r = requests.select(*keys, F.col(req_date).alias("_t"), F.lit(0).alias("_side"),
                        F.struct(*req_cols).alias("_req"),
                        F.lit(None).cast(payload_type(facts, fact_date, fact_cols)).alias("_fact"))
    f = facts.select(*keys, F.col(fact_date).alias("_t"), F.lit(1).alias("_side"),
                     F.lit(None).cast(requests.select(F.struct(*req_cols)).schema[0].dataType).alias("_req"),
                     payload.alias("_fact"))
    w = (Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_side"))       # from the end: a growing frame
         .rowsBetween(Window.unboundedPreceding, 0))
    u = r.unionByName(f).withColumn("_hit", F.last("_fact", ignorenulls=True).over(w))
    out = u.where(F.col("_req").isNotNull())
    return out.select(*keys, *[F.col(f"_req.{c}").alias(c) for c in req_cols],
                      F.col("_hit._fdate").alias("matched_date"),
                      *[F.col(f"_hit.{c}").alias(c) for c in fact_cols])


def payload_type(facts: DataFrame, fact_date: str, fact_cols: Sequence[str]):
    return facts.select(F.struct(F.col(fact_date).alias("_fdate"), *[F.col(c) for c in fact_cols])).schema[0].dataType


def nearest(requests: DataFrame, facts: DataFrame, keys: Sequence[str], req_date: str, fact_date: str,
            fact_cols: Sequence[str]) -> DataFrame:
    """A3: fact row with the smallest |date - d|; ties go to the later date.

    One union, two growing frames, forward and backward: the last fact at or before the
    request and the first fact after it, then the closer one. No pair explosion.
    """
    keys = list(keys)
    req_cols = [c for c in requests.columns if c not in keys]
    ptype = payload_type(facts, fact_date, fact_cols)
    rtype = requests.select(F.struct(*req_cols)).schema[0].dataType
    r = requests.select(*keys, F.col(req_date).alias("_t"), F.lit(1).alias("_side"),
                        F.struct(*req_cols).alias("_req"), F.lit(None).cast(ptype).alias("_fact"))
    f = facts.select(*keys, F.col(fact_date).alias("_t"), F.lit(0).alias("_side"),
                     F.lit(None).cast(rtype).alias("_req"),
                     F.struct(F.col(fact_date).alias("_fdate"), *[F.col(c) for c in fact_cols]).alias("_fact"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    u = (r.unionByName(f)
         .withColumn("_b", F.last("_fact", ignorenulls=True).over(w))
         .withColumn("_f", F.last("_fact", ignorenulls=True).over(back))
         .where(F.col("_side") == 1))
    db = F.datediff(F.col("_t"), F.col("_b._fdate"))
    df_ = F.datediff(F.col("_f._fdate"), F.col("_t"))
    pick = (F.when(F.col("_f").isNull(), F.col("_b"))
             .when(F.col("_b").isNull(), F.col("_f"))
             .when(df_ <= db, F.col("_f")).otherwise(F.col("_b")))
    return u.select(*keys, *[F.col(f"_req.{c}").alias(c) for c in req_cols], pick.alias("_n")).select(
        *keys, *req_cols, F.col("_n._fdate").alias("matched_date"),
        *[F.col(f"_n.{c}").alias(c) for c in fact_cols])


def exact_or_latest(requests: DataFrame, facts: DataFrame, keys: Sequence[str], req_date: str,
                    fact_date: str, fact_cols: Sequence[str]) -> DataFrame:
    """A2: exact-date row, else the latest row overall (may be after the date), else absent.

    Left equi-join on the date plus a join to the per-key latest row.
    """
    keys = list(keys)
    exact = facts.select(*keys, F.col(fact_date).alias(req_date),
                         F.struct(F.col(fact_date).alias("matched_date"), *fact_cols).alias("_e"))
    latest = latest_by(facts.select(*keys, fact_date, *fact_cols), keys, fact_date)
    latest = latest.select(*keys, F.struct(F.col(fact_date).alias("matched_date"), *fact_cols).alias("_l"))
    j = requests.join(exact, [*keys, req_date], "left").join(latest, keys, "inner")
    kind = F.when(F.col("_e").isNotNull(), "exact").otherwise("latest")
    pick = F.coalesce(F.col("_e"), F.col("_l"))
    req_cols = [c for c in requests.columns if c not in keys]
    return j.select(*keys, *req_cols, kind.alias("match_kind"), pick.alias("_p")).select(
        *keys, *req_cols, "match_kind", F.col("_p.matched_date").alias("matched_date"),
        *[F.col(f"_p.{c}").alias(c) for c in fact_cols])


def unmatched_requests(requests: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A2/A8 'not found': requests whose key has no fact row at all (anti join)."""
    return requests.join(facts.select(*keys).distinct(), list(keys), "left_anti")
