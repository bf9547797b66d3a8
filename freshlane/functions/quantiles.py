"""Distributed exact order statistics and prefix sums.

Spark's exact ``percentile`` aggregate merges a value->count map of the whole
group in a single task (and a global window without ``partitionBy`` pulls all
rows into one task). Both break at scale, so the jobs here always use one
scheme that keeps every task bounded:

1. collapse to distinct values with counts (partial aggregation map-side);
2. cut each key's distinct values into ranges of equal depth (boundaries from
   ``percentile_approx``, an ordinary distributed aggregate), and each range into as
   many steps of equal width as it holds ``STEP_VALUES`` values, so the number of
   buckets follows the data inside the plan;
3. bucket totals give each bucket's offset;
4. exact work (ranks, cumulative sums) runs inside one bucket at a time.

A hot value (a third of all rows) is one distinct value, so it costs nothing
extra. No job runs while a plan is built, and joins carry no broadcast hint: the
small sides (keys x ranges) are broadcast by size only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 32
#: Distinct values of a key in one bucket, about.
STEP_VALUES = 50_000
BUCKET = ["_range", "_step"]


def _bucketed(distinct_df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add BUCKET, two numbers that order the buckets of a key by value."""
    keys = list(keys)
    probs = [i / RANGES for i in range(1, RANGES)]
    bounds = distinct_df.groupBy(*keys).agg(F.percentile_approx(value, probs, 10 * RANGES).alias("_bounds"))
    j = distinct_df.join(bounds, keys)
    j = j.withColumn("_range", F.size(F.filter(F.col("_bounds"), lambda x: x < F.col(value)))).drop("_bounds")
    spans = j.groupBy(*keys, "_range").agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"),
                                           F.ceil(F.count(F.lit(1)) / STEP_VALUES).alias("_n"))
    j = j.join(spans, [*keys, "_range"])
    at = F.floor((F.col(value).cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_n"))
    step = F.when((F.col("_n") > 1) & (F.col("_hi") > F.col("_lo")), F.least(at, F.col("_n") - 1)).otherwise(F.lit(0))
    return j.withColumn("_step", step.cast("long")).drop("_lo", "_hi", "_n")


def bucket_offsets(bucketed: DataFrame, keys: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """Per (key, bucket): totals of ``weights``, running totals before the bucket
    (``_off_<w>``) and key totals (``_all_<w>``)."""
    tot = bucketed.groupBy(*keys, *BUCKET).agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    w_before = Window.partitionBy(*keys).orderBy(*BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*keys)
    return tot.select(*keys, *BUCKET, *[F.col(f"_t_{x}") for x in weights],
                      *[F.coalesce(F.sum(f"_t_{x}").over(w_before), F.lit(0)).alias(f"_off_{x}")
                        for x in weights],
                      *[F.sum(f"_t_{x}").over(w_all).alias(f"_all_{x}") for x in weights])


def prefix_sums(df: DataFrame, keys: Sequence[str], order: str, weights: Sequence[str],
                descending: bool = False) -> DataFrame:
    """Cumulative sums of ``weights`` in ``order`` per key, without a global window.

    ``df`` must be one row per (keys, order) value. Adds ``cum_<w>`` (running
    total up to and including the row), ``prev_<w>`` (before the row) and
    ``all_<w>`` (key total).
    """
    src = df.withColumn("_o", -F.col(order) if descending else F.col(order))
    bk = _bucketed(src, keys, "_o")
    off = bucket_offsets(bk, keys, weights)
    out = bk.join(off.drop(*[f"_t_{x}" for x in weights]), [*keys, *BUCKET])
    w = Window.partitionBy(*keys, *BUCKET).orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    for x in weights:
        out = (out.withColumn(f"cum_{x}", F.sum(x).over(w) + F.col(f"_off_{x}"))
                  .withColumn(f"prev_{x}", F.col(f"cum_{x}") - F.col(x))
                  .withColumnRenamed(f"_all_{x}", f"all_{x}"))
    return out.drop("_o", *BUCKET, *[f"_off_{x}" for x in weights])


def exact_percentiles(long_df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated percentiles (same as SQL ``percentile``) per key.

    ``keys`` must be non-empty (a feature name, a store, ...). Returns one row
    per (keys, prob) with ``prob`` and ``value``; NULLs are ignored.
    """
    keys = list(keys)
    counts = (long_df.where(F.col(value).isNotNull())
              .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))
    bk = _bucketed(counts, keys, value)
    off = bucket_offsets(bk, keys, ["_c"])
    # wanted 0-based ranks for every prob: floor and ceil of p*(n-1), and their bucket
    pr = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    pos = F.col("prob") * (F.col("_all__c") - 1)
    ranks = (off.select(*keys, *BUCKET, "_t__c", "_off__c", "_all__c", pr)
             .withColumn("_pos", pos)
             .withColumn("_r", F.explode(F.array_distinct(F.array(
                 F.floor("_pos").cast("long"), F.ceil("_pos").cast("long")))))
             .where((F.col("_r") >= F.col("_off__c")) & (F.col("_r") < F.col("_off__c") + F.col("_t__c")))
             .select(*keys, *BUCKET, "prob", "_pos", (F.col("_r") - F.col("_off__c")).alias("_rin"),
                     "_r"))
    inside = bk.join(ranks.select(*keys, *BUCKET).distinct(), [*keys, *BUCKET], "left_semi")
    w = Window.partitionBy(*keys, *BUCKET).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_cum", F.sum("_c").over(w))
    picked = (inside.join(ranks, [*keys, *BUCKET])
              .where((F.col("_rin") < F.col("_cum")) & (F.col("_rin") >= F.col("_cum") - F.col("_c")))
              .select(*keys, "prob", "_pos", "_r", F.col(value).alias("_v")))
    g = picked.groupBy(*keys, "prob", "_pos").agg(
        F.min_by("_v", "_r").alias("_lo"), F.max_by("_v", "_r").alias("_hi"),
        F.min("_r").alias("_rlo"), F.max("_r").alias("_rhi"))
    val = _interpolate()
    return g.select(*keys, "prob", val.cast("double").alias("value"))


def _interpolate() -> Column:
    """Linear interpolation between the ranks around p*(n-1): lo + (hi - lo) * frac
    (the form SQL engines and numpy use, so results agree to the last bit)."""
    return F.when((F.col("_rlo") == F.col("_rhi")) | (F.col("_lo") == F.col("_hi")), F.col("_lo")).otherwise(
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.col("_rlo")))


def exact_median_row(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of each column (NULL when a column is all NULL)."""
    long_df = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns
    ])).alias("kv")).select("kv.feature", "kv.v")
    med = exact_percentiles(long_df, ["feature"], "v", [0.5])
    return med.groupBy().pivot("feature", list(columns)).agg(F.first("value"))


def scalar(one_row: DataFrame, column: str) -> Column:
    """Scalar subquery over a one-row frame (merged and reused by Catalyst)."""
    return one_row.select(column).scalar()
