"""Data-quality checks (Q1..Q8) as DataFrame jobs returning long-form reports.

Each check is a grouped aggregate or an anti join; per-table results are
unioned into one (check, table, column, violations) frame so a whole audit is
one plan. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS3 = ["store_id", "product_id", "date"]


def _row(df: DataFrame, table: str, column: str, violations) -> DataFrame:
    return df.agg(violations.cast("long").alias("violations")).select(
        F.lit(table).alias("table"), F.lit(column).alias("column"), "violations")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def duplicates(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Q1: number of keys that occur more than once, per table."""
    frames = []
    for name, (df, keys) in tables.items():
        d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        frames.append(_row(d, name, ",".join(keys), F.count(F.lit(1))))
    return _union(frames)


def nulls(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Q2 / Q6: NULL count per required column."""
    frames = []
    for name, (df, cols) in tables.items():
        g = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        frames.append(g.select(F.explode(F.array(*[
            F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.col(c).cast("long").alias("violations"))
            for c in cols])).alias("x")).select("x.*"))
    return _union(frames)


def out_of_range(checks: list[tuple[str, DataFrame, str, float | None, float | None]]) -> DataFrame:
    """Q3 / Q4: rows outside [lo, hi] per (table, column)."""
    frames = []
    for name, df, c, lo, hi in checks:
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (F.col(c) < lo)
        if hi is not None:
            bad = bad | (F.col(c) > hi)
        frames.append(_row(df, name, c, F.count_if(bad)))
    return _union(frames)


def orphans(checks: list[tuple[str, DataFrame, DataFrame, str]]) -> DataFrame:
    """Q5: child rows whose key has no parent row (left anti join)."""
    frames = []
    for name, child, parent, key in checks:
        o = child.select(key).join(parent.select(key).distinct(), key, "left_anti")
        frames.append(_row(o, name, key, F.count(F.lit(1))))
    return _union(frames)


def row_counts(checks: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """Q7: table row counts against a minimum."""
    frames = [df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("table"), F.col("n").cast("long").alias("rows"), F.lit(minimum).cast("long").alias("min_rows"),
        (F.col("n") >= minimum).alias("ok")) for name, df, minimum in checks]
    return _union(frames)


def request_validity(req: DataFrame) -> DataFrame:
    """Q8: split posted requests into valid / rejected with the first failing rule."""
    reason = (F.when(F.col("store_id") < 1, "store_id < 1")
               .when(F.col("product_id") < 1, "product_id < 1")
               .when(F.col("current_stock") < 0, "current_stock < 0")
               .when(F.col("days_until_expiry") < 0, "days_until_expiry < 0"))
    return req.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "valid").otherwise("rejected"))
