"""Drift, feedback and retrain decisions (R1..R9).

Drift runs as one job over all watched features in long form
(feature, sample, value): the reference's per-feature loop becomes a
``groupBy(feature)``. KS cumulative distributions use bucketed prefix sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshlane.config import DRIFT_FEATURES, Config
from freshlane.functions.quantiles import prefix_sums

PSI_EPS = 1e-4


def long_samples(fs: DataFrame, train_cut: Column, recent_start: Column,
                 features: Sequence[str] = DRIFT_FEATURES) -> DataFrame:
    """(feature, sample, v): train = date < cut, recent = date >= start; NULLs dropped."""
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
                             for c in features])).alias("kv")
    # a row can be in both samples when the windows overlap
    both = F.array(F.when(F.col("date") < train_cut, F.lit("train")),
                   F.when(F.col("date") >= recent_start, F.lit("recent")))
    return (fs.select("date", kv, F.explode(both).alias("sample"))
            .where(F.col("sample").isNotNull() & F.col("kv.v").isNotNull())
            .select("kv.feature", "sample", "kv.v"))


def value_counts(long_df: DataFrame) -> DataFrame:
    """(feature, v, c1 = train rows, c2 = recent rows): the one aggregation PSI and KS share."""
    return long_df.groupBy("feature", "v").agg(F.count_if(F.col("sample") == "train").alias("c1"),
                                               F.count_if(F.col("sample") == "recent").alias("c2"))


def psi(long_df: DataFrame, bins: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """PSI per feature, equal-width bins over the joint min..max (last bin closed)."""
    c = counts if counts is not None else value_counts(long_df)
    stats = c.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                                     F.sum("c1").alias("n_e"), F.sum("c2").alias("n_a"))
    b = F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    binned = (c.join(F.broadcast(stats), "feature").where(F.col("hi") > F.col("lo"))  # one row per feature
              .groupBy("feature", b.cast("int").alias("bin"))
              .agg(F.sum("c1").alias("c_e"), F.sum("c2").alias("c_a")))
    grid = stats.where(F.col("hi") > F.col("lo")).select(
        "feature", "n_e", "n_a", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    j = grid.join(binned, ["feature", "bin"], "left")
    e = F.coalesce(F.col("c_e"), F.lit(0)) / F.col("n_e") + PSI_EPS
    a = F.coalesce(F.col("c_a"), F.lit(0)) / F.col("n_a") + PSI_EPS
    val = j.groupBy("feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))
    return stats.select("feature").join(val, "feature", "left").select(
        "feature", F.coalesce(F.col("psi"), F.lit(0.0)).alias("psi"))


def ks_pvalue(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample KS p-value 2 * sum (-1)^(k-1) exp(-2 k^2 lambda^2), clamped to [0, 1]."""
    lam = d * F.sqrt(n1 * n2 / (n1 + n2))
    s = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                    lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
                    * F.exp(F.lit(-2.0) * k * k * lam * lam))
    return F.when(d <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * s)))


def ks(long_df: DataFrame, counts: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """R2: KS statistic max |F1 - F2| over the pooled distinct values, and its p-value (the limit law's, or with ``exact``
    that of all merge orders where both sides have at most 10,000 rows)."""
    c = counts if counts is not None else value_counts(long_df)
    cum = prefix_sums(c, ["feature"], "v", ["c1", "c2"])
    g = cum.groupBy("feature").agg(
        F.max(F.abs(F.col("cum_c1") / F.col("all_c1") - F.col("cum_c2") / F.col("all_c2"))).alias("d"),
        F.max("all_c1").alias("n1"), F.max("all_c2").alias("n2"))
    p = ks_pvalue(F.col("d"), F.col("n1").cast("double"), F.col("n2").cast("double"))
    if exact:
        from freshlane.functions.ks_exact import ks_exact_pvalue
        p = ks_exact_pvalue(F.col("d"), F.col("n1"), F.col("n2"), p)
    return g.select("feature", F.col("d").alias("ks_statistic"), p.alias("p"))


def drift_report(fs: DataFrame, train_cut: Column, recent_start: Column, config: Config | None = None,
                 features: Sequence[str] = DRIFT_FEATURES) -> DataFrame:
    """Per feature psi (4 dp), KS (4 dp), drifted = psi > thr OR p < alpha;
    fewer than ``drift_min_rows`` rows on either side -> insufficient_data."""
    config = config or Config()
    thr = config.psi_threshold or Config().psi_threshold
    ld = long_samples(fs, train_cut, recent_start, features)
    vc = value_counts(ld)  # one aggregation of the long samples, shared by counts, PSI and KS
    counts = vc.groupBy("feature").agg(F.sum("c1").alias("n_train"), F.sum("c2").alias("n_recent"))
    j = (counts.join(psi(ld, config.psi_bins, vc), "feature", "left")
         .join(ks(ld, vc), "feature", "left"))
    enough = (F.col("n_train") >= config.drift_min_rows) & (F.col("n_recent") >= config.drift_min_rows)
    p4, k4, pv4 = F.round("psi", 4), F.round("ks_statistic", 4), F.round("p", 4)
    return j.select(
        "feature", F.col("n_train").cast("long"), F.col("n_recent").cast("long"),
        F.when(enough, p4).otherwise(F.lit(0.0)).alias("psi"),
        F.when(enough, k4).alias("ks_statistic"), F.when(enough, pv4).alias("ks_p_value"),
        F.when(enough, (F.col("psi") > thr) | (F.col("p") < config.ks_alpha)).otherwise(F.lit(False))
        .alias("drifted"),
        F.when(enough, F.lit(None).cast("string")).otherwise(F.lit("insufficient_data")).alias("reason"))


def drift_alert_row(report: DataFrame) -> DataFrame:
    """The alert a drift run appends (no row when nothing drifted)."""
    d = report.where(F.col("drifted"))
    place = F.array_position(F.array(*[F.lit(f) for f in DRIFT_FEATURES]), F.col("feature"))    # report order
    rows = F.array_sort(F.collect_list(F.struct(
        place.alias("place"), "feature", F.struct("psi", "ks_statistic", "ks_p_value", "drifted").alias("r"))))
    meta = F.map_from_entries(F.transform(rows, lambda x: F.struct(x["feature"], x["r"])))
    names = F.array_join(F.transform(rows, lambda x: x["feature"]), ", ")
    shown = F.array_join(F.transform(rows, lambda x: F.format_string(
        "%s psi=%.4f ks=%.4f p=%.4f", x["feature"], x["r"]["psi"], x["r"]["ks_statistic"], x["r"]["ks_p_value"])), "; ")
    g = d.agg(F.count(F.lit(1)).alias("n"), names.alias("names"), F.to_json(meta).alias("metadata_json"),
              shown.alias("metadata"))
    return g.where(F.col("n") > 0).select(
        F.lit("data_drift").alias("alert_type"),
        F.when(F.col("n") > 2, "high").otherwise("medium").alias("severity"),
        F.format_string("Data drift detected in %d feature(s): %s", F.col("n"), F.col("names")).alias("message"),
        "metadata_json", F.col("n").cast("long").alias("n_drifted"), "metadata")


def rolling_mape(predictions: DataFrame, as_of: Column, window_days: int = 7,
                 upper_bound: bool = True) -> DataFrame:
    """Per store AVG(|forecast_error|) where actual present, date in [as_of - w, as_of]
    (8 days inclusive); I5 variant: no upper bound."""
    p = predictions.where(F.col("actual_demand").isNotNull() & (F.col("date") >= F.date_sub(as_of, window_days)))
    if upper_bound:
        p = p.where(F.col("date") <= as_of)
    return p.groupBy("store_id").agg(F.avg(F.abs(F.col("forecast_error").cast("double"))).alias("mape_raw"))


def mape_status(mape: Column, threshold: float) -> Column:
    """Degraded when mape > threshold; NULL mape is not degraded."""
    return F.coalesce(mape > threshold, F.lit(False))


def forecast_error_histogram(predictions: DataFrame,
                             bounds: Sequence[float] = (0.5, 1, 2, 5, 10, 20, 50, 100)) -> DataFrame:
    """Cumulative counts of |pred - actual| per store at each upper bound (le), +Inf last."""
    p = predictions.where(F.col("actual_demand").isNotNull()).select(
        "store_id", F.abs(F.col("predicted_demand").cast("double") - F.col("actual_demand")).alias("e"))
    aggs = [F.count_if(F.col("e") <= F.lit(float(b))).alias(f"le_{i}") for i, b in enumerate(bounds)]
    g = p.groupBy("store_id").agg(*aggs, F.count(F.lit(1)).alias("le_inf"))
    entries = [F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(bounds)]
    entries.append(F.struct(F.lit(float("inf")).alias("le"), F.col("le_inf").alias("n")))
    return g.select("store_id", F.explode(F.array(*entries)).alias("b")).select(
        "store_id", F.col("b.le").cast("string").alias("le"), F.col("b.n").cast("long").alias("count"))
