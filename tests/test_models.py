"""Model quality and persistence (fewer rounds than the default, for time)."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from freshlane.operators import models as M
from freshlane.plans.context import Ctx
from freshlane.session import ensure_checkpoint_dir

KEYS3 = ["store_id", "product_id", "date"]
FEW = M.ModelParams(gbt_iter=25, gbt_step=0.15, rf_trees=25, waste_iter=15)


@pytest.fixture(scope="module")
def fitted(spark):
    ctx = Ctx(spark, "/root/testdata/sf0.01")
    train = ctx.ml["train"]
    return ctx, train, M.train_demand(train, FEW)


def test_default_rounds():
    p = M.ModelParams()
    assert (p.gbt_iter, p.rf_trees, p.waste_iter, p.gbt_step, p.subsample, p.feature_subset) == (300, 300, 300, 0.05, 0.8, "0.8")


def test_ensemble_beats_lag_7_and_intervals_are_ordered(fitted):
    ctx, train, model = fitted
    test = ctx.ml["data"].where("split = 'test'")
    scored = M.score_demand(model, M.leaf_quantiles(model, train), test).join(
        test.select(*KEYS3, "quantity_sold", "sales_lag_7d"), KEYS3)
    rmse = lambda c: F.sqrt(F.avg((F.col(c) - F.col("quantity_sold")) ** 2))
    r = scored.agg(rmse("predicted_demand").alias("model"), rmse("sales_lag_7d").alias("lag7"),
                   F.min("confidence_lower").alias("lo"), F.min("predicted_demand").alias("p"),
                   F.count_if(F.col("confidence_lower") > F.col("confidence_upper")).alias("crossed")).first()
    assert r.model < r.lag7 and r.lo >= 0 and r.p >= 0 and r.crossed == 0


def test_saved_model_scores_alike(spark, fitted):
    ctx, train, model = fitted
    path = os.path.join(ensure_checkpoint_dir(spark), "test-out", f"model-{uuid.uuid4().hex[:8]}")
    M.save(model, path)
    leaves = M.leaf_quantiles(model, train)
    rows = train.limit(50)
    a, b = (M.score_demand(m, leaves, rows).orderBy(*KEYS3).collect() for m in (model, M.load(path)))
    assert a == b
    assert len(M.feature_importance(model)) == 35
    waste = M.score_waste(M.train_waste(train, FEW), rows).collect()
    assert all(0 <= r.waste_risk_score <= 1 for r in waste)


def test_rows_scattered_over_many_partitions_are_dealt_by_their_number(spark):
    """A boosted round's tasks follow the training rows, not the partitions they came in."""
    rows = spark.range(0, 3000, 1, 3).select(F.lit(1).alias("store_id"), F.col("id").cast("int").alias("product_id"),
                                             F.lit("2025-01-01").cast("date").alias("date"))
    tasks = lambda df, n=3000: M.dealt(df, n, M.BOOST_ROWS).rdd.getNumPartitions()
    scattered = rows.repartition(60).checkpoint(eager=True)
    assert tasks(scattered) == 1 and M.dealt(scattered, 3000, M.BOOST_ROWS).count() == 3000
    assert tasks(rows.checkpoint(eager=True)) == 3                              # few enough: left as they are
    assert tasks(rows.coalesce(1).checkpoint(eager=True), 40 * M.BOOST_ROWS) == 40      # too many rows for one task


def test_models_fitted_at_once_are_those_fitted_in_turn(spark, fitted):
    _, train, model = fitted
    demand, waste = M.at_once(spark, lambda: M.train_demand(train, FEW), lambda: M.train_waste(train, FEW))
    rows = train.limit(50)
    scores = lambda d, w: (d.transform(rows.withColumn("label", F.lit(0.0))).select("p_gbt", "p_rf", "p_tree").collect(),
                           M.score_waste(w, rows).collect())
    assert scores(demand, waste) == scores(model, M.train_waste(train, FEW))
