"""Boosted demand quantiles against the leaves of a single tree, and their store on disk."""

import os
import uuid

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from freshlane.operators import models as M
from freshlane.operators import quantile_models as Q
from freshlane.plans.context import Ctx
from freshlane.session import ensure_checkpoint_dir


@pytest.fixture(scope="module")
def data(spark):
    ctx = Ctx(spark, "/root/testdata/sf0.01")
    return ctx.ml["train"], ctx.ml["data"].where("split = 'test'")


@pytest.fixture(scope="module")
def model(data):
    return Q.train_quantiles(data[0])


def test_lower_pinball_loss_than_one_tree(data, model):
    train, test = data
    tree = Pipeline(stages=[M.assembler(), DecisionTreeRegressor(
        featuresCol="features_vec", labelCol="label", predictionCol="p_tree", leafCol="leaf", maxDepth=6, seed=42)]).fit(
            train.withColumn("label", F.col("quantity_sold").cast("double")))
    single = tree.transform(test.withColumn("label", F.lit(0.0))).join(M.leaf_quantiles(tree, train), "leaf", "left")
    boosted = Q.score_quantiles(model, test).join(test.select(*M.KEYS3, "quantity_sold"), M.KEYS3)
    y = F.col("quantity_sold").cast("double")
    a = single.agg(Q.pinball(y, F.col("q05"), 0.05).alias("lo"), Q.pinball(y, F.col("q95"), 0.95).alias("hi")).first()
    b = boosted.agg(Q.pinball(y, F.col("confidence_lower"), 0.05).alias("lo"),
                    Q.pinball(y, F.col("confidence_upper"), 0.95).alias("hi"),
                    F.avg((y < F.col("confidence_lower")).cast("int")).alias("below"),
                    F.avg((y > F.col("confidence_upper")).cast("int")).alias("above")).first()
    print("pinball, one tree:", a, "boosted:", b)
    assert b.lo < a.lo and b.hi < a.hi
    assert b.below < 0.15 and b.above < 0.15


def test_saved_quantiles_score_alike(spark, data, model):
    path = os.path.join(ensure_checkpoint_dir(spark), "test-out", f"quantiles-{uuid.uuid4().hex[:8]}")
    model.save(spark, path)
    rows = data[1].limit(40)
    a, b = (Q.score_quantiles(m, rows).orderBy(*M.KEYS3).collect() for m in (model, Q.load_quantiles(spark, path)))
    assert a == b and len(a) == 40


def test_no_rows_is_an_error(data):
    with pytest.raises(ValueError):
        Q.train_quantiles(data[0].where("false"), p=Q.QuantileParams(rounds=1))
