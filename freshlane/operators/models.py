"""Model training and scoring on Spark ML (M1..M9, S12).

The reference trains XGBoost / LightGBM on one machine; here the same roles
are Spark ML estimators whose tree learning aggregates split statistics
across partitions, so training scales with the cluster:

* demand: GBTRegressor (0.6) + RandomForestRegressor (0.4), clipped at 0;
* intervals: a DecisionTreeRegressor's leaves, with the exact 5th / 95th
  percentile of the training target per leaf (distributed order statistic);
* waste risk: GBTClassifier with positive-class weight neg / max(pos, 1).

Every model has 300 rounds or trees, step 0.05, and takes 0.8 of rows and columns a tree.

A boosted model runs one job per level and round, 1,800 in turn, so its time is that of a job times its tasks: the
training rows are dealt to tasks by their number (``dealt``), not by the files and shuffles they come from. Models
that do not need each other are fitted at the same time, since a round's few tasks leave cores idle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshlane.config import FEATURE_COLUMNS
from freshlane.functions.exprs import risk_tier
from freshlane.functions.quantiles import exact_percentiles

KEYS3 = ["store_id", "product_id", "date"]
#: Training rows of one task: a boosted round's work is small beside its tasks' start, a forest's is not (and each of its
#: tasks shuffles the statistics of all nodes).
BOOST_ROWS, FOREST_ROWS = 32_768, 16_384
#: So many tasks a job are few enough for any number of rows.
FEW_TASKS = 8


@dataclass(frozen=True)
class ModelParams:
    gbt_iter: int = 300
    gbt_depth: int = 6
    gbt_step: float = 0.05
    rf_trees: int = 300
    rf_depth: int = 6       # at most 63 splits a tree
    subsample: float = 0.8
    feature_subset: str = "0.8"
    interval_depth: int = 6
    waste_iter: int = 300
    seed: int = 42


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURE_COLUMNS), outputCol="features_vec", handleInvalid="keep")


def dealt(train: DataFrame, rows: int, per_task: int) -> DataFrame:
    """``train`` in as many partitions as its ``rows`` need, if it came in far more or far fewer.

    Its partitions are counted, so pass a checkpointed frame.
    """
    have, need = train.rdd.getNumPartitions(), max(1, math.ceil(rows / per_task))
    if math.ceil(need / FEW_TASKS) <= have <= max(FEW_TASKS, need):
        return train
    return train.repartition(need, *KEYS3)


def at_once(spark: SparkSession, *builds: Callable) -> list:
    """The results of ``builds``, run side by side on the driver's threads."""
    pool = ThreadPool(len(builds))
    try:
        return pool.map(lambda run: run(), [inheritable_thread_target(spark)(b) for b in builds], chunksize=1)
    finally:
        pool.close()


def train_demand(train: DataFrame, p: ModelParams | None = None) -> PipelineModel:
    """M1: GBT + RF on the same rows (target quantity_sold)."""
    p = p or ModelParams()
    gbt = GBTRegressor(featuresCol="features_vec", labelCol="label", predictionCol="p_gbt", maxIter=p.gbt_iter,
                       maxDepth=p.gbt_depth, stepSize=p.gbt_step, subsamplingRate=p.subsample,
                       featureSubsetStrategy=p.feature_subset, seed=p.seed)
    rf = RandomForestRegressor(featuresCol="features_vec", labelCol="label", predictionCol="p_rf",
                               numTrees=p.rf_trees, maxDepth=p.rf_depth, subsamplingRate=p.subsample,
                               featureSubsetStrategy=p.feature_subset, seed=p.seed, cacheNodeIds=True)
    tree = DecisionTreeRegressor(featuresCol="features_vec", labelCol="label", predictionCol="p_tree",
                                 leafCol="leaf", maxDepth=p.interval_depth, seed=p.seed, cacheNodeIds=True)
    vectors = assembler()
    rows = train.count()

    def fit(estimator, per_task):
        data = dealt(train, rows, per_task).withColumn("label", F.col("quantity_sold").cast("double"))
        return lambda: estimator.fit(vectors.transform(data))

    fitted = at_once(train.sparkSession, fit(gbt, BOOST_ROWS), fit(rf, FOREST_ROWS), fit(tree, FOREST_ROWS))
    return PipelineModel([vectors, *fitted])


def leaf_quantiles(model: PipelineModel, train: DataFrame) -> DataFrame:
    """M3: exact 5th / 95th percentile of the training target per tree leaf."""
    scored = model.transform(train.withColumn("label", F.col("quantity_sold").cast("double")))
    q = exact_percentiles(scored.select("leaf", F.col("label").alias("y")), ["leaf"], "y", [0.05, 0.95])
    return q.groupBy("leaf").agg(F.max(F.when(F.col("prob") == 0.05, F.col("value"))).alias("q05"),
                                 F.max(F.when(F.col("prob") == 0.95, F.col("value"))).alias("q95"))


def score_demand(model: PipelineModel, leaves: DataFrame, df: DataFrame) -> DataFrame:
    """M2 + M3: ensemble max(0, 0.6 gbt + 0.4 rf), leaf interval clipped at 0."""
    s = model.transform(df.withColumn("label", F.lit(0.0)))
    s = s.join(F.broadcast(leaves), "leaf", "left")  # one row per leaf: at most 2^depth rows
    point = F.greatest(F.lit(0.0), F.lit(0.6) * F.col("p_gbt") + F.lit(0.4) * F.col("p_rf"))
    return s.select(*KEYS3, point.alias("predicted_demand"),
                    F.greatest(F.lit(0.0), F.col("q05")).alias("confidence_lower"),
                    F.greatest(F.lit(0.0), F.col("q95")).alias("confidence_upper"))


def train_waste(train: DataFrame, p: ModelParams | None = None) -> PipelineModel:
    """M5: GBT classifier with positive weight neg / max(pos, 1)."""
    p = p or ModelParams()
    bal = train.agg(F.sum("waste_label").alias("pos"), F.count(F.lit(1)).alias("n"))
    w_pos = ((bal.select("n").scalar() - bal.select("pos").scalar())
             / F.greatest(bal.select("pos").scalar(), F.lit(1)))
    data = dealt(train, train.count(), BOOST_ROWS).withColumn("label", F.col("waste_label").cast("double")).withColumn(
        "w", F.when(F.col("waste_label") == 1, w_pos).otherwise(F.lit(1.0)).cast("double"))
    clf = GBTClassifier(featuresCol="features_vec", labelCol="label", weightCol="w", maxIter=p.waste_iter,
                        maxDepth=p.gbt_depth, stepSize=p.gbt_step, subsamplingRate=p.subsample,
                        featureSubsetStrategy=p.feature_subset, seed=p.seed)
    return Pipeline(stages=[assembler(), clf]).fit(data)


def score_waste(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M6 + M7: P(waste) and its tier."""
    s = model.transform(df.withColumn("label", F.lit(0.0)).withColumn("w", F.lit(1.0)))
    prob = vector_to_array("probability")[1]
    return s.select(*KEYS3, prob.alias("waste_risk_score"), risk_tier(prob).alias("waste_risk_tier"))


def feature_importance(model: PipelineModel) -> list[tuple[str, float]]:
    """M4: GBT importances by feature name, descending (35 numbers of model metadata)."""
    gbt = model.stages[1]
    imp = gbt.featureImportances.toArray().tolist()
    return sorted(zip(FEATURE_COLUMNS, imp), key=lambda t: (-t[1], t[0]))


def save(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (shared storage path)."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
