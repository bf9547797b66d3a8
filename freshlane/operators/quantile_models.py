"""M3 as models of their own: the 5 % and 95 % demand quantiles, boosted on the pinball loss.

Every round fits, for each probability, one Spark ML tree to the gradient of the pinball loss (``p`` where the target
lies above the present estimate, ``p - 1`` elsewhere) and then refits its leaves: a leaf adds ``step`` times the exact
``p`` quantile of what its rows still miss, which is the value that lowers the leaf's loss most. Leaf quantiles come
from ``exact_percentiles``, for all probabilities in one job, so no leaf is gathered in a task; at most 2^depth numbers
a tree reach the driver. The running estimates are checkpointed every ``write_every`` rounds, which bounds the lineage
an executor loss replays and the trees a pass over the rows evaluates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshlane.functions.quantiles import exact_percentiles
from freshlane.operators.models import KEYS3, assembler


@dataclass(frozen=True)
class QuantileParams:
    rounds: int = 20
    step: float = 0.3
    depth: int = 5
    min_rows: int = 20      # rows a leaf needs
    write_every: int = 4
    seed: int = 42


@dataclass
class QuantileModel:
    probs: tuple[float, ...]
    step: float
    start: list[float]                                          # by probability
    trees: list = field(default_factory=list)                   # by round, then probability
    values: list[list[list[float]]] = field(default_factory=list)   # leaf values by round and probability

    def estimate(self, assembled: DataFrame) -> DataFrame:
        """Adds ``q_0``, ``q_1``... (one for each probability) to rows with ``features_vec``."""
        out, sums = assembled, [F.lit(s) for s in self.start]
        for r, (trees, values) in enumerate(zip(self.trees, self.values)):
            for i, (tree, leaf_values) in enumerate(zip(trees, values)):
                out = tree.setPredictionCol("").setLeafCol(_leaf(r, i)).transform(out)
                sums[i] = sums[i] + F.lit(self.step) * _at(leaf_values, _leaf(r, i))
        return out.select(*assembled.columns, *[s.alias(f"q_{i}") for i, s in enumerate(sums)])

    def save(self, spark: SparkSession, path: str) -> None:
        """Trees as a pipeline, numbers as a small table."""
        PipelineModel([t.setPredictionCol("").setLeafCol(_leaf(r, i)) for r, ts in enumerate(self.trees)
                       for i, t in enumerate(ts)]).write().overwrite().save(f"{path}/trees")
        rows = [(-1, i, p, self.step, [s]) for i, (p, s) in enumerate(zip(self.probs, self.start))]
        rows += [(r, i, self.probs[i], self.step, v) for r, vs in enumerate(self.values) for i, v in enumerate(vs)]
        spark.createDataFrame(rows, "round int, i int, prob double, step double, leaves array<double>").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/numbers")


def load_quantiles(spark: SparkSession, path: str) -> QuantileModel:
    numbers = spark.read.parquet(f"{path}/numbers").orderBy("round", "i").collect()     # rounds x probabilities rows
    first = [n for n in numbers if n["round"] < 0]
    later, k = [n for n in numbers if n["round"] >= 0], len(first)
    trees = PipelineModel.load(f"{path}/trees").stages
    return QuantileModel(tuple(n["prob"] for n in first), first[0]["step"], [n["leaves"][0] for n in first],
                         [list(trees[j:j + k]) for j in range(0, len(trees), k)],
                         [[list(n["leaves"]) for n in later[j:j + k]] for j in range(0, len(later), k)])


def _leaf(r: int, i: int) -> str:
    return f"_leaf_{r}_{i}"


def _at(values: list[float], leaf: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.col(leaf).cast("int"))


def train_quantiles(train: DataFrame, probs: tuple[float, ...] = (0.05, 0.95), p: QuantileParams | None = None) -> QuantileModel:
    """Boosted quantiles of quantity_sold on the 35 features of ``train`` (NULL targets are left out)."""
    p = p or QuantileParams()
    y = F.col("quantity_sold").cast("double")
    rows = assembler().transform(train.where(y.isNotNull())).select("features_vec", y.alias("y")).checkpoint(eager=True)
    start = {r["prob"]: float(r["value"]) for r in exact_percentiles(
        rows.select(F.lit(0).alias("k"), "y"), ["k"], "y", list(probs)).collect()}
    if not start:
        raise ValueError("no rows to learn quantiles from")
    model = QuantileModel(tuple(probs), p.step, [start[q] for q in probs])
    now = rows.select("*", *[F.lit(s).alias(f"q_{i}") for i, s in enumerate(model.start)])
    for r in range(p.rounds):
        scored, trees = now, []
        for i, q in enumerate(probs):
            gradient = F.when(F.col("y") > F.col(f"q_{i}"), F.lit(q)).otherwise(F.lit(q - 1.0))
            tree = DecisionTreeRegressor(featuresCol="features_vec", labelCol="label", maxDepth=p.depth,
                                         minInstancesPerNode=p.min_rows, seed=p.seed + r)
            trees.append(tree.fit(now.withColumn("label", gradient)).setPredictionCol("").setLeafCol(_leaf(r, i)))
            scored = trees[-1].transform(scored)
        missed = scored.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.col(_leaf(r, i)).cast("int").alias("leaf"), (F.col("y") - F.col(f"q_{i}")).alias("d"))
            for i in range(len(probs))])).alias("x")).select("x.*")
        found = {(v["i"], v["leaf"]): float(v["value"]) for v in exact_percentiles(missed, ["i", "leaf"], "d", list(probs)).collect()
                 if v["prob"] == probs[v["i"]]}
        values = [[found.get((i, leaf), 0.0) for leaf in range(max(k for j, k in found if j == i) + 1)] for i in range(len(probs))]
        model.trees.append(trees)
        model.values.append(values)
        now = scored.select("features_vec", "y", *[
            (F.col(f"q_{i}") + F.lit(p.step) * _at(values[i], _leaf(r, i))).alias(f"q_{i}") for i in range(len(probs))])
        if (r + 1) % p.write_every == 0 and r + 1 < p.rounds:
            now = now.checkpoint(eager=True)
    return model


def score_quantiles(model: QuantileModel, df: DataFrame) -> DataFrame:
    """KEYS3, confidence_lower, confidence_upper: the first and last probability's estimate, at least 0."""
    out = model.estimate(assembler().transform(df).select(*KEYS3, "features_vec"))
    return out.select(*KEYS3, F.greatest(F.lit(0.0), F.col("q_0")).alias("confidence_lower"),
                      F.greatest(F.lit(0.0), F.col(f"q_{len(model.probs) - 1}")).alias("confidence_upper"))


def pinball(y: Column, q: Column, p: float) -> Column:
    """Mean pinball loss of the estimate ``q`` of the ``p`` quantile."""
    return F.avg(F.greatest(F.lit(p) * (y - q), F.lit(p - 1.0) * (y - q)))
