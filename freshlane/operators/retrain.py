"""Retraining as champion and challenger, with its alerts.

A challenger is fitted on the retrain split's train rows; it and the champion, read from the model store, are scored in
one pass over the same test rows, and the challenger is promoted only with a strictly lower MAPE (or without a
champion). A promotion writes a new version folder and marks it complete last, so scorers never see half a model, and
a roll-back is another pointer. Every cycle appends one alert.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from freshlane.config import Config
from freshlane.operators import evaluate as E
from freshlane.operators import labels as L
from freshlane.operators import models as M
from freshlane.sources.monthly import MonthTable

ALERT = ("date date, alert_type string, severity string, message string, metadata_json string, acknowledged boolean, "
         "created_at timestamp_ntz")
MEASURES = ("rmse", "mae", "mape", "wape", "r2")


class ModelStore:
    """Versions of the demand and waste models in ``root/v<n>``; ``root/current/<k>`` holds the version in use."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}".rstrip("/"))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())

    def _pointers(self) -> list[int]:
        """The versions that were in use, oldest first."""
        return [int(self.spark.read.text(f"{self.root}/current/{k}").first()[0]) for k in self._numbers("current", "")]

    def current(self) -> int | None:
        known = self._numbers("current", "")
        return int(self.spark.read.text(f"{self.root}/current/{known[-1]}").first()[0]) if known else None

    def use(self, version: int) -> None:
        k = (self._numbers("current", "") or [0])[-1] + 1
        self.spark.range(1).select(F.lit(str(version))).coalesce(1).write.text(f"{self.root}/current/{k}")

    def load(self, name: str, version: int):
        return M.load(f"{self.root}/v{version}/{name}")

    def leaves(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{version}/leaves")

    def promote(self, demand, leaves: DataFrame, waste) -> int:
        version = (self._numbers("", "v") or [0])[-1] + 1
        M.save(demand, f"{self.root}/v{version}/demand")
        M.save(waste, f"{self.root}/v{version}/waste")
        leaves.write.parquet(f"{self.root}/v{version}/leaves")
        self.use(version)
        return version

    def roll_back(self) -> int | None:
        """Back to the version in use before the current one; None (and no change) if there was no other."""
        used = self._pointers()
        before = [v for v in used[:-1] if v != used[-1]]
        if not before:
            return None
        self.use(before[-1])
        return before[-1]


def alert_log(spark: SparkSession, root: str) -> MonthTable:
    return MonthTable(spark, root, StructType.fromDDL(ALERT))


def append_alert(log: MonthTable, kind: str, severity: str, message: str, metadata: Column, now: Column) -> None:
    """One row; ``metadata`` is a JSON string or a struct."""
    row = log.spark.range(1).select(
        F.to_date(now).alias("date"), F.lit(kind).alias("alert_type"), F.lit(severity).alias("severity"),
        F.lit(message).alias("message"), metadata.alias("metadata_json"), F.lit(False).alias("acknowledged"),
        now.cast("timestamp_ntz").alias("created_at"))
    log.append(row, log.state())


def append_drift_alert(log: MonthTable, report_row: DataFrame, now: Column) -> bool:
    """S9 with R3a's row, if the drift report has one."""
    found = report_row.select("severity", "message", "metadata_json").first()      # one row at most
    if found is None:
        return False
    append_alert(log, "data_drift", found["severity"], found["message"], F.lit(found["metadata_json"]), now)
    return True


def schedule_due(log: MonthTable, now: Column, days: int) -> Column:
    """R4's schedule trigger on the log: no promotion yet, or the last one at least ``days`` whole days ago."""
    last = log.read().where("alert_type = 'model_promoted'").agg(F.max("created_at").alias("t")).select("t").scalar()
    whole = F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(last.cast("timestamp"))) / 86400)
    return last.isNull() | (whole >= days)


def scored_by(models: dict, rows: DataFrame) -> DataFrame:
    """model, y, p of every row and model (ensemble point forecast); one pass over ``rows`` for all models."""
    scored = rows.withColumn("label", F.lit(0.0))
    for name, model in models.items():
        out = model.transform(scored)
        point = F.greatest(F.lit(0.0), F.lit(0.6) * F.col("p_gbt") + F.lit(0.4) * F.col("p_rf"))
        scored = out.withColumn(f"of_{name}", point).drop("features_vec", "p_gbt", "p_rf", "p_tree", "leaf")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"of_{n}").alias("p")) for n in models])).alias("x")
    return scored.select(F.col("quantity_sold").alias("y"), each).select("x.model", "y", "x.p")


def retrain(features: DataFrame, store: ModelStore, log: MonthTable, now: Column, params: M.ModelParams | None = None,
            config: Config | None = None) -> DataFrame:
    """One cycle on ``features`` (35 features, quantity_sold, units_wasted); returns its summary, one row.

    promoted, version (in use afterwards), new_* and current_* demand measures on the test rows (NULL without a
    champion), waste_f1 and waste_auc of the challenger, alert_type, message.
    """
    spark = features.sparkSession
    rows = L.add_retrain_split(L.add_waste_label(features), config).checkpoint(eager=True)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    challenger, waste = M.at_once(spark, lambda: M.train_demand(train, params), lambda: M.train_waste(train, params))
    models, held = {"new": challenger}, store.current()
    if held is not None:
        models["current"] = store.load("demand", held)
    measured = {r["model"]: r for r in E.forecast_metrics(scored_by(models, test), ["model"]).collect()}     # two rows
    risk = M.score_waste(waste, test).join(test.select(*M.KEYS3, F.col("waste_label").alias("label")), M.KEYS3).select(
        F.lit("new").alias("model"), "label", F.round("waste_risk_score", 6).alias("score"))
    waste_row = E.classifier_metrics(risk, ["model"]).join(E.auc_roc(risk, ["model"]), "model").first()
    new, current = measured.get("new"), measured.get("current")
    promoted = new is not None and (held is None or (current is not None and new["mape"] < current["mape"]))

    def shown(r) -> Column:
        return F.struct(*[F.lit(float(r[c]) if r and r[c] is not None else None).cast("double").alias(c) for c in MEASURES])

    waste_shown = F.struct(*[F.lit(float(waste_row[c]) if waste_row else None).cast("double").alias(c) for c in ("f1", "auc_roc")])
    if promoted:
        store.promote(challenger, M.leaf_quantiles(challenger, train), waste)
        kind, message = "model_promoted", f"New model promoted: MAPE={new['mape']:.4f}"
        meta = F.to_json(F.struct(shown(new).alias("demand"), waste_shown.alias("waste")))
    else:
        kind, message = "retrain_completed", "Retrain completed but current model retained"
        meta = F.to_json(F.struct(shown(new).alias("new"), shown(current).alias("current")))
    append_alert(log, kind, "info", message, meta, now)
    return spark.range(1).select(
        F.lit(promoted).alias("promoted"), F.lit(store.current()).cast("int").alias("version"),
        *[shown(r)[c].alias(f"{n}_{c}") for n, r in (("new", new), ("current", current)) for c in MEASURES],
        waste_shown["f1"].alias("waste_f1"), waste_shown["auc_roc"].alias("waste_auc"),
        F.lit(kind).alias("alert_type"), F.lit(message).alias("message"))


def roll_back(store: ModelStore, log: MonthTable, now: Column, names: tuple[str, ...] = ("demand", "waste")) -> int | None:
    """Return to the version in use before, with an alert for each model; None if there is none."""
    was = store.current()
    version = store.roll_back()
    for name in names if version is not None else ():
        meta = F.struct(F.lit(name).alias("model_name"), F.lit(was).alias("from_version"), F.lit(version).alias("to_version"),
                        F.date_format(now.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("rolled_back_at"))
        append_alert(log, "model_rollback", "warning", f"Model '{name}' rolled back from v{was} to v{version}", F.to_json(meta), now)
    return version
