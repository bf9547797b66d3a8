"""Metric goldens: PSI, KS, AUC, average precision, MAPE (FIXTURES.md §4)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshlane.functions import quantiles as Qn
from freshlane.operators import evaluate as E
from freshlane.operators import monitor as M


def _long(spark, a, b):
    rows = [("x", "train", float(v)) for v in a] + [("x", "recent", float(v)) for v in b]
    return spark.createDataFrame(rows, "feature string, sample string, v double")


A = list(range(1, 11))
B = [6, 7, 8, 9, 10, 10, 10, 9, 8, 7]


def test_psi(spark):
    assert abs(M.psi(_long(spark, A, B)).first()["psi"] - 3.8817608695) < 1e-8


def test_ks(spark):
    r = M.ks(_long(spark, A, B)).first()
    assert abs(r["ks_statistic"] - 0.5) < 1e-12
    assert abs(r["p"] - 0.1640791977) < 1e-8


def _scores(spark):
    return spark.createDataFrame([("s", 1, 0.9), ("s", 0, 0.8), ("s", 1, 0.7), ("s", 1, 0.4), ("s", 0, 0.3)],
                                 "k string, label int, score double")


@pytest.mark.parametrize("step", [50_000, 1])
def test_auc_and_ap(spark, monkeypatch, step):
    monkeypatch.setattr(Qn, "STEP_VALUES", step)
    df = _scores(spark)
    assert abs(E.auc_roc(df, ["k"]).first()["auc_roc"] - 0.666667) < 1e-6
    assert abs(E.average_precision(df, ["k"]).first()["average_precision"] - 0.805556) < 1e-6


def test_mape_skips_zeros(spark):
    df = spark.createDataFrame([("a", 10.0, 12.0), ("a", 0.0, 5.0), ("a", 20.0, 18.0)], "g string, y double, p double")
    r = E.forecast_metrics(df, ["g"]).first()
    assert abs(r["mape"] - 0.15) < 1e-9
    assert abs(r["rmse"] - math.sqrt((4 + 25 + 4) / 3)) < 1e-6


def test_baselines(spark):
    df = spark.createDataFrame([("a", 10.0, 8.0, None), ("a", 20.0, 25.0, 10.0), ("a", 0.0, 1.0, 1.0)],
                               "g string, y double, lag1 double, lag7 double")
    r = E.baseline_mape(df, ["g"]).first()
    assert abs(r["naive_lag1_mape"] - (0.2 + 0.25) / 2) < 1e-6
    assert abs(r["naive_lag7_mape"] - 0.5) < 1e-6
    assert abs(r["moving_avg_mape"] - (0.2 + abs(20 - 17.5) / 20) / 2) < 1e-6


def test_ks_pvalue_edges(spark):
    r = spark.range(1).select(M.ks_pvalue(F.lit(0.0), F.lit(10.0), F.lit(10.0)).alias("p0"),
                              M.ks_pvalue(F.lit(1.0), F.lit(1000.0), F.lit(1000.0)).alias("p1")).first()
    assert r["p0"] == 1.0 and 0.0 <= r["p1"] < 1e-10
    _ = np
