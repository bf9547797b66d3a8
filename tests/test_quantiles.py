"""Distributed order statistics: few and many steps per range equal numpy."""

import numpy as np
import pytest

from freshlane.functions import quantiles as Qn


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in ("a", "b", "c"):
        vals = np.concatenate([rng.normal(size=700).round(2), np.full(400, 1.5)])  # a hot value
        rows += [(k, float(v)) for v in vals]
    rows += [("d", None), ("d", 3.0)]
    return spark.createDataFrame(rows, "k string, v double"), rows


@pytest.mark.parametrize("step", [50_000, 7])
def test_exact_percentiles(spark, data, monkeypatch, step):
    monkeypatch.setattr(Qn, "STEP_VALUES", step)
    df, rows = data
    got = {(r["k"], r["prob"]): r["value"] for r in Qn.exact_percentiles(df, ["k"], "v", [0.05, 0.5, 0.95]).collect()}
    for k in ("a", "b", "c", "d"):
        vals = np.array([v for kk, v in rows if kk == k and v is not None])
        for p in (0.05, 0.5, 0.95):
            assert abs(got[(k, p)] - np.percentile(vals, p * 100)) < 1e-9


@pytest.mark.parametrize("step", [50_000, 7])
def test_prefix_sums(spark, monkeypatch, step):
    monkeypatch.setattr(Qn, "STEP_VALUES", step)
    rows = [("g", float(i), i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o double, w int")
    out = {r["o"]: (r["cum_w"], r["prev_w"], r["all_w"]) for r in Qn.prefix_sums(df, ["k"], "o", ["w"]).collect()}
    run = 0
    tot = sum(i % 3 for i in range(500))
    for i in range(500):
        run += i % 3
        assert out[float(i)] == (run, run - i % 3, tot)
