"""Recommendation rule cases (FIXTURES.md §4) on hand-made inputs."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from freshlane.operators import rules as R

D = dt.date(2026, 1, 1)
SCHEMA = ("store_id int, product_id int, date date, product_name string, unit_price decimal(8,2), "
          "cost_price decimal(8,2), predicted_demand decimal(16,6), waste_risk_score decimal(16,6), "
          "current_stock int, days_until_expiry int")


def _run(spark, risk, demand, stock, price, cost, expiry):
    inp = spark.createDataFrame([(1, 1, D, "Milk", Decimal(price), Decimal(cost), Decimal(str(demand)),
                                  Decimal(str(risk)), stock, expiry)], SCHEMA)
    r = R.ranked_recommendations(R.action_impacts(R.action_candidates(inp)))
    return [(x["action"], x["waste_reduction_units"], float(x["revenue_impact_usd"]),
             float(x["waste_cost_saved_usd"]), float(x["confidence"]), x["priority"])
            for x in r.orderBy("priority").collect()]


def test_full_ranking(spark):
    got = _run(spark, 0.75, 20.5, 60, "4.00", "2.50", 3)
    assert got == [("adjust_order", 39, 0.0, 97.5, 0.79, 1), ("donate", 29, 0.0, 72.5, 0.83, 2),
                   ("markdown", 21, -21.0, 52.5, 0.70, 3), ("redistribute", 19, 0.0, 47.5, 0.61, 4),
                   ("bundle", 14, -8.4, 35.0, 0.57, 5)]


def test_tie_order_is_action_order(spark):
    got = _run(spark, 0.85, 10, 11, "4.00", "2.50", 1)
    assert [g[0] for g in got] == ["adjust_order", "markdown", "redistribute", "donate"]
    assert all(g[3] == 2.5 for g in got)
    assert got[1][2] == -2.0


def test_truncation_engine_vs_route(spark):
    got = _run(spark, 0.35, 3.5, 10, "6.00", "3.00", 7)
    assert got == [("adjust_order", 6, 0.0, 18.0, 0.61, 1), ("bundle", 1, -0.9, 3.0, 0.44, 2)]
    row = spark.range(1).select(R.engine_excess(F.lit(10), F.lit(3.5)).alias("e"),
                                R.route_excess(F.lit(10), F.lit(3.5)).alias("r")).first()
    assert (row["e"], row["r"]) == (6, 7)


def test_no_actions(spark):
    assert _run(spark, 0.10, 5, 50, "4.00", "2.50", 3) == []
    assert _run(spark, 0.80, 5, 5, "4.00", "2.50", 3) == []


@pytest.mark.parametrize("score,tier", [(0.2, "medium"), (0.5, "high"), (0.8, "critical"), (1.0, "critical"),
                                        (0.0, "low"), (1.5, "critical"), (-0.1, "critical")])
def test_tier_edges(spark, score, tier):
    from freshlane.functions.exprs import risk_tier
    assert spark.range(1).select(risk_tier(F.lit(score))).first()[0] == tier
