"""What only large data reaches gives the same answers: many steps per range in the order
statistics, and quantities far beyond the fixture's."""

import pytest

import __spark_entry__ as E
from freshlane.functions import quantiles as Qn
from freshlane.oracle.compare import compare, duck_connection
from freshlane.session import get_session


@pytest.mark.parametrize("key", ["features_filled", "auc_roc", "average_precision", "ks_by_feature",
                                 "recs_priority_tiers"])
def test_bucketed_path_matches_oracle(spark, sf_small, monkeypatch, key):
    monkeypatch.setattr(Qn, "STEP_VALUES", 50)
    con = duck_connection(sf_small)
    status, ns, nd = compare(E.queries()[key](spark, sf_small), con, E.oracle_sql()[key])
    assert status in ("OK", "OK~tol"), (key, status, ns, nd)


def test_unmaterialized_plan_matches(spark, sf_small):
    """The pure-plan mode (no intermediate tables) gives the same daily_sales."""
    from freshlane.plans.context import Ctx
    a = Ctx(spark, sf_small).daily_sales
    b = Ctx(spark, sf_small, materialized=False).daily_sales
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    _ = get_session


def test_ratio_of_huge_integers(spark):
    from decimal import ROUND_HALF_UP, Decimal, localcontext

    from freshlane.functions.exprs import ratio6
    rows = [(9 * 10**17, 7), (-9 * 10**17, 10**17 + 1), (5 * 10**12, 3), (1, 3), (0, 5), (4, 0)]
    df = spark.createDataFrame(rows, "n long, d long")
    with localcontext() as c:
        c.prec = 60
        for r in df.select("n", "d", ratio6("n", "d").alias("q"), ).collect():
            want = None if r.d == 0 else float((Decimal(r.n) / r.d).quantize(Decimal("0.000001"), ROUND_HALF_UP))
            assert r.q == want


def test_ten_million_lines_per_series_day(spark):
    """Sums of ten million lines a day overflow neither the price change nor the feature store."""
    import datetime as dt

    from pyspark.sql import functions as F

    from freshlane.config import FEATURE_COLUMNS
    from freshlane.operators.extensions import ext_price_change
    from freshlane.operators.state import FEATURE_STORE_TYPES, feature_store_projection
    days = [dt.date(2025, 1, d) for d in (1, 2)]
    sales = spark.createDataFrame([(1, 1, days[0], 250_000_000, 9_000_000_000_00), (1, 1, days[1], 260_000_000, 9_100_000_000_00)],
                                  "store_id int, product_id int, date date, quantity_sold long, cents long")
    sales = sales.withColumn("revenue", (F.col("cents").cast("decimal(16,0)") / 100).cast("decimal(16,2)"))
    r = ext_price_change(sales).orderBy("date").collect()
    assert r[0].unit_price_realised == 36.0 and abs(r[1].price_change_pct - (910 / 900 * 250 / 260 - 1)) < 1e-6
    big = {"decimal": 4e10, "int": 1, "boolean": 0}
    row = sales.limit(1).select("store_id", "product_id", "date", *[
        F.lit(float(0.1 if c in ("margin_pct", "promotion_discount", "temperature_avg", "days_until_expiry_norm") else
                    100.0 if c in ("unit_price", "cost_price") else big[FEATURE_STORE_TYPES[c].split("(")[0]])).alias(c)
        for c in FEATURE_COLUMNS])
    assert float(feature_store_projection(row).first().revenue_rolling_7d) == 4e10
