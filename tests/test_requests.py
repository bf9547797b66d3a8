"""Posted lists, missing features and the vector that fitted models score, on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from freshlane.config import FEATURE_COLUMNS
from freshlane.operators import models as M
from freshlane.operators import requests as RQ
from freshlane.operators import rules as R
from freshlane.plans import dashboard as D
from freshlane.plans import views as V
from freshlane.plans.context import Ctx

POST = "post int, store_id int, product_id int, current_stock int, days_until_expiry int"


def test_lists_of_0_1_500_501_and_a_bad_request(spark):
    rows = [(1, 1, 1, 5, 3)] + [(2, 1, i + 1, 5, 3) for i in range(500)] + [(3, 1, i + 1, 5, 3) for i in range(501)]
    rows += [(4, 1, 1, 5, 3), (4, 0, 1, 5, 3), (4, 1, 1, -1, 3)]
    lists = spark.createDataFrame([(i,) for i in range(5)], "post int")
    ok, refused = RQ.list_validity(lists, spark.createDataFrame(rows, POST), ["post"])
    assert {r["post"]: r["count"] for r in ok.groupBy("post").count().collect()} == {1: 1, 2: 500}
    assert sorted(map(tuple, refused.collect())) == [
        (0, 0, 0, "fewer than 1"), (3, 501, 0, "more than 500"), (4, 3, 2, "current_stock < 0")]
    assert ok.columns == POST.replace(" int", "").split(", ")


def test_lists_without_requests_and_requests_without_lists(spark):
    empty = spark.createDataFrame([], POST)
    ok, refused = RQ.list_validity(spark.createDataFrame([(7,)], "post int"), empty, ["post"])
    assert ok.count() == 0 and [tuple(r) for r in refused.collect()] == [(7, 0, 0, "fewer than 1")]
    ok, refused = RQ.list_validity(empty.select("post"), spark.createDataFrame([(1, 1, 1, 5, 3)], POST), ["post"])
    assert ok.count() == 0 and refused.count() == 0


def test_served_or_missing(spark):
    asked = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (None, 1, "c")], "store_id int, product_id int, tag string")
    facts = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "store_id int, product_id int")
    got = RQ.served_or_missing(asked, facts, ["store_id", "product_id"]).select("tag", "found").collect()
    assert sorted(map(tuple, got)) == [("a", True), ("a", True), ("b", False), ("c", False)]


class _Shop:
    """Two products, of which store 2 sold one."""

    def __init__(self, spark):
        self.categories = spark.createDataFrame([(1, "Dairy", "high")], "category_id int, name string, perishability string")
        self.products = spark.createDataFrame(
            [(1, "Milk", 1, 2.0, 1.0, 7, "cold"), (2, "Oats", 1, 3.0, 2.0, 90, "dry")],
            "product_id int, name string, category_id int, unit_price double, cost_price double, shelf_life_days int, storage_temp string")
        d = dt.date(2026, 1, 1)
        self.daily_sales = spark.createDataFrame(
            [(1, 2, d, 9, 1, 27.0), (2, 1, d, 4, 0, 8.0), (2, 1, d + dt.timedelta(1), 5, 2, 10.0)],
            "store_id int, product_id int, date date, quantity_sold int, units_wasted int, revenue double")


def test_store_tables_keep_products_never_sold(spark):
    shop = _Shop(spark)
    sold = {r["product"]: r for r in D.product_sales(shop, 2).collect()}
    assert (sold["Milk"]["total_sold"], sold["Milk"]["avg_daily_sold"], sold["Milk"]["days_on_shelf"]) == (9, 4.5, 2)
    assert (sold["Oats"]["total_sold"], sold["Oats"]["total_revenue"], sold["Oats"]["days_on_shelf"]) == (None, None, 0)
    shown = {r["name"]: r for r in V.catalog(shop, 2).collect()}
    assert (shown["Oats"]["total_sold"], shown["Oats"]["total_revenue"], shown["Oats"]["avg_daily_sold"]) == (0, 0.0, 0.0)
    assert shown["Milk"]["total_wasted"] == 2


@pytest.fixture(scope="module")
def small(spark, sf_small):
    ctx = Ctx(spark, sf_small)
    few = M.ModelParams(gbt_iter=3, gbt_step=0.3, rf_trees=3, waste_iter=3, gbt_depth=3, rf_depth=3, interval_depth=2)
    train = ctx.ml["train"]
    return ctx, M.train_demand(train, few), M.train_waste(train, few)


def test_posted_stock_and_expiry_reach_the_fitted_models(spark, small):
    ctx, demand, waste = small
    requests = R.waste_requests(ctx)
    got = RQ.fitted_waste_report(requests, ctx.features, demand, waste)
    # the same vectors, built by hand from the nearest day and scored model by model
    vectors = RQ.posted_vectors(requests, ctx.features)
    one = vectors.where("matched_date = date").limit(30).alias("v").join(ctx.features.alias("f"), M.KEYS3)
    same = [c for c in FEATURE_COLUMNS if c not in ("days_until_expiry_norm", "stock_to_sales_ratio")]
    ratio = F.col("v.current_stock") / F.greatest(F.when(F.col("f.sales_rolling_7d_mean") != 0, F.col("f.sales_rolling_7d_mean"))
                                                  .otherwise(1.0), F.lit(0.1))
    wrong = one.where(F.greatest(*[F.abs(F.col(f"v.{c}") - F.coalesce(F.col(f"f.{c}").cast("double"), F.lit(0.0))) for c in same]) > 0)
    assert one.count() == 30 and wrong.count() == 0
    assert one.where(F.abs(F.col("v.stock_to_sales_ratio") - ratio) > 1e-9).count() == 0
    risk = M.score_waste(waste, vectors.select(*M.KEYS3, *FEATURE_COLUMNS)).withColumn("waste_risk_score", F.round("waste_risk_score", 3))
    cols = [*M.KEYS3, "waste_risk_score", "waste_risk_tier"]
    assert got.count() == vectors.count() > 0
    assert got.select(*cols).exceptAll(risk.select(*cols)).count() == 0
    r = got.agg(F.min("recommended_markdown_pct").alias("lo"), F.max("recommended_markdown_pct").alias("hi"),
                F.min("excess_stock").alias("ex"), F.min("predicted_demand").alias("d")).first()
    assert 0 <= r.lo <= r.hi <= 80 and r.ex >= 0 and r.d >= 0


def test_importances_are_ranked_by_value_then_name(small):
    ranked = M.feature_importance(small[1])
    assert [n for n, _ in ranked] == [n for n, _ in sorted(ranked, key=lambda t: (-t[1], t[0]))]
    assert sorted(n for n, _ in ranked) == sorted(FEATURE_COLUMNS) and abs(sum(v for _, v in ranked) - 1) < 1e-9
