"""Hand-computed goldens: the 10-row series of FIXTURES.md §4 through F2..F7, L1, L2, V1."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from freshlane.operators import features as FE
from freshlane.operators import labels as L

SOLD = [10, 0, 12, 8, 15, 20, 18, 9, 11, 14]
WASTED = [0, 2, 0, 0, 0, 0, 3, 0, 0, 1]
PROMO = [0, 0, 1, 0, 0, 0, 1, 1, 0, 0]
ON_HAND = [30, 25, None, 40, 35, 20, 0, 22, 50, 18]
EXPIRY = [5, 4, None, 2, 1, 7, 6, 5, None, 3]
D0 = dt.date(2026, 1, 26)

# expected (before the median fill); None = NULL
EXP = {
    "day_of_week": [0, 1, 2, 3, 4, 5, 6, 0, 1, 2],
    "week_of_year": [5] * 7 + [6] * 3,
    "is_month_start": [0, 0, 0, 0, 0, 0, 1, 1, 1, 0],
    "is_month_end": [0, 0, 1, 1, 1, 1, 0, 0, 0, 0],
    "sales_lag_1d": [None, 10, 0, 12, 8, 15, 20, 18, 9, 11],
    "sales_lag_7d": [None] * 7 + [10, 0, 12],
    "inventory_lag_1d": [None, 30, 25, None, 40, 35, 20, 0, 22, 50],
    "sales_rolling_7d_mean": [None, 10, 5, 7.3333, 7.5, 9, 10.8333, 11.8571, 11.7143, 13.2857],
    "sales_rolling_7d_std": [None, None, 7.0711, 6.4291, 5.2599, 5.6569, 6.7651, 6.7436, 6.7999, 4.5356],
    "sales_rolling_7d_median": [None, 10, 5, 10, 9, 10, 11, 12, 12, 12],
    "waste_rolling_7d_sum": [None, 0, 2, 2, 2, 2, 2, 5, 5, 3],
    "waste_rolling_7d_rate": [0, 0, 0.2, 0.0909, 0.0667, 0.0444, 0.0308, 0.0602, 0.061, 0.0323],
    "days_since_last_promo": [999, 999, 0, 1, 2, 3, 0, 0, 1, 2],
    "stock_to_sales_ratio": [0, 2.5, 0, 5.4545, 4.6667, 2.2222, 0, 1.8554, 4.2683, 1.3548],
    "days_until_expiry_norm": [0.7143, 0.5714, None, 0.2857, 0.1429, 1, 0.8571, 0.7143, None, 0.4286],
}
LABEL_L1 = [1, 1, 1, 0, 0, 1, 1, 1, 1, 1]
LABEL_L2 = [1, 0, 0, 1, 1, 1, 1, 1, 1, 0]
V1 = [None] * 6 + [0.7143, 0.7143, 0.4286, 0.5714]


@pytest.fixture(scope="module")
def series(spark):
    rows = []
    for i in range(10):
        d = D0 + dt.timedelta(days=i)
        rows.append((1, 1, d, SOLD[i], Decimal("4.00") * SOLD[i], WASTED[i], 0, 50.0, False, bool(PROMO[i]),
                     0.1 if PROMO[i] else 0.0, 0))
    sales = spark.createDataFrame(rows, "store_id int, product_id int, date date, quantity_sold int, "
                                        "revenue decimal(14,2), units_wasted int, units_donated int, "
                                        "temperature_avg double, is_holiday boolean, is_promotion boolean, "
                                        "promotion_discount double, day_of_week int")
    inv = spark.createDataFrame(
        [(1, 1, D0 + dt.timedelta(days=i), ON_HAND[i], EXPIRY[i]) for i in range(10) if ON_HAND[i] is not None],
        "store_id int, product_id int, date date, quantity_on_hand int, days_until_expiry int")
    prods = spark.createDataFrame([(1, 1, Decimal("3.99"), Decimal("2.10"), 7)],
                                  "product_id int, category_id int, unit_price decimal(8,2), "
                                  "cost_price decimal(8,2), shelf_life_days int")
    return sales, inv, prods


def _col(df, c):
    return [r[0] for r in df.orderBy("date").select(c).collect()]


def test_feature_goldens(series):
    sales, inv, prods = series
    f = FE.build_features(sales, prods, inv, None, fill=False)
    assert f.count() == 10
    for c, exp in EXP.items():
        got = _col(f, c)
        for i, (g, e) in enumerate(zip(got, exp)):
            if e is None:
                assert g is None, (c, i, g)
            else:
                assert g is not None and abs(g - e) < 1e-4, (c, i, g, e)


def test_median_fill_goldens(series):
    sales, inv, prods = series
    f = FE.build_features(sales, prods, inv, None, fill=True)
    assert f.where(F.greatest(*[F.col(c).isNull().cast("int") for c in FE.FEATURE_COLUMNS]) > 0).count() == 0
    med = {"sales_lag_1d": 11, "sales_lag_7d": 10, "inventory_lag_1d": 27.5, "sales_rolling_7d_mean": 10,
           "sales_rolling_7d_std": 6.5864, "sales_rolling_7d_median": 10, "waste_rolling_7d_sum": 2,
           "days_until_expiry_norm": 0.6429}
    first = f.orderBy("date").first()
    assert abs(first["sales_lag_1d"] - med["sales_lag_1d"]) < 1e-4
    assert abs(first["sales_rolling_7d_std"] - med["sales_rolling_7d_std"]) < 1e-4
    row2 = f.orderBy("date").collect()[2]
    assert abs(row2["days_until_expiry_norm"] - med["days_until_expiry_norm"]) < 1e-4
    assert f.select("store_type_encoded").distinct().collect()[0][0] == 1.0


def test_label_goldens(series):
    sales, _, _ = series
    assert _col(L.waste_labels(sales), "waste_label") == LABEL_L1
    assert _col(L.waste_labels_forward(sales), "waste_label") == LABEL_L2


def test_v1_moving_average(series):
    from freshlane.plans.views import trailing_full_mean
    sales, _, _ = series
    got = _col(trailing_full_mean(sales, ["store_id"], "date", "units_wasted", 7), "ma")
    for g, e in zip(got, V1):
        assert (g is None and e is None) or abs(g - e) < 1e-4


def test_drift_features_are_the_fixed_list():
    from freshlane.config import DRIFT_FEATURES
    from freshlane.oracle.ops_sql import DRIFT_FEATURES as ORACLE
    want = ("sales_lag_1d", "sales_lag_7d", "sales_rolling_7d_mean", "sales_rolling_28d_mean",
            "waste_rolling_7d_rate", "stock_to_sales_ratio", "temperature_avg", "promotion_discount")
    assert DRIFT_FEATURES == want and tuple(ORACLE) == want


def test_cluster_without_shared_folder_is_an_error():
    import pytest

    from freshlane import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Fake())
    assert session.is_local("local[8]") and not session.is_local("local-cluster[3,2,1024]")


def test_new_files_are_seen(spark, tmp_path, sf_small):
    import os
    import shutil

    from freshlane.plans.context import Ctx
    folder = str(tmp_path / "sf")
    os.makedirs(folder)
    for t in ("region", "nation", "supplier", "part", "orders", "customer", "events"):
        shutil.copy(f"{sf_small}/{t}.parquet", folder)
    lines = spark.read.parquet(f"{sf_small}/lineitem.parquet").limit(2000)
    lines.limit(500).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    before = Ctx(spark, folder).daily_sales.agg({"quantity_sold": "sum"}).first()[0]
    lines.coalesce(1).write.mode("append").parquet(f"{folder}/lineitem.parquet")
    assert Ctx(spark, folder).daily_sales.agg({"quantity_sold": "sum"}).first()[0] > before
