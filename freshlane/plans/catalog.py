"""Query registry: key -> callable(ctx) -> DataFrame.

``__spark_entry__.queries()`` wraps every entry as ``(spark, sf_dir) -> DataFrame``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freshlane.plans import dashboard as D
from freshlane.plans.context import Ctx

REGISTRY: dict[str, Callable[[Ctx], DataFrame]] = {}


def register(key: str, fn: Callable[[Ctx], DataFrame]) -> None:
    REGISTRY[key] = fn


# D1..D17
register("stores_list", D.stores_list)
register("categories_list", D.categories_list)
register("products_list", D.products_list)
register("date_range", D.date_range)
register("kpi_summary", D.kpi_summary)
register("daily_metrics", D.daily_metrics)
register("waste_by_category", D.waste_by_category)
register("top_wasted_products", D.top_wasted_products)
register("inventory_snapshot", D.inventory_snapshot)
register("demand_vs_prediction", D.demand_vs_prediction)
register("recommendations_recent", D.recommendations_recent)
register("product_sales", D.product_sales)
register("recent_alerts", D.recent_alerts)
register("feature_store_stats", D.feature_store_stats)
register("prediction_accuracy", D.prediction_accuracy)
register("store_comparison", D.store_comparison)
register("top_sellers", D.top_sellers)
# I1, I2
register("inventory_page", D.inventory_page)
register("inventory_total", D.inventory_total)


def _load_more() -> None:
    """Operator modules register their own keys on import."""
    import freshlane.plans.durable_queries
    import freshlane.plans.operator_queries
    import freshlane.plans.request_queries
    import freshlane.plans.views  # noqa: F401


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_more()

    def bind(fn):
        return lambda spark, sf_dir: fn(Ctx(spark, sf_dir))

    return {k: bind(fn) for k, fn in REGISTRY.items()}
