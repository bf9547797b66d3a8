"""freshlane — perishable-goods retail demand and waste analytics on Spark.

Everything is DataFrame / SQL expressions over Parquet:

* ``sources``    driver Parquet -> retail tables (stores, products, daily_sales, ...)
* ``functions``  reusable Column expressions and distributed order statistics
* ``operators``  features, labels, as-of lookups, scoring, rules, metrics, drift, quality
* ``plans``      dashboard / view / inventory queries and the query registry
* ``streaming``  Structured Streaming jobs
* ``oracle``     independent DuckDB SQL used as the correctness oracle
"""

from freshlane.config import Config, FEATURE_COLUMNS  # noqa: F401
from freshlane.session import get_session  # noqa: F401
