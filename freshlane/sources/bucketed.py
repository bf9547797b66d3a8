"""The facts of a series stored together, so that joins and windows over a series need no exchange.

Sales and snapshots lie in one table, bucketed by (store, product): a task reads whole series, the same-day join and all
windows run on what it has read, and only the sort inside a bucket is left. A daily load pays the one shuffle once.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from freshlane.operators.features import KEYS, series_rows
from freshlane.session import ensure_checkpoint_dir


def store_series(spark: SparkSession, sales: DataFrame, inventory: DataFrame, buckets: int, name: str | None = None,
                 path: str | None = None) -> str:
    """Write the table of both facts; returns its name in the session's catalog.

    ``buckets`` sets the tasks that later read it: series times rows over what a task should hold. The rows are dealt out
    by the same keys first, so that every bucket is one file.
    """
    name = name or f"series_{uuid.uuid4().hex[:12]}"
    path = path or os.path.join(ensure_checkpoint_dir(spark), "bucketed", name)
    rows = series_rows(sales, inventory)
    (rows.repartition(buckets, *KEYS).write.bucketBy(buckets, *KEYS).sortBy(*KEYS, "date", "_side")
     .option("path", path).format("parquet").saveAsTable(name))
    return name
