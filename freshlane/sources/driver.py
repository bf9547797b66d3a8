"""Scan of the driver's Parquet tables (one file or folder per table).

Only the columns a job needs are selected, so the Parquet reader gets a
pruned ``ReadSchema`` and filters reach the scan as ``PushedFilters``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def table_path(sf_dir: str, name: str) -> str:
    p = os.path.join(sf_dir, f"{name}.parquet")
    return p if os.path.exists(p) or "://" in sf_dir else os.path.join(sf_dir, name)


def input_state(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple:
    """(table, files, bytes) of each table: changes when files arrive or go."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            s = fs.getContentSummary(path)
            out.append((name, s.getFileCount(), s.getLength()))
    return tuple(out)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df
