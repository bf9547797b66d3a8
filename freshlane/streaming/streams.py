"""Structured Streaming jobs (T1..T3).

The reference receives visits and actuals as HTTP posts and refreshes its
daily totals on a timer; here they are streams over the arriving Parquet
files. Each job takes an output folder and a checkpoint folder (both on
shared storage), so a restarted job resumes exactly where it stopped.

Files arrive in any order, so nothing here relies on event time and no row is ever late: each
micro-batch writes its partial result under its ``batch_id`` (overwriting it on a replay), and the
result is the merge of all partials by key, which does not depend on their order. Every
``COMPACT_EVERY`` batches the partials so far are merged into one base table, so a reader scans a
base and a bounded number of partials.

* T1 ``site_visits``: normalise (S10), keep the earliest arrival of a visit_id.
* T2 ``actuals``: daily actuals are sums over batches; ``read_predictions`` applies I4 with them.
* T3 ``daily_metrics``: sums per store, product and day.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from freshlane.operators.state import site_visit_normalize, update_with_actuals
from freshlane.session import ensure_checkpoint_dir
from freshlane.sources.driver import table_path
from freshlane.sources.retail import Retail, visit_posts


def file_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None = None) -> DataFrame:
    """A streaming read of one driver table (schema from the files, no inference per batch)."""
    path = table_path(sf_dir, table)
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if os.path.isdir(path):
        return r.parquet(path)
    return r.option("basePath", os.path.dirname(path)).parquet(path + "*")


def stream_dirs(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh (output, checkpoint) folders under the shared checkpoint directory."""
    base = os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")
    return os.path.join(base, "out"), os.path.join(base, "checkpoint")


COMPACT_EVERY = 8


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers n of the complete tables ``folder``/n."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [s.getPath().getName() for s in fs.listStatus(path)
            if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n) for n in done if n.isdigit())


def merged(spark: SparkSession, out: str, combine, before: int | None = None) -> DataFrame | None:
    """All batches (those below ``before``) merged by ``combine``; None without any."""
    batches = [n for n in _versions(spark, f"{out}/batch") if before is None or n < before]
    bases = [n for n in _versions(spark, f"{out}/base") if before is None or n <= before]
    base = bases[-1] if bases else 0            # holds the batches below its number
    parts = [spark.read.parquet(f"{out}/batch/{n}") for n in batches if n >= base]
    if bases:
        parts.insert(0, spark.read.parquet(f"{out}/base/{base}"))
    if not parts:
        return None
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return combine(whole)


def write_partial(out: str, batch: DataFrame, batch_id: int, combine) -> None:
    """Write one batch's partial; after every COMPACT_EVERY batches also the merged base. Replays write the same."""
    spark = batch.sparkSession
    combine(batch).write.mode("overwrite").parquet(f"{out}/batch/{batch_id}")
    if (batch_id + 1) % COMPACT_EVERY == 0:
        merged(spark, out, combine, batch_id + 1).write.mode("overwrite").parquet(f"{out}/base/{batch_id + 1}")


def _start(rows: DataFrame, out: str, ckpt: str, once: bool, combine) -> StreamingQuery:
    w = (rows.writeStream.foreachBatch(lambda batch, i: write_partial(out, batch, i, combine))
         .option("checkpointLocation", ckpt))
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()


def _result(spark: SparkSession, out: str, combine) -> DataFrame:
    """The merged table; before the first batch an error, as for any missing table."""
    found = merged(spark, out, combine)
    if found is None:
        raise FileNotFoundError(f"no batch has been written to {out}")
    return found


def first_visits(visits: DataFrame) -> DataFrame:
    """One row per visit_id: its earliest arrival (ties: the smallest payload)."""
    rest = [c for c in visits.columns if c != "visit_id"]
    first = F.min(F.struct("received_at", "payload_json", *[c for c in rest if c not in ("received_at", "payload_json")]))
    return visits.groupBy("visit_id").agg(first.alias("v")).select("visit_id", *[F.col(f"v.{c}").alias(c) for c in rest])


def site_visits(spark: SparkSession, sf_dir: str, out: str, ckpt: str, once: bool = True,
                max_files: int | None = None) -> StreamingQuery:
    """T1."""
    visits = site_visit_normalize(visit_posts(file_stream(spark, sf_dir, "events", max_files)))
    return _start(visits, out, ckpt, once, first_visits)


def read_site_visits(spark: SparkSession, out: str) -> DataFrame:
    return _result(spark, out, first_visits)


def sum_actuals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("store_id", "product_id", "date").agg(F.sum("q").alias("q"))


def actuals(spark: SparkSession, sf_dir: str, out: str, ckpt: str, once: bool = True,
            max_files: int | None = None) -> StreamingQuery:
    """Daily actuals."""
    lines = Retail(spark, sf_dir).sales_lines(file_stream(spark, sf_dir, "lineitem", max_files))
    return _start(lines.select("store_id", "product_id", "date", F.col("q").cast("long").alias("q")), out, ckpt, once, sum_actuals)


def read_actuals(spark: SparkSession, out: str) -> DataFrame:
    return _result(spark, out, sum_actuals).select("store_id", "product_id", "date", F.col("q").alias("actual_sold"))


def read_predictions(spark: SparkSession, out: str, predictions: DataFrame) -> DataFrame:
    """``predictions`` after I4's update with all streamed actuals."""
    return update_with_actuals(predictions, read_actuals(spark, out))


def sum_metrics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("store_id", "product_id", "date").agg(
        F.sum("q").alias("q"), F.sum("rev").alias("rev"), F.sum("w").alias("w"))


def daily_metrics(spark: SparkSession, sf_dir: str, out: str, ckpt: str, once: bool = True,
                  max_files: int | None = None) -> StreamingQuery:
    """Per store, product and day: sold, revenue, wasted."""
    lines = Retail(spark, sf_dir).sales_lines(file_stream(spark, sf_dir, "lineitem", max_files))
    rows = lines.select("store_id", "product_id", "date", F.col("q").cast("long").alias("q"), F.col("rev").cast("long").alias("rev"),
                        F.col("w").cast("long").alias("w"))
    return _start(rows, out, ckpt, once, sum_metrics)


def read_daily_metrics(spark: SparkSession, out: str) -> DataFrame:
    """Rolled up to (store, day) like the batch daily metrics (revenue in whole cents)."""
    from freshlane.functions.exprs import idiv
    d = _result(spark, out, sum_metrics).groupBy("store_id", "date").agg(
        F.sum("q").alias("sold"), F.sum(idiv(F.col("rev"), F.lit(100))).alias("cents"), F.sum("w").alias("wasted"))
    return d.select("store_id", "date", F.col("sold").cast("long"),
                    (F.col("cents").cast("decimal(20,0)") / 100).cast("double").alias("revenue"),
                    F.col("wasted").cast("long"))


def run_once(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()

