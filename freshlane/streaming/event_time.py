"""Event-time streams with bounded state that lose no row (T1, T3), and actuals applied exactly once.

Spark's stateful operators drop rows later than the watermark. A first stream therefore deals every batch into rows
on time and late rows by the same rule (the greatest event time of earlier batches less the delay) and keeps the late
ones as a table. The second stream reads the rows on time; its watermark never passes the first one's, so it drops
nothing, and its state is evicted as windows close. Results join closed windows, the rows of windows still open, and
late rows.

Folders of a stream under ``out``: ``rows/batch=<i>/late=<bool>`` (moved into place complete; a replayed batch that is
there is skipped), ``seen/<i>`` (greatest event time up to batch i), and ``result`` (the second stream's file sink).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from freshlane.operators import durable as D
from freshlane.operators.state import site_visit_normalize
from freshlane.sources.monthly import MonthTable, months_of
from freshlane.sources.retail import Retail, visit_posts
from freshlane.streaming.streams import file_stream, first_visits, run_once, sum_actuals

TIME = "event_time"


def _fs(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _seen_before(spark: SparkSession, out: str, batch_id: int):
    """Greatest event time of the batches before, None before the first."""
    fs, path = _fs(spark, out)
    names = [s.getPath().getName() for s in fs.listStatus(path(f"{out}/seen"))] if fs.exists(path(f"{out}/seen")) else []
    known = [int(n) for n in names if n.isdigit() and int(n) < batch_id]
    return spark.read.parquet(f"{out}/seen/{max(known)}").first()["top"] if known else None


def deal(out: str, batch: DataFrame, batch_id: int, delay_seconds: int) -> None:
    """One batch into ``rows``: late are rows whose time lies before what earlier batches have seen, less the delay."""
    spark = batch.sparkSession
    fs, path = _fs(spark, out)
    place, fresh = path(f"{out}/rows/batch={batch_id}"), path(f"{out}/_fresh/batch={batch_id}")
    if fs.exists(place):
        return
    seen = _seen_before(spark, out, batch_id)
    late = F.col(TIME).isNull()                 # no window could take it
    if seen is not None:
        late = late | (F.col(TIME) < F.timestamp_micros(F.lit(int(seen) - delay_seconds * 1_000_000)))
    batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(fresh.toString())
    top = spark.read.schema(batch.schema).parquet(fresh.toString()).agg(F.max(F.unix_micros(TIME)).alias("top")).first()["top"]
    known = [t for t in (seen, top) if t is not None]
    if known and not fs.exists(path(f"{out}/seen/{batch_id}")):
        spark.range(1).select(F.lit(max(known)).cast("long").alias("top")).write.mode("overwrite").parquet(f"{out}/_seen/{batch_id}")
        fs.mkdirs(path(f"{out}/seen"))
        fs.rename(path(f"{out}/_seen/{batch_id}"), path(f"{out}/seen/{batch_id}"))
    fs.mkdirs(path(f"{fresh.toString()}/late=false"))       # the second stream needs a folder, if an empty one
    fs.mkdirs(path(f"{out}/rows"))
    if not fs.rename(fresh, place):
        raise IOError(f"{place} could not be moved into place")


def dealt_stream(rows: DataFrame, out: str, ckpt: str, delay_seconds: int, once: bool = True) -> StreamingQuery:
    """The first stream, over ``rows`` with a timestamp column ``event_time``."""
    w = rows.writeStream.foreachBatch(lambda b, i: deal(out, b, i, delay_seconds)).option("checkpointLocation", f"{ckpt}/deal")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()


def on_time(spark: SparkSession, out: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(f"{out}/rows/*/late=false")


def dealt(spark: SparkSession, out: str, schema: StructType, late: bool) -> DataFrame:
    """The rows on time or the late rows so far, as a table."""
    fs, path = _fs(spark, out)
    found = fs.globStatus(path(f"{out}/rows/*/late={str(late).lower()}"))
    paths = [s.getPath().toString() for s in found or []]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _sink(result: DataFrame, out: str, ckpt: str, once: bool) -> StreamingQuery:
    w = result.writeStream.format("parquet").outputMode("append").option("path", f"{out}/result").option(
        "checkpointLocation", f"{ckpt}/result")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()


# ---- T3: sums per store and day


def sales_events(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """Sales lines with their day as event time, as a stream."""
    lines = Retail(spark, sf_dir).sales_lines(file_stream(spark, sf_dir, "lineitem", max_files))
    return lines.select("store_id", F.col("date").cast("timestamp").alias(TIME), F.col("q").cast("long").alias("sold"),
                        F.col("rev").cast("long").alias("revenue_units"), F.col("w").cast("long").alias("wasted"))


def day_sums(rows: DataFrame, day: Column) -> DataFrame:
    return rows.groupBy("store_id", day.alias("day")).agg(
        F.count(F.lit(1)).alias("lines"), *[F.sum(c).alias(c) for c in ("sold", "revenue_units", "wasted")])


def day_windows(rows: DataFrame, delay_seconds: int) -> DataFrame:
    """Closed days only: a day is put out once, when the watermark passes its end, and leaves the state then."""
    marked = rows.withWatermark(TIME, f"{delay_seconds} seconds")
    return day_sums(marked, F.window(TIME, "1 day")).select("store_id", F.col("day.start").alias("start"), F.col("day.end").alias("end"),
                                                          "lines", "sold", "revenue_units", "wasted")


def run_day_windows(spark: SparkSession, rows: DataFrame, out: str, ckpt: str, delay_seconds: int,
                    max_files: int | None = None) -> StreamingQuery:
    """T3 over the files present; the second stream, ended (its progress shows the state)."""
    run_once(dealt_stream(rows, out, ckpt, delay_seconds))
    query = _sink(day_windows(on_time(spark, out, rows.schema, max_files), delay_seconds), out, ckpt, True)
    run_once(query)
    return query


def read_day_windows(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """store_id, date, lines, sold, revenue_units, wasted, late_lines: closed days, open days and late rows together.

    Closed days end at or before the last end that was put out; rows on time from there on belong to open days.
    """
    closed = spark.read.schema("store_id int, start timestamp, `end` timestamp, lines long, sold long, revenue_units long, wasted long"
                               ).parquet(f"{out}/result")
    ended = closed.agg(F.max("end").alias("e")).select("e").scalar()
    rows = dealt(spark, out, schema, late=False).where(ended.isNull() | (F.col(TIME) >= ended))
    sums = ("lines", "sold", "revenue_units", "wasted")
    parts = [closed.select("store_id", F.col("start").cast("date").alias("date"), *sums, F.lit(0).cast("long").alias("late_lines"))]
    for found, late in ((rows, False), (dealt(spark, out, schema, late=True), True)):
        s = day_sums(found, F.to_date(TIME))
        parts.append(s.select("store_id", F.col("day").alias("date"), *sums, (F.col("lines") if late else F.lit(0).cast("long")).alias("late_lines")))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("store_id", "date").agg(*[F.sum(c).alias(c) for c in (*sums, "late_lines")])


# ---- T1: visits without repeated posts
def visit_events(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    visits = site_visit_normalize(visit_posts(file_stream(spark, sf_dir, "events", max_files)))
    return visits.withColumn(TIME, F.col("received_at").cast("timestamp"))


def run_visits(spark: SparkSession, rows: DataFrame, out: str, ckpt: str, delay_seconds: int,
               max_files: int | None = None) -> StreamingQuery:
    """Posts that repeat a post on time (same visit, arrival and payload) are dropped with state that the watermark
    bounds; what it cannot know, later repeats and other arrivals of a visit, is settled by key when the table is read."""
    run_once(dealt_stream(rows, out, ckpt, delay_seconds))
    fresh = on_time(spark, out, rows.schema, max_files).withWatermark(TIME, f"{delay_seconds} seconds")
    query = _sink(fresh.dropDuplicatesWithinWatermark(["visit_id", "received_at", "payload_json"]), out, ckpt, True)
    run_once(query)
    return query


def read_visits(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    found = spark.read.schema(schema).parquet(f"{out}/result").unionByName(dealt(spark, out, schema, late=True))
    return first_visits(found.drop(TIME))


# ---- T2: actuals into predictions
def apply_batch(batch: DataFrame, batch_id: int, totals: MonthTable, predictions: MonthTable, staged: str, source: str = "actuals") -> None:
    """Add the batch to the running daily actuals and give them to the newest predictions of its keys (I4).

    Both tables remember the batch number, so a batch that is replayed, whole or after a failure between the two
    commits, ends in the same tables.
    """
    spark = batch.sparkSession
    if batch_id <= predictions.done(source):
        return
    sum_actuals(batch).write.mode("overwrite").parquet(f"{staged}/{batch_id}")      # read several times below
    sums = spark.read.parquet(f"{staged}/{batch_id}")
    D.add_actuals(totals, sums, source, batch_id)
    keys = ["store_id", "product_id", "date"]
    D.apply_actuals(predictions, totals.read(months_of(sums)).join(sums.select(*keys), keys, "left_semi"), source, batch_id)


def run_actuals(spark: SparkSession, sf_dir: str, totals: MonthTable, predictions: MonthTable, ckpt: str,
                max_files: int | None = None, once: bool = True) -> StreamingQuery:
    """Sales lines as they arrive, into the running actuals and the stored predictions."""
    lines = Retail(spark, sf_dir).sales_lines(file_stream(spark, sf_dir, "lineitem", max_files))
    rows = lines.select("store_id", "product_id", "date", F.col("q").cast("long").alias("q"))
    w = rows.writeStream.foreachBatch(lambda b, i: apply_batch(b, i, totals, predictions, f"{ckpt}/staged")).option(
        "checkpointLocation", f"{ckpt}/source")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()


TOTALS = "store_id int, product_id int, date date, q long"


def totals_table(spark: SparkSession, root: str) -> MonthTable:
    return MonthTable(spark, root, StructType.fromDDL(TOTALS))
