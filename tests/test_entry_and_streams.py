"""Driver contract and streaming == batch."""

import __spark_entry__ as E
from freshlane.oracle.compare import compare, duck_connection


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert set(["store_id", "product_id", "date", "action", "priority"]) <= set(df.columns)
    assert df.count() > 0


def test_streams_equal_batch(spark, sf_small):
    con = duck_connection(sf_small)
    for key in ("stream_site_visits", "stream_actuals", "stream_daily_metrics"):
        status, ns, nd = compare(E.queries()[key](spark, sf_small), con, E.oracle_sql()[key])
        assert status == "OK", (key, status, ns, nd)


def test_streams_over_shuffled_files(spark, sf_small, tmp_path):
    """Many files in any order, one a batch: the streams equal the batch results, beyond a compaction too."""
    import os
    import shutil

    from pyspark.sql import functions as F

    from freshlane.plans.context import Ctx
    from freshlane.streaming import streams as T
    folder = str(tmp_path / "sf")
    os.makedirs(folder)
    for t in ("region", "nation", "supplier", "part", "orders", "customer"):
        shutil.copy(f"{sf_small}/{t}.parquet", folder)
    for t, n in (("lineitem", 10), ("events", 4)):
        spark.read.parquet(f"{sf_small}/{t}.parquet").orderBy(F.rand(5)).repartition(n).write.parquet(f"{folder}/{t}.parquet")
    con = duck_connection(sf_small)
    ctx = Ctx(spark, sf_small)
    for key, start, read in (("stream_site_visits", T.site_visits, T.read_site_visits),
                             ("stream_actuals", T.actuals, T.read_actuals),
                             ("stream_daily_metrics", T.daily_metrics, T.read_daily_metrics)):
        out, ck = T.stream_dirs(spark, key)
        T.run_once(start(spark, folder, out, ck, max_files=1))
        got = read(spark, out)
        if key == "stream_site_visits":
            assert len(T._versions(spark, f"{out}/batch")) == 4
            got = got.withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))
        else:
            assert T._versions(spark, f"{out}/base") == [8]
        status, ns, nd = compare(got, con, E.oracle_sql()[key])
        assert status == "OK", (key, status, ns, nd)
        if key == "stream_actuals":
            p = T.read_predictions(spark, out, ctx.predictions)
            assert p.count() == ctx.predictions.count()
            newest = p.groupBy("store_id", "product_id", "date").agg(F.max_by("actual_demand", "created_at").alias("a"))
            assert newest.where("a IS NULL").count() == 0


def test_actuals_are_idempotent(spark, sf_small):
    """Applying the same actuals twice changes nothing."""
    from freshlane.operators.state import record_actuals
    from freshlane.plans.context import Ctx
    from pyspark.sql import functions as F
    ctx = Ctx(spark, sf_small)
    acts = ctx.daily_sales.select("store_id", "product_id", "date", F.col("quantity_sold").alias("actual_sold"))
    once = record_actuals(ctx.predictions, acts)
    twice = record_actuals(once, acts)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
