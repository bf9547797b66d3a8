"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshlane.session import is_local

#: Words are maximal runs of anything but space and the controls U+0009..U+000D (named one by one: a range is slower to match).
SPACE_RUN = r"[ \t\n\x0b\f\r]+"


def read_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(*columns) if columns else docs


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master without that setting gets a scratch folder of its own; a cluster
    without it is an error, since a machine-local folder would lose data there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="freshlane-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage durably.

    The table is removed when the application's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/freshlane-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words of a text; null and word-less texts give an empty array."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))


def packed_rows(docs: DataFrame) -> DataFrame:
    """``__row`` (all columns of ``docs``), doc_id, text: no column added later can clash with one of ``docs``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text")


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``packed_rows`` again, with some replaced."""
    return rows.select(*[changed.get(c, F.col(f"__row.`{c}`")).alias(c) for c in columns])


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow``; Python workers on this machine find this package wherever the session was started.

    A cluster gets the package as it gets any (installed, or with ``--py-files``).
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = df.sparkSession.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])
    return df.mapInArrow(function, schema)


def text_key(text: Column) -> Column:
    """16-byte identity of a text (null stays null); equal texts have equal keys."""
    return F.unhex(F.md5(text))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine (driver or executor)."""
    import public_tokenizers
    return os.fspath(public_tokenizers.path(name))
