"""What the operators share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACK_CHECKPOINT_DIR = "/tmp/checkpoints"
_scratches: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``.

    Only where that is unset (a session of one process) a local one is taken. A path without
    scheme is one of Hadoop's default file system, and is returned with its scheme.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or FALLBACK_CHECKPOINT_DIR
    if ":/" not in root:
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        root = f"{default.rstrip('/')}/{root.lstrip('/')}" if "://" in default.rstrip("/") else f"file:///{root.lstrip('/')}"
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if _scratches:
        _scratches[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the shared folders that are made inside, at its end. What is computed from
    them has to be written elsewhere before."""
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            remove(spark, path)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends at files
    that outlive executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of ``rows`` rows at most between Spark and Python, for what runs inside.

    For steps whose rows grow in Python; the session's own limit comes back at the end.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_or_empty(column: Column | str = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
