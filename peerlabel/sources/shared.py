"""Tables that a running job keeps in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or FALLBACK_DIR
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back: its lineage ends at files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as a checkpoint: its lineage ends at files, its partitions and their order stay.

    Spark removes it with ``spark.cleaner.referenceTracking.cleanCheckpoints``, once it is unused."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(FALLBACK_DIR)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
