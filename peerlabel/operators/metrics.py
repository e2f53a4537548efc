"""Error rates of scored tables (``label`` and ``prediction``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def error_rate(scored: DataFrame) -> DataFrame:
    """``(n_rows, wrong, error)`` over the whole table."""
    wrong = (F.col("label") != F.col("prediction")).cast("bigint")
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(wrong), F.lit(0)).alias("wrong")
    ).withColumn("error", F.try_divide(F.col("wrong").cast("double"), F.col("n_rows")))


def error_by_class(scored: DataFrame) -> DataFrame:
    """Per true class, its errors and their share of *all* rows.

    The total is taken from the class counts, which number at most C.
    """
    wrong = (F.col("label") != F.col("prediction")).cast("bigint")
    per_class = scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(wrong).alias("wrong")
    )
    whole = per_class.agg(
        F.sum("n_rows").alias("total"), F.collect_list(F.struct("label", "n_rows", "wrong")).alias("classes")
    )
    return whole.select("total", F.inline("classes")).select(
        "label", "n_rows", "wrong", (F.col("wrong") / F.col("total")).alias("error_share")
    )
