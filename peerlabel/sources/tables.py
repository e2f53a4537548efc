"""Reading feature tables through Spark's own sources."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingTable(LookupError):
    """The input table or path does not exist."""


def read_table(spark: SparkSession, source: str, format: str | None = None) -> DataFrame:
    """A catalog table, or a path when ``format`` is given; fails at once if missing."""
    if format is None:
        if not spark.catalog.tableExists(source):
            raise MissingTable(f"table {source} does not exist")
        return spark.read.table(source)
    try:
        return spark.read.format(format).load(source)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise MissingTable(f"nothing to read at {source}") from error
        raise


def parse_numbers(text: Column) -> Column:
    """``'1,2.5,3'`` to ARRAY<DOUBLE>; empty fields at the end are ignored."""
    return F.split(F.rtrim(text, F.lit(",")), ",").cast("array<double>")


def parse_features(
    rows: DataFrame, feature_col: str | int = 0, label_col: str | int = 1, as_vector: bool = False
) -> DataFrame:
    """Replace the two text columns by numeric ``features`` and DOUBLE ``label``.

    Columns may be given by name or by position; all others are kept.
    """
    feature_col, label_col = (
        rows.columns[c] if isinstance(c, int) else c for c in (feature_col, label_col)
    )
    numbers = parse_numbers(F.col(feature_col))
    kept = [c for c in rows.columns if c not in (feature_col, label_col)]
    return rows.select(
        *kept,
        (array_to_vector(numbers) if as_vector else numbers).alias("features"),
        F.col(label_col).cast("double").alias("label"),
    )


def read_feature_table(
    spark: SparkSession,
    source: str,
    format: str | None = None,
    feature_col: str | int = 0,
    label_col: str | int = 1,
    num_partitions: int = 0,
    as_vector: bool = False,
) -> DataFrame:
    """Read and parse a feature table; ``num_partitions`` 0 keeps the scan's own."""
    rows = parse_features(read_table(spark, source, format), feature_col, label_col, as_vector)
    return rows.repartition(num_partitions) if num_partitions > 0 else rows


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few driver-side rows as a table; collecting it starts no job."""
    types = {"INT": pa.int32(), "BIGINT": pa.int64(), "DOUBLE": pa.float64(), "BOOLEAN": pa.bool_()}
    fields = [column.split() for column in schema.split(", ")]
    arrays = [pa.array([r[i] for r in rows], types[kind]) for i, (_, kind) in enumerate(fields)]
    return spark.createDataFrame(pa.table(arrays, names=[name for name, _ in fields]), schema)

