"""Reproducible random splits by row id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlabel.functions.hashing import uniform

LABELLED, UNLABELLED, TEST = "labelled", "unlabelled", "test"
TENTH = {LABELLED: 0.1, UNLABELLED: 0.9}
TENTH_AND_TEST = {LABELLED: 0.08, UNLABELLED: 0.72, TEST: 0.2}


def boundaries(weights: dict[str, float]) -> list[tuple[str, float]]:
    """Upper bound of each part's range in [0, 1]; weights are scaled to sum 1."""
    total = sum(weights.values())
    if total <= 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative and must not all be zero")
    upper, bounds = 0.0, []
    for name, weight in weights.items():
        upper += weight
        bounds.append((name, round(upper / total, 12)))
    return bounds


def with_part(rows: DataFrame, weights: dict[str, float], seed: int = 1, row_id: str = "row_id") -> DataFrame:
    """Append ``part``: the name of the range the row's uniform falls into."""
    bounds = boundaries(weights)
    u = uniform(F.col(row_id), f"{seed}:split")
    staged = rows.withColumn("_u", u)
    part = F.lit(bounds[-1][0])
    for name, upper in reversed(bounds[:-1]):
        part = F.when(F.col("_u") < upper, F.lit(name)).otherwise(part)
    return staged.withColumn("part", part).drop("_u")


def part_of(rows: DataFrame, part: str, drop_label: bool = False) -> DataFrame:
    """One part of a split table, without its label if asked."""
    drops = ["part"] + (["label"] if drop_label else [])
    return rows.filter(F.col("part") == part).drop(*drops)


def part_sizes(rows: DataFrame) -> DataFrame:
    """Row count of every part, in one aggregation."""
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"))
