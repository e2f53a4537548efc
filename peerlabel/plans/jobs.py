"""Whole jobs: split, train, score."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlabel.config import CoTrainConfig
from peerlabel.functions import voting
from peerlabel.operators import metrics
from peerlabel.operators.members import Member, with_votes
from peerlabel.plans.cotrain import CoTrainResult, cotrain
from peerlabel.sources import splits


@dataclass
class JobReport:
    result: CoTrainResult
    test: DataFrame

    def scored_test(self) -> DataFrame:
        return self.result.score(self.test)

    def test_errors(self) -> DataFrame:
        """Test error of the first ensemble and of the last one, in one pass."""
        first = self.result.score(self.test, self.result.first_voters)
        first = first.withColumn("first", F.col("prediction") != F.col("label"))
        last = self.result.score(first.drop("prediction", "confidence"))
        last = last.withColumn("last", F.col("prediction") != F.col("label"))
        stages = ("first", "last")
        counts = last.agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.coalesce(F.sum(F.col(s).cast("bigint")), F.lit(0)).alias(s) for s in stages],
        )
        per_stage = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("wrong")) for s in stages])
        return counts.select("n_rows", F.inline(per_stage)).select(
            "stage",
            "n_rows",
            "wrong",
            F.try_divide(F.col("wrong").cast("double"), F.col("n_rows")).alias("error"),
        )


Featurise = Callable[[DataFrame], DataFrame]


def _report(result: CoTrainResult, test: DataFrame, featurise: Featurise | None) -> JobReport:
    return JobReport(result, featurise(test) if featurise else test)


def cotrain_split(
    rows: DataFrame,
    members: Sequence[Member],
    config: CoTrainConfig,
    weights: dict[str, float] | None = None,
    featurise: Featurise | None = None,
    test: DataFrame | None = None,
) -> JobReport:
    """Hide most labels of a fully labelled table, co-train, keep a test part.

    With a ``test`` table of its own, ``rows`` is only split into labelled and unlabelled
    ones. ``featurise`` as in :func:`cotrain`; ``test`` goes through it as well.
    """
    weights = weights or (splits.TENTH_AND_TEST if test is None else splits.TENTH)
    parts = splits.with_part(rows, weights, config.seed)
    result = cotrain(
        splits.part_of(parts, splits.LABELLED),
        splits.part_of(parts, splits.UNLABELLED, drop_label=True),
        members,
        config,
        featurise,
    )
    return _report(result, splits.part_of(parts, splits.TEST) if test is None else test, featurise)


def cotrain_partly_labelled(
    rows: DataFrame,
    members: Sequence[Member],
    config: CoTrainConfig,
    test_share: float = 0.2,
    featurise: Featurise | None = None,
    test: DataFrame | None = None,
) -> JobReport:
    """Co-train on a table whose label is NULL where it was never annotated.

    Tested on ``test``, or on ``test_share`` of the annotated rows.
    """
    if test is None:
        parts = splits.with_part(rows, {"train": 1 - test_share, splits.TEST: test_share}, config.seed)
        rows, test = splits.part_of(parts, "train"), splits.part_of(parts, splits.TEST)
    result = cotrain(
        rows.filter(F.col("label").isNotNull()),
        rows.filter(F.col("label").isNull()).drop("label"),
        members,
        config,
        featurise,
    )
    return _report(result, test.filter(F.col("label").isNotNull()), featurise)


def supervised_baseline(
    rows: DataFrame,
    member: Member,
    n_classes: int,
    weights: dict[str, float] = splits.TENTH_AND_TEST,
    seed: int = 1,
    test: DataFrame | None = None,
) -> DataFrame:
    """Test error of one learner trained on every training row's true label.

    With a ``test`` table of its own, all of ``rows`` is for training.
    """
    if test is None:
        parts = splits.with_part(rows, weights, seed)
        rows, test = parts.filter(F.col("part") != splits.TEST), splits.part_of(parts, splits.TEST)
    voter = member.fit(rows.withColumn("weight", F.lit(1.0)))
    voted = with_votes(test, [voter], n_classes)
    return metrics.error_rate(voting.classify(voted, 1, n_classes, voting.SUM))
