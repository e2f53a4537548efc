"""Ensemble scoring as column expressions over ``votes`` (members x classes).

A distribution is a list of C scalar columns. Scalars keep the arithmetic inside
whole-stage codegen; lambda functions over arrays would leave it. Every step is
its own projection, so later steps name earlier results instead of repeating
them. Beyond ``UNROLL_LIMIT`` votes per row the written-out sums would exceed
what the JIT compiler accepts in one method (8,000 bytes) and run interpreted, so
large groups take array functions instead.

"Undefined" is NULL throughout, never NaN, because Spark sorts NaN above every
number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINMAX = "minmax"
SUM = "sum"
UNROLL_LIMIT = 24


def hard_vote(predicted: Column, n_classes: int) -> Column:
    """One-hot distribution of a predicted class."""
    return F.array(*[(predicted == c).cast("double") for c in range(n_classes)])


def class_sums(n_members: int, n_classes: int, voters: Sequence[str] | None = None) -> list[Column]:
    """Sum ``votes`` class by class, of the members whose column in ``voters`` is true.

    The vote of a member that is left out is not looked at, whatever it holds.
    """

    def term(i: int, c: int) -> str:
        vote = f"votes[{i}][{c}]"
        return vote if voters is None else f"IF({voters[i]}, {vote}, 0D)"

    return [F.expr(" + ".join(term(i, c) for i in range(n_members))) for c in range(n_classes)]


def _class_sums_by_lambda(n_classes: int, voters: Sequence[Column] | None) -> Column:
    """The same as one array, for groups too large to write out."""
    votes = F.col("votes")
    zeros = F.array_repeat(F.lit(0.0), n_classes)
    if voters is not None:
        votes = F.zip_with(votes, F.array(*voters), lambda v, keep: F.when(keep, v).otherwise(zeros))
    # From the first vote on: an array of zeros could not hold a NULL sum.
    rest = F.slice(votes, F.lit(2), F.greatest(F.size(votes) - 1, F.lit(0)))
    return F.aggregate(rest, votes[0], lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))


def checked_vote(vote: Column, n_classes: int) -> Column:
    """A distribution as the sums need it: ``n_classes`` values, NaN turned into NULL.

    A NULL vote is one of NULLs; one of another length fails.
    """
    missing = F.lit(None).cast("double")
    values = F.array(*[F.nanvl(vote[c], missing) for c in range(n_classes)])
    wrong = F.raise_error(F.format_string(f"a vote has %d values, not {n_classes}", F.size(vote)))
    nothing = F.array(*[missing] * n_classes)
    return (
        F.when(vote.isNull(), nothing)
        .when(F.size(vote) == n_classes, values)
        .otherwise(wrong.cast("array<double>"))
    )


def all_but(k: Column, n_members: int) -> list[Column]:
    """Every member but ``k`` votes (summed directly, not total minus one)."""
    return [k != i for i in range(n_members)]


def out_of_bag_but(k: Column, bag: Column, n_members: int) -> list[Column]:
    """The members other than ``k`` that never drew the row vote."""
    return [(k != i) & (bag[i] == 0) for i in range(n_members)]


def scale_of(sums: Sequence[Column], normaliser: str, keep_zeros: bool = False) -> tuple[Column, Column]:
    """``(low, span)`` that turn a class sum x into ``(x - low) / span``.

    ``keep_zeros``: rows nobody voted on stay zero instead of undefined.
    """
    total = reduce(add, sums)
    if normaliser == MINMAX:
        low = F.least(*sums)
        span = F.greatest(*sums) - low
    elif normaliser == SUM:
        low, span = F.lit(0.0), total
    else:
        raise ValueError(f"unknown normaliser {normaliser!r}")
    return low, F.when(total == 0, F.lit(1.0)).otherwise(span) if keep_zeros else span


def scaled(sums: Sequence[Column], low: Column, span: Column) -> list[Column]:
    return [F.try_divide(x - low, span) for x in sums]


def normalise(sums: Sequence[Column], normaliser: str) -> list[Column]:
    """Scale class sums to a distribution; NULL where it is undefined."""
    return scaled(sums, *scale_of(sums, normaliser))


def confidence(dist: Sequence[Column]) -> Column:
    """Value of the winning class; NULL when the distribution is undefined."""
    return F.greatest(*dist)


def argmax(dist: Sequence[Column], top: Column, normaliser: str) -> Column:
    """Class whose value is ``top``, the lowest on ties.

    An undefined distribution (all classes tied) goes to the last class under
    min-max scaling and to the first under sum scaling.
    """
    winner = F.when(dist[0] == top, F.lit(0))
    for c in range(1, len(dist)):
        winner = winner.when(dist[c] == top, F.lit(c))
    return winner.otherwise(F.lit(len(dist) - 1 if normaliser == MINMAX else 0))


def is_confident(conf: Column, threshold: float) -> Column:
    known = F.nanvl(conf, F.lit(None).cast("double"))  # NaN sorts above every number
    return F.coalesce(known > F.lit(float(threshold)), F.lit(False))


def _stage(rows: DataFrame, prefix: str, columns: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"_{prefix}{i}" for i in range(len(columns))]
    return rows.withColumns(dict(zip(names, columns))), names


def with_decision(
    rows: DataFrame,
    n_members: int,
    n_classes: int,
    normaliser: str,
    voters: Sequence[Column] | None = None,
    keep_zeros: bool = False,
) -> DataFrame:
    """Append ``dist ARRAY<DOUBLE>``, ``confidence`` and ``decision`` to rows with ``votes``."""
    staged = rows
    if n_members * n_classes > UNROLL_LIMIT:
        staged = staged.withColumn("_sums", _class_sums_by_lambda(n_classes, voters))
        sums = [F.col("_sums")[c] for c in range(n_classes)]
    else:
        names = None
        if voters is not None:
            staged, names = _stage(staged, "w", voters)
        sums = class_sums(n_members, n_classes, names)
    staged, names = _stage(staged, "s", sums)
    sums = [F.col(name) for name in names]
    staged, (low, span) = _stage(staged, "scale", scale_of(sums, normaliser, keep_zeros))
    staged, names = _stage(staged, "d", scaled(sums, F.col(low), F.col(span)))
    dist = [F.col(name) for name in names]
    staged = staged.withColumn("confidence", confidence(dist))
    return staged.select(
        *rows.columns,
        F.array(*dist).alias("dist"),
        "confidence",
        argmax(dist, F.col("confidence"), normaliser).alias("decision"),
    )


def classify(rows: DataFrame, n_members: int, n_classes: int, normaliser: str) -> DataFrame:
    """Ensemble distribution, confidence and ``prediction`` of rows that carry ``votes``."""
    decided = with_decision(rows, n_members, n_classes, normaliser)
    return decided.withColumnRenamed("decision", "prediction")


def high_confidence(conf: Column, decision: Column, threshold: float) -> Column:
    """``(is_confident, label, confidence)``; label -1 and confidence 0 when refused."""
    sure = is_confident(conf, threshold)
    return F.struct(
        sure.alias("is_confident"),
        F.when(sure, decision).otherwise(F.lit(-1)).alias("label"),
        F.when(sure, conf).otherwise(F.lit(0.0)).alias("confidence"),
    )
