"""One co-training round: errors, pseudo-labels and training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlabel.config import CoTrainConfig
from peerlabel.functions import voting
from peerlabel.functions.exact import exact_sum
from peerlabel.operators.bags import each_member

ENSEMBLE = -1


def out_of_bag_decisions(rows: DataFrame, config: CoTrainConfig, ks: list[int] | None = None) -> DataFrame:
    """``rows`` (with ``bag`` and ``votes``) once per member ``k``, judged by the other
    members that did not train on the row."""
    ks = list(range(config.n_members)) if ks is None else ks
    voters = voting.out_of_bag_but(F.col("k"), F.col("bag"), config.n_members)
    return voting.with_decision(
        each_member(rows, ks),
        config.n_members,
        config.n_classes,
        config.normaliser,
        voters,
        keep_zeros=True,
    )


def labelled_errors(rows: DataFrame, config: CoTrainConfig, weight_col: str | None = None) -> DataFrame:
    """Out-of-bag error of every member and training error of the ensemble, in one pass.

    ``(k, counted, wrong, missed, n_rows)``; ``k`` = ``ENSEMBLE`` is the whole group,
    where every member votes on every row. Rows are combined before the shuffle,
    which carries K + 1 groups per task. With ``weight_col``, ``counted`` and ``wrong`` are
    exact sums of weights, DOUBLE; with weights of 1 their quotient is the same.
    """
    k = F.col("k")
    voters = [(k == ENSEMBLE) | ((k != i) & (F.col("bag")[i] == 0)) for i in range(config.n_members)]
    judged = voting.with_decision(
        each_member(
            rows.select("label", "bag", "votes", *([weight_col] if weight_col else [])), [ENSEMBLE, *range(config.n_members)]
        ),
        config.n_members,
        config.n_classes,
        config.normaliser,
        voters,
        keep_zeros=True,
    )
    counted = voting.is_confident(F.col("confidence"), config.threshold)
    missed = F.col("decision") != F.col("label")

    def size(rows_of: Column) -> Column:
        if weight_col is None:
            return F.sum(rows_of.cast("bigint"))
        return exact_sum(F.when(rows_of, F.col(weight_col).cast("double")).otherwise(0.0))

    return judged.groupBy("k").agg(
        size(counted).alias("counted"),
        size(counted & missed).alias("wrong"),
        F.sum(missed.cast("bigint")).alias("missed"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def out_of_bag_errors(errors: DataFrame) -> DataFrame:
    """``(k, counted, wrong, err)``; ``err`` is NULL when no row is counted."""
    err = F.try_divide(F.col("wrong").cast("double"), F.col("counted"))
    return errors.filter(F.col("k") != ENSEMBLE).select("k", "counted", "wrong", err.alias("err"))


def training_error(errors: DataFrame) -> DataFrame:
    """``(n_rows, missed, train_error)`` of the whole ensemble on the labelled rows."""
    error = F.try_divide(F.col("missed").cast("double"), F.col("n_rows"))
    return errors.filter(F.col("k") == ENSEMBLE).select("n_rows", "missed", error.alias("train_error"))


def leave_one_out_decisions(rows: DataFrame, config: CoTrainConfig, ks: list[int] | None = None) -> DataFrame:
    """``rows`` (with ``votes``) once per member ``k``, judged by all other members."""
    ks = list(range(config.n_members)) if ks is None else ks
    voters = voting.all_but(F.col("k"), config.n_members)
    return voting.with_decision(
        each_member(rows, ks), config.n_members, config.n_classes, config.normaliser, voters
    )


def _pseudo_labelled(judged: DataFrame, config: CoTrainConfig) -> DataFrame:
    # A one-or-none explode, not a filter: the optimiser would push a filter on the
    # confidence below the steps that compute it and evaluate all of them twice.
    sure = voting.is_confident(F.col("confidence"), config.threshold)
    label = F.struct(F.col("decision").alias("pseudo_label"), "confidence")
    kept = [c for c in judged.columns if c not in ("drawn", "votes", "dist", "confidence", "decision")]
    labelled = judged.select(*kept, F.explode(F.when(sure, F.array(label))).alias("_label"))
    return labelled.select(*kept, "_label.*")


def pseudo_labels(sampled: DataFrame, config: CoTrainConfig, ks: list[int]) -> DataFrame:
    """Confident rows of each member's draw: ``(..., k, pseudo_label, confidence)``.

    ``sampled`` carries ``drawn`` and ``votes``.
    """
    mine = each_member(sampled, ks).filter(F.col("drawn")[F.col("k")])
    voters = voting.all_but(F.col("k"), config.n_members)
    judged = voting.with_decision(mine, config.n_members, config.n_classes, config.normaliser, voters)
    return _pseudo_labelled(judged, config)


def pseudo_labels_of(sampled: DataFrame, config: CoTrainConfig, k: int) -> DataFrame:
    """As :func:`pseudo_labels` for one member, without repeating rows."""
    mine = sampled.filter(F.col("drawn")[k]).withColumn("k", F.lit(k))
    others = F.array(*[F.col("votes")[i] for i in range(config.n_members) if i != k])
    judged = voting.with_decision(
        mine.withColumn("votes", others), config.n_members - 1, config.n_classes, config.normaliser
    )
    return _pseudo_labelled(judged, config)


def pseudo_label_weights(labels: DataFrame) -> DataFrame:
    """``(k, li_size, s)``: number and summed confidence of each member's labels."""
    return labels.groupBy("k").agg(
        F.count(F.lit(1)).alias("li_size"), exact_sum(F.col("confidence")).alias("s")
    )


def every_member(per_member: DataFrame, ks: list[int]) -> DataFrame:
    """Add zero rows for members that have no pseudo-label."""
    frame = per_member.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    # ``per_member`` has one row per member at most.
    return frame.join(F.broadcast(per_member), "k", "left").select(
        "k",
        F.coalesce("li_size", F.lit(0)).alias("li_size"),
        F.coalesce("s", F.lit(0.0)).alias("s"),
    )


def retraining_rows(
    labelled: DataFrame, labels: DataFrame, feature_col: str, weighted: bool, weight_col: str | None = None
) -> DataFrame:
    """Original labelled rows together with pseudo-labelled ones; both may carry ``k``.

    Pseudo-labelled rows weigh their confidence if ``weighted``, else 1; original ones
    what ``weight_col`` says, else 1.
    """
    keys = [c for c in ("k", "row_id") if c in labels.columns and c in labelled.columns]
    weight = F.col("confidence") if weighted else F.lit(1.0)
    own = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    original = labelled.select(*keys, feature_col, "label", own.alias("weight"))
    added = labels.select(*keys, feature_col, F.col("pseudo_label").alias("label"), weight.alias("weight"))
    return original.unionByName(added)


def retraining_rows_at_once(
    labelled: DataFrame, labels: DataFrame, ks: list[int], feature_col: str, weighted: bool, weight_col: str | None = None
) -> DataFrame:
    """The rows of :func:`retraining_rows` for members ``ks``, original ones once each, with
    ``weights ARRAY<DOUBLE>``: what a row weighs for each of them."""
    own = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    original = labelled.select(feature_col, "label", F.array(*[own] * len(ks)).alias("weights"))
    weight = F.col("confidence") if weighted else F.lit(1.0)
    mine = F.array(*[F.when(F.col("k") == k, weight).otherwise(0.0) for k in ks])
    return original.unionByName(labels.select(feature_col, F.col("pseudo_label").alias("label"), mine.alias("weights")))
