"""Vote scaling, ties and exclusions on hand-made rows and against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlabel.config import CoTrainConfig
from peerlabel.functions import voting
from peerlabel.operators import rounds
from peerlabel.operators.bags import each_member


def decide(spark, votes, normaliser, n_classes):
    rows = spark.createDataFrame([(votes,)], "votes ARRAY<ARRAY<DOUBLE>>")
    return voting.with_decision(rows, len(votes), n_classes, normaliser).first()


def test_majority(spark):
    votes = [[1.0, 0.0, 0.0]] * 3 + [[0.0, 1.0, 0.0]]
    row = decide(spark, votes, "minmax", 3)
    assert row.dist == pytest.approx([1, 1 / 3, 0]) and row.confidence == 1 and row.decision == 0
    row = decide(spark, votes, "sum", 3)
    assert row.dist == [0.75, 0.25, 0.0] and row.confidence == 0.75


def test_threshold_is_strict(spark):
    row = spark.range(1).select(
        voting.is_confident(F.lit(0.75), 0.75).alias("at"),
        voting.is_confident(F.lit(0.76), 0.75).alias("above"),
        voting.is_confident(F.lit(None).cast("double"), 0.75).alias("unknown"),
    ).first()
    assert (row.at, row.above, row.unknown) == (False, True, False)


def test_two_way_tie_among_three(spark):
    votes = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    row = decide(spark, votes, "minmax", 3)
    assert row.dist == [1, 1, 0] and row.decision == 0 and row.confidence == 1
    assert decide(spark, votes, "sum", 3).confidence == 0.5


def test_full_tie(spark):
    votes = [[1.0, 0.0], [0.0, 1.0]]
    row = decide(spark, votes, "minmax", 2)
    assert row.confidence is None and row.decision == 1
    row = decide(spark, votes, "sum", 2)
    assert row.confidence == 0.5 and row.decision == 0


def test_nobody_out_of_bag(spark):
    config = CoTrainConfig(n_classes=2, n_members=3)
    rows = spark.createDataFrame(
        [(0, [1, 2, 1], [[1.0, 0.0]] * 3)], "label INT, bag ARRAY<INT>, votes ARRAY<ARRAY<DOUBLE>>"
    )
    judged = rounds.out_of_bag_decisions(rows, config).collect()
    assert all(r.dist == [0, 0] and r.confidence == 0 for r in judged)
    errors = rounds.out_of_bag_errors(rounds.labelled_errors(rows, config)).collect()
    assert len(errors) == 3 and all(r.counted == 0 and r.err is None for r in errors)


def test_refused_row_has_no_label(spark):
    row = spark.range(1).select(
        voting.high_confidence(F.lit(0.5), F.lit(2), 0.75).alias("no"),
        voting.high_confidence(F.lit(0.9), F.lit(2), 0.75).alias("yes"),
    ).first()
    assert tuple(row.no) == (False, -1, 0.0) and tuple(row.yes) == (True, 2, 0.9)


def brute(votes, keep, normaliser):
    sums = np.array([v for v, used in zip(votes, keep) if used] or [np.zeros(len(votes[0]))]).sum(axis=0)
    if sums.sum() == 0:
        return 0.0, None
    low, span = (sums.min(), sums.max() - sums.min()) if normaliser == "minmax" else (0.0, sums.sum())
    if span == 0:
        return None, len(sums) - 1
    dist = (sums - low) / span
    return dist.max(), int(dist.argmax())


@pytest.mark.parametrize("normaliser", ["minmax", "sum"])
@pytest.mark.parametrize("n_members,n_classes", [(3, 2), (5, 4), (5, 10), (9, 6)])
def test_against_brute_force(spark, n_members, n_classes, normaliser):
    """Covers the written-out sums and the array form for large groups."""
    random = np.random.default_rng(7)
    data = []
    for i in range(60):
        classes = random.integers(0, n_classes, n_members)
        bag = random.integers(0, 2, n_members).tolist()
        data.append((i, bag, np.eye(n_classes)[classes].tolist()))
    rows = spark.createDataFrame(data, "row_id INT, bag ARRAY<INT>, votes ARRAY<ARRAY<DOUBLE>>")
    config = CoTrainConfig(n_classes=n_classes, n_members=n_members, normaliser=normaliser)
    left_out = {(r.row_id, r.k): r for r in rounds.leave_one_out_decisions(rows, config).collect()}
    out_of_bag = {(r.row_id, r.k): r for r in rounds.out_of_bag_decisions(rows, config).collect()}
    for i, bag, votes in data:
        for k in range(n_members):
            others = [j != k for j in range(n_members)]
            conf, winner = brute(votes, others, normaliser)
            got = left_out[i, k]
            assert got.confidence == (conf if conf is None else pytest.approx(conf))
            assert winner is None or got.decision == winner
            conf, winner = brute(votes, [o and bag[j] == 0 for j, o in enumerate(others)], normaliser)
            got = out_of_bag[i, k]
            assert got.confidence == (conf if conf is None else pytest.approx(conf))
            assert winner is None or got.decision == winner


def test_own_vote_does_not_count(spark):
    config = CoTrainConfig(n_classes=3, n_members=3)
    schema = "row_id INT, votes ARRAY<ARRAY<DOUBLE>>"
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    before = rounds.leave_one_out_decisions(spark.createDataFrame([(0, [a, b, b])], schema), config, [0])
    after = rounds.leave_one_out_decisions(spark.createDataFrame([(0, [c, b, b])], schema), config, [0])
    assert before.select("dist").first() == after.select("dist").first()


@pytest.mark.parametrize("n_members", [4, 9])
@pytest.mark.parametrize("normaliser", ["minmax", "sum"])
def test_nan_and_null_votes(spark, n_members, normaliser):
    """What a left-out member says does not matter, and no row is confident with a confidence
    of NaN or NULL. One-member and joint forms agree."""
    config = CoTrainConfig(n_classes=3, n_members=n_members, normaliser=normaliser)
    plain = [[0.0, 1.0, 0.0]] * n_members
    odd = [[None] * 3, [None, 1.0, 0.0], [float("nan"), 1.0, 0.0]]
    data = [(i, [True] * n_members, [o, *plain[1:]]) for i, o in enumerate(odd)]
    rows = spark.createDataFrame(data, "row_id INT, drawn ARRAY<BOOLEAN>, votes ARRAY<ARRAY<DOUBLE>>")
    columns = ["k", "row_id", "pseudo_label", "confidence"]
    ks = list(range(n_members))
    joint = sorted(map(tuple, rounds.pseudo_labels(rows, config, ks).select(columns).collect()))
    alone = [r for k in ks for r in rounds.pseudo_labels_of(rows, config, k).select(columns).collect()]
    assert joint == sorted(map(tuple, alone))
    assert [r for r in joint if r[0] == 0] == [(0, i, 1, 1.0) for i in range(3)]
    assert not [r for r in joint if r[0] != 0 and (r[3] is None or np.isnan(r[3]))]


def test_one_member_form_equals_joint_form(spark):
    config = CoTrainConfig(n_classes=3, n_members=4)
    random = np.random.default_rng(3)
    data = [
        (i, random.integers(0, 2, 4).astype(bool).tolist(), np.eye(3)[random.integers(0, 3, 4)].tolist())
        for i in range(40)
    ]
    rows = spark.createDataFrame(data, "row_id INT, drawn ARRAY<BOOLEAN>, votes ARRAY<ARRAY<DOUBLE>>")
    columns = ["k", "row_id", "pseudo_label", "confidence"]
    joint = rounds.pseudo_labels(rows, config, [0, 1, 2, 3]).select(columns).collect()
    alone = [r for k in range(4) for r in rounds.pseudo_labels_of(rows, config, k).select(columns).collect()]
    assert sorted(map(tuple, joint)) == sorted(map(tuple, alone)) and joint


def test_each_member_repeats_rows(spark):
    assert sorted(r.k for r in each_member(spark.range(2), [0, 3]).collect()) == [0, 0, 3, 3]
