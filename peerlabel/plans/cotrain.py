"""The co-training loop: K classifiers teach each other from unlabelled rows.

The loop runs on the driver, but only K-row summaries and trained models reach
it. Every table of a round derives directly from the inputs and from immutable
voters, so the lineage stays flat however many rounds there are, and a lost
executor's share is recomputed to the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlabel.config import CoTrainConfig
from peerlabel.functions import gates, voting
from peerlabel.operators import rounds
from peerlabel.operators.bags import each_member, in_bag_rows, in_bag_rows_at_once, in_bag_rows_of_all, weight_total, with_bags
from peerlabel.operators.members import Member, Voter, fit_members, with_new_votes, with_votes
from peerlabel.operators.subsample import draw
from peerlabel.plans.journal import BEFORE, Entry, Journal
from peerlabel.sources.shared import remove, shared_dir, stored
from peerlabel.sources.tables import local_table

WEIGHT = "_instance_weight"

HISTORY_SCHEMA = (
    "round INT, k INT, err DOUBLE, err_prev DOUBLE, n BIGINT, li_size BIGINT, s DOUBLE, "
    "s_prev DOUBLE, gate1 BOOLEAN, gate2 BOOLEAN, gate3 BOOLEAN, updated BOOLEAN, train_error DOUBLE"
)


@dataclass(frozen=True)
class MemberState:
    """What a member carries from round to round."""

    err_prev: float = 0.5
    s_prev: float = 0.0


@dataclass
class CoTrainResult:
    config: CoTrainConfig
    first_voters: list[Voter]
    voters: list[Voter]
    rounds: list[dict] = field(default_factory=list)
    n_labelled: int = 0
    n_unlabelled: int = 0

    def history(self, spark) -> DataFrame:
        """One row per round and member; a closed gate 1 means nothing was drawn."""
        names = [column.split()[0] for column in HISTORY_SCHEMA.split(", ")]
        return local_table(spark, [tuple(r[n] for n in names) for r in self.rounds], HISTORY_SCHEMA)

    def score(self, rows: DataFrame, voters: list[Voter] | None = None, dist: bool = False) -> DataFrame:
        """``rows`` with ``prediction`` and ``confidence`` of the whole ensemble, and with
        its distribution over the classes if ``dist``."""
        c = self.config
        voted = with_votes(rows, self.voters if voters is None else voters, c.n_classes)
        scored = voting.classify(voted, c.n_members, c.n_classes, c.normaliser).drop("votes")
        return scored if dist else scored.drop("dist")


def cotrain(
    labelled: DataFrame,
    unlabelled: DataFrame,
    members: Sequence[Member],
    config: CoTrainConfig,
    featurise: Callable[[DataFrame], DataFrame] | None = None,
    journal: str | None = None,
) -> CoTrainResult:
    """Train ``members`` on ``labelled`` and let them label ``unlabelled`` for each other.

    ``labelled`` has ``row_id``, the members' feature column and ``label`` in 0..C-1;
    ``unlabelled`` the first two; both ``config.weight_col`` if that is set. Row ids must be
    unique within each table.

    With ``featurise`` the tables hold raw columns instead of features. It makes the feature
    column from them, row by row, keeping the other columns, and is called on the
    rows drawn in a round, not on the whole unlabelled table.

    With ``journal``, a folder that the driver's successor can read as well, every closed
    round is noted there, and a call with the same tables and settings goes on after the last one.
    """
    featurise = featurise or (lambda rows: rows)
    config = config.for_members(len(members))
    feature_col = members[0].feature_col
    if any(m.feature_col != feature_col for m in members):
        raise ValueError("all members must read the same feature column")
    weight = [] if config.weight_col is None else [F.col(config.weight_col).cast("double").alias(WEIGHT)]
    # The drawn bootstraps need the size beforehand; ids alone are read for it.
    n_draws = labelled.count() if config.bootstrap in ("exact", "block") and not weight else None
    bagged = with_bags(
        featurise(labelled).select("row_id", feature_col, F.col("label").cast("int").alias("label"), *weight),
        config.n_members,
        config.bootstrap,
        config.seed,
        n_draws,
        WEIGHT if weight else None,
    ).persist(StorageLevel.MEMORY_AND_DISK)
    pool = unlabelled
    if config.persist_inputs:
        pool = pool.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # These two also fill the caches, in as many tasks as the inputs have.
        n_labelled = _checked_size(bagged, config)
        if weight:
            weight_total(bagged, F.col(WEIGHT))
            n_rows, n_unlabelled = weight_total(pool, F.col(config.weight_col).cast("double"))
        else:
            n_rows = n_unlabelled = pool.count()
        if n_rows == 0 or n_unlabelled == 0:
            raise ValueError("there are no unlabelled rows")
        book = Journal(bagged.sparkSession, journal, config, (n_labelled, n_unlabelled)) if journal else None
        return _run(bagged, pool, n_labelled, n_unlabelled, members, feature_col, config, featurise, book)
    finally:
        bagged.unpersist()
        if config.persist_inputs:
            pool.unpersist()


def _checked_size(labelled, config):
    size = labelled.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("label").alias("given"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
    ).first()
    if size.n == 0:
        raise ValueError("there are no labelled rows")
    if size.given < size.n or size.low < 0 or size.high >= config.n_classes:
        raise ValueError(f"labels must be 0..{config.n_classes - 1} and not NULL")
    return size.n


class _VoteTable:
    """Labelled rows with the votes of all members, of which a round asks only the changed ones.

    Each version is written to the shared folder, from the one before, and replaces it: lineage
    ends at files, however many rounds there are, and a lost executor costs nothing.
    """

    def __init__(self, bagged: DataFrame, config: CoTrainConfig):
        self.config, self.spark = config, bagged.sparkSession
        self.folder, self.version = shared_dir(self.spark, "votes"), 0
        self.rows = bagged

    def ask(self, changed: dict[int, Voter]) -> DataFrame:
        n = self.config.n_members
        if len(changed) == n:
            voted = with_votes(self.rows.drop("votes"), [changed[k] for k in range(n)], self.config.n_classes)
        else:
            voted = with_new_votes(self.rows, changed, n, self.config.n_classes)
        last = self.version and f"{self.folder}/{self.version}"
        self.version += 1
        self.rows = stored(voted, f"{self.folder}/{self.version}")
        if last:
            remove(self.spark, last)
        return self.rows

    def close(self) -> None:
        remove(self.spark, self.folder)


def _run(bagged, pool, n_labelled, n_unlabelled, members, feature_col, config, featurise, journal):
    spark = bagged.sparkSession
    everyone = list(range(config.n_members))
    past = journal.entries() if journal else []
    if past:
        voters = [past[0].voters[k] for k in everyone]
        states = past[0].states
    else:
        voters = bagged_voters(bagged, members, config)
        states = [MemberState() for _ in everyone]
        if journal:
            journal.append(Entry(BEFORE, dict(enumerate(voters)), states, [], everyone))
    result = CoTrainResult(config, list(voters), voters, [], n_labelled, n_unlabelled)
    for entry in past[1:]:
        voters = [entry.voters.get(k, voters[k]) for k in everyone]
        states = entry.states
        result.rounds.extend(entry.rounds)
    result.voters = voters
    if past and not past[-1].updated:
        return result  # the loop had stopped by itself

    table = _VoteTable(bagged, config)
    changed = dict(enumerate(voters))
    try:
        for round_no in range(max(len(past) - 1, 0), config.max_rounds):
            opened = start_round(table.ask(changed), states, n_unlabelled, config, WEIGHT if config.weight_col else None)
            sizes = {k: row["n"] for k, row in opened.items() if row["gate1"]}
            closed, changed = _round(bagged, pool, n_unlabelled, members, feature_col, config, featurise, voters, opened, sizes, round_no)
            voters = [changed.get(k, voters[k]) for k in everyone]
            states = [
                MemberState(row["err"], row["s"]) if row["updated"] else MemberState(row["err_prev"], row["s_prev"])
                for row in (closed[k] for k in everyone)
            ]
            history = [{"round": round_no, "k": k, **closed[k]} for k in everyone]
            result.rounds.extend(history)
            result.voters = voters
            if journal:
                journal.append(Entry(round_no, changed, states, history, sorted(changed)))
            if not changed:
                break
    finally:
        table.close()
    return result


def _round(bagged, pool, n_unlabelled, members, feature_col, config, featurise, voters, opened, sizes, round_no):
    """What the round says of every member, and the new voters of those it updates."""
    spark = bagged.sparkSession
    weight_col = WEIGHT if config.weight_col else None
    sampled = None
    if sizes:
        drawn = draw(
            config.subsample, pool, sizes, n_unlabelled, config.n_members, config.seed, round_no, weight_col=config.weight_col
        )
        features = featurise(drawn).select("row_id", feature_col, "drawn")
        sampled = with_votes(features, voters, config.n_classes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        closed = finish_round(sampled, opened, sorted(sizes), config, spark)
        updated = [k for k in range(config.n_members) if closed[k]["updated"]]
        return closed, fit_members(
            members,
            updated,
            lambda k: rounds.retraining_rows(
                bagged, rounds.pseudo_labels_of(sampled, config, k), feature_col, config.retrain_weights, weight_col
            ),
            lambda ks: rounds.retraining_rows(
                each_member(bagged, ks), rounds.pseudo_labels(sampled, config, ks), feature_col, config.retrain_weights, weight_col
            ),
            config.parallelism,
            lambda ks: rounds.retraining_rows_at_once(
                bagged, rounds.pseudo_labels(sampled, config, ks), ks, feature_col, config.retrain_weights, weight_col
            ),
        )
    finally:
        if sampled is not None:
            sampled.unpersist()


def open_round(state: DataFrame, initial: float, n_unlabelled: float) -> DataFrame:
    """Gate 1, the earlier weight in force and the draw size, per member."""
    return (
        state.withColumn("gate1", gates.gate_error_fell(F.col("err"), F.col("err_prev")))
        .withColumn("s_prev", gates.starting_weight(F.col("gate1"), F.col("s_prev"), initial))
        .withColumn(
            "n",
            F.when(
                F.col("gate1"),
                gates.draw_size(F.col("err"), F.col("err_prev"), F.col("s_prev"), n_unlabelled),
            ).otherwise(F.lit(0).cast("bigint")),
        )
    )


def close_round(weighed: DataFrame) -> DataFrame:
    """Gates 2 and 3 and the decision, per member of an opened round."""
    return (
        weighed.withColumn(
            "gate2", F.col("gate1") & gates.gate_set_grew(F.col("s_prev"), F.col("li_size"))
        )
        .withColumn(
            "gate3",
            F.col("gate1")
            & gates.gate_noise_fell(F.col("err"), F.col("s"), F.col("err_prev"), F.col("s_prev")),
        )
        .withColumn("updated", F.col("gate1") & F.col("gate2") & F.col("gate3"))
    )


def start_round(
    voted: DataFrame,
    states: Sequence[MemberState],
    n_unlabelled: float,
    config: CoTrainConfig,
    weight_col: str | None = None,
) -> dict[int, dict]:
    """What ``open_round`` says of every member, measured on labelled rows with votes."""
    measured = {row["k"]: row for row in rounds.labelled_errors(voted, config, weight_col).collect()}
    whole = measured.pop(rounds.ENSEMBLE)
    kind = "BIGINT" if weight_col is None else "DOUBLE"
    state = local_table(
        voted.sparkSession,
        [(k, row["counted"], row["wrong"], states[k].err_prev, states[k].s_prev) for k, row in measured.items()],
        f"k INT, counted {kind}, wrong {kind}, err_prev DOUBLE, s_prev DOUBLE",
    )
    opened = open_round(
        state.withColumn("err", F.try_divide(F.col("wrong").cast("double"), F.col("counted"))),
        config.starting_weight(n_unlabelled),
        n_unlabelled,
    )
    train_error = whole["missed"] / whole["n_rows"]
    return {row["k"]: {**row.asDict(), "train_error": train_error} for row in opened.collect()}


def finish_round(
    sampled: DataFrame | None, opened: dict[int, dict], drawn: list[int], config: CoTrainConfig, spark
) -> dict[int, dict]:
    """What ``close_round`` says of every member, given the rows drawn for members ``drawn``."""
    everyone = list(range(config.n_members))
    weights = {k: (0, 0.0) for k in everyone}
    if drawn:
        labels = rounds.pseudo_labels(sampled, config, drawn)
        for k, li_size, s in rounds.pseudo_label_weights(labels).collect():
            weights[k] = (li_size, s)
    state = local_table(
        spark,
        [
            (k, o["err"], o["err_prev"], o["s_prev"], o["gate1"], o["n"], o["train_error"], *weights[k])
            for k, o in sorted(opened.items())
        ],
        "k INT, err DOUBLE, err_prev DOUBLE, s_prev DOUBLE, gate1 BOOLEAN, n BIGINT, "
        "train_error DOUBLE, li_size BIGINT, s DOUBLE",
    )
    closed = {row["k"]: row.asDict() for row in close_round(state).collect()}
    for row in closed.values():
        row.pop("k")
    return closed


def bagged_voters(bagged: DataFrame, members: Sequence[Member], config: CoTrainConfig) -> list[Voter]:
    """Round 0: every member trained on its own bag."""
    config = config.for_members(len(members))
    ks = list(range(config.n_members))
    # Poisson counts know no weights, so each draw weighs its row's; drawn by weight, it weighs 1.
    by_row = config.weight_col is not None and config.bootstrap == "poisson"

    def weighed(drawn: DataFrame) -> DataFrame:
        return drawn.withColumn("weight", F.col("weight") * F.col(WEIGHT)) if by_row else drawn

    fitted = fit_members(
        members,
        ks,
        lambda k: weighed(in_bag_rows(bagged, k)),
        lambda wanted: weighed(in_bag_rows_of_all(bagged, wanted)),
        config.parallelism,
        lambda wanted: in_bag_rows_at_once(bagged, wanted, WEIGHT if by_row else None),
    )
    return [fitted[k] for k in ks]
