"""Restarting a loop that was cut off; votes asked only of members that changed."""

from dataclasses import dataclass
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from peerlabel.checks import queries as q
from peerlabel.config import CoTrainConfig
from peerlabel.operators.members import fit_members, logistic_members, with_new_votes, with_votes
from peerlabel.plans import cotrain as plan
from peerlabel.plans.cotrain import cotrain
from peerlabel.sources import shared, views

CONFIG = CoTrainConfig.preset("paper", q.C, threshold=0.6, init_s_prime=20.0)


class Lost(Exception):
    pass


@pytest.fixture(scope="module")
def parts(spark, testdata):
    docs = views.docs_flags(spark, f"{testdata}/sf0.01")
    return docs.filter("row_id % 10 = 0"), docs.filter("row_id % 10 > 0").drop("label")


@pytest.fixture(scope="module")
def whole(parts):
    result = cotrain(*parts, q.flag_members(), CONFIG)
    assert len(result.rounds) >= 3 * q.K  # at least three rounds
    return result


def cut_off(monkeypatch, after):
    """Training fails once it has been called ``after`` times."""
    calls = []

    def fit(*args, **kwargs):
        calls.append(1)
        if len(calls) > after:
            raise Lost
        return fit_members(*args, **kwargs)

    monkeypatch.setattr(plan, "fit_members", fit)


@pytest.mark.parametrize("after", [0, 1, 2, 3])
def test_resuming_gives_the_same_history_and_votes(spark, parts, whole, tmp_path, monkeypatch, after):
    cut_off(monkeypatch, after)
    with pytest.raises(Lost):
        cotrain(*parts, q.flag_members(), CONFIG, journal=f"{tmp_path}/book")
    monkeypatch.undo()
    again = cotrain(*parts, q.flag_members(), CONFIG, journal=f"{tmp_path}/book")
    assert again.rounds == whole.rounds and again.voters == whole.voters and again.first_voters == whole.first_voters
    # And once it is at its end, nothing is trained any more.
    cut_off(monkeypatch, 0)
    assert cotrain(*parts, q.flag_members(), CONFIG, journal=f"{tmp_path}/book").voters == whole.voters


def test_another_job_is_refused(parts, tmp_path):
    short = CoTrainConfig.preset("paper", q.C, threshold=0.6, init_s_prime=20.0, max_rounds=1)
    cotrain(*parts, q.flag_members(), short, journal=f"{tmp_path}/book")
    with pytest.raises(ValueError, match="other settings"):
        cotrain(*parts, q.flag_members(), CONFIG, journal=f"{tmp_path}/book")


def test_models_of_spark_are_kept_by_its_writers(spark, testdata, tmp_path):
    docs = views.docs_lang(spark, f"{testdata}/sf0.001", 16).cache()
    args = docs.filter("row_id % 2 = 0"), docs.filter("row_id % 2 = 1").drop("label"), logistic_members(2, q.C, max_iter=5)
    config = CoTrainConfig(q.C, max_rounds=1)
    first = cotrain(*args, config, journal=f"{tmp_path}/book")
    again = cotrain(*args, config, journal=f"{tmp_path}/book")
    votes = [[r.votes for r in with_votes(docs, v).orderBy("row_id").collect()] for v in (first.voters, again.voters)]
    assert votes[0] == votes[1] and again.rounds == first.rounds
    docs.unpersist()


@dataclass(frozen=True)
class Counting:
    """A member whose voters note that they were asked."""

    inner: object
    asked: list
    feature_col: str = "code"

    def fit(self, rows):
        return CountingVoter(self.inner.fit(rows), self.asked)


@dataclass(frozen=True)
class CountingVoter:
    inner: object
    asked: list

    @property
    def hard(self):
        return True

    def vote(self, rows, out_col):
        self.asked.append("bag" in rows.columns)
        return self.inner.vote(rows, out_col)


def test_only_changed_members_are_asked_again(parts, whole):
    asked = []
    result = cotrain(*parts, [Counting(m, asked) for m in q.flag_members()], CONFIG)
    assert result.rounds == whole.rounds
    changed = sum(r["updated"] for r in result.rounds)
    assert sum(asked) == q.K + changed  # calls on labelled rows


def test_new_votes_replace_the_old(spark, parts):
    rows = parts[0].limit(50)
    members = q.flag_members()
    voters = [m.fit(parts[0].withColumn("weight", F.lit(1.0))) for m in members]
    others = [m.fit(parts[0].withColumns({"weight": F.lit(1.0), "label": F.lit(2)})) for m in members]
    voted = with_new_votes(with_votes(rows, voters), {1: others[1], 4: others[4]}, 5)
    mixed = with_votes(rows, [others[k] if k in (1, 4) else voters[k] for k in range(5)])
    assert sorted(map(str, voted.collect())) == sorted(map(str, mixed.select(*voted.columns).collect()))


def test_no_vote_table_is_left_behind(spark, parts):
    root = Path(shared.shared_dir(spark, "x").removeprefix("file://")).parent
    before = set(root.glob("votes-*"))
    cotrain(*parts, q.flag_members(), CoTrainConfig(q.C, max_rounds=2))
    assert root.exists() and set(root.glob("votes-*")) <= before
