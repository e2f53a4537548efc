"""Members trained together against the same members trained one by one."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from peerlabel.config import CoTrainConfig
from peerlabel.operators import bags, joint
from peerlabel.operators.members import ClassifierMember, with_votes
from peerlabel.plans.cotrain import bagged_voters, cotrain
from peerlabel.sources import views

C = len(views.LANGUAGES)


@pytest.fixture(scope="module")
def bagged(spark, testdata):
    rows = views.docs_lang(spark, f"{testdata}/sf0.001", 16)
    return bags.poisson_bags(rows, 6).repartition(4).cache()


def at_once(bagged, ks):
    return bags.in_bag_rows_at_once(bagged, ks).select("features", "label", "weights").cache()


@pytest.mark.parametrize("reg, intercept", [(0.05, False), (0.05, True), (1.0, True)])
def test_coefficients_of_the_single_fits(bagged, reg, intercept):
    ks = [0, 1, 2]
    members = joint.linear_members(3, C, reg_param=reg, fit_intercept=intercept, tol=1e-13, max_iter=500)
    found = joint.fit_linear(members, at_once(bagged, ks))
    learner = LogisticRegression(family="multinomial", maxIter=500, tol=1e-12, regParam=reg, fitIntercept=intercept)
    for k, voter in zip(ks, found):
        model = ClassifierMember(learner, C).fit(bags.in_bag_rows(bagged, k)).model
        assert np.abs(np.array(voter.coefficients) - model.coefficientMatrix.toArray()).max() < 1e-6
        if intercept:
            assert np.abs(np.array(voter.intercepts) - model.interceptVector.toArray()).max() < 1e-6


def test_passes_do_not_grow_with_the_members(bagged):
    counts = []
    for ks in ([0], [0, 1, 2, 3, 4, 5]):
        passes = []
        joint.fit_linear(joint.linear_members(len(ks), C, reg_param=0.05), at_once(bagged, ks), passes)
        counts.append(len(passes))
        assert passes[0] == len(ks) and passes == sorted(passes, reverse=True)  # fewer as members end
    singles = []
    for k in range(6):
        passes = []
        joint.fit_linear(joint.linear_members(1, C, reg_param=0.05), at_once(bagged, [k]), passes)
        singles.append(len(passes))
    assert counts == [singles[0], max(singles)]  # as many as the slowest alone


def test_one_scoring_step_gives_the_votes_of_each(spark, bagged):
    voters = bagged_voters(bagged, joint.linear_members(6, C, reg_param=0.05), CoTrainConfig(C, n_members=6))
    voters[3] = joint.LinearVoter(voters[3].coefficients, voters[3].intercepts, C, soft=True)
    together = with_votes(bagged, voters)
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    apart = bagged
    for k, voter in enumerate(voters):
        apart = voter.vote(apart, f"v{k}")
    apart = apart.select("row_id", F.array(*[f"v{k}" for k in range(6)]).alias("votes"))
    get = lambda df: {r.row_id: r.votes for r in df.select("row_id", "votes").collect()}
    ours, theirs = get(together), get(apart)
    assert ours.keys() == theirs.keys()
    for i in ours:
        assert np.allclose(ours[i], theirs[i], atol=1e-12)


def test_the_loop_with_joint_members(spark, testdata):
    """The same loop as with single fits, as far as their tolerances let votes agree."""
    docs = views.docs_lang(spark, f"{testdata}/sf0.001", 16).cache()
    args = docs.filter("row_id % 3 = 0"), docs.filter("row_id % 3 > 0").drop("label")
    config = CoTrainConfig(C, max_rounds=2, init_s_prime=20.0)
    members = joint.linear_members(4, C, reg_param=0.05, tol=1e-12, max_iter=500)
    learner = LogisticRegression(family="multinomial", maxIter=500, tol=1e-12, regParam=0.05, fitIntercept=False)
    ours = cotrain(*args, members, config).rounds
    theirs = cotrain(*args, [ClassifierMember(learner, C)] * 4, config).rounds
    assert ours == theirs
    docs.unpersist()


def test_degenerate_bags(spark):
    rows = spark.createDataFrame([([1.0, 5.0], 0, [1.0, 0.0]), ([2.0, 5.0], 1, [1.0, 1.0])], "features ARRAY<DOUBLE>, label INT, weights ARRAY<DOUBLE>")
    first, second = joint.fit_linear(joint.linear_members(2, 3, reg_param=0.1), rows)
    assert all(row[1] == 0.0 for row in first.coefficients)  # a constant feature
    assert all(x == 0.0 for row in second.coefficients for x in row)  # a bag of one row
    with pytest.raises(ValueError, match="no training rows"):
        joint.fit_linear(joint.linear_members(2, 3), rows.withColumn("weights", F.array(F.lit(1.0), F.lit(0.0))))
    with pytest.raises(ValueError, match="no training rows"):
        joint.fit_linear(joint.linear_members(2, 3), rows.limit(0))
