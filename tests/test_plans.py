"""What the plans must not contain, and what must reach the scan."""

import re

import pytest
from pyspark.sql import functions as F

from peerlabel.checks import queries as q
from peerlabel.operators import bags, rounds, subsample
from peerlabel.operators.members import with_votes
from peerlabel.sources import splits, views

JIT_LIMIT = 8000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def largest_method(df):
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    return max(int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", text))


@pytest.fixture(scope="module")
def sf(testdata):
    return f"{testdata}/sf0.001"


@pytest.fixture(scope="module")
def sampled(spark, sf):
    voters = q._voters(spark, sf)
    pool = q._unlabelled(spark, sf)
    return with_votes(subsample.bernoulli_draw(pool, {k: 50 for k in range(q.K)}, 180, q.K), voters)


def hot_paths(spark, sf, sampled):
    labels = rounds.pseudo_labels(sampled, q.CONFIG, list(range(q.K)))
    return {
        "errors": q._errors(spark, sf),
        "weights": rounds.pseudo_label_weights(labels),
        "one member": rounds.pseudo_labels_of(sampled, q.CONFIG, 0),
        "bags": q.b1_bag_counts(spark, sf),
        "classify": q.d9_classify(spark, sf),
        "draw": subsample.bernoulli_draw(views.event_ids(spark, sf), {0: 10, 4: 90}, 1000, q.K),
    }


def test_hot_path_operators(spark, sf, sampled):
    for name, df in hot_paths(spark, sf, sampled).items():
        text = plan(df)
        for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "Sort"):
            assert bad not in text, (name, bad)
        assert text.count("Exchange") <= 1, name


def test_generated_code_fits_the_jit(spark, sf, sampled):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, df in hot_paths(spark, sf, sampled).items():
            assert largest_method(df) < JIT_LIMIT, name
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_confidence_is_not_computed_twice(spark, sf, sampled):
    """No filter on the confidence below the projections that compute it."""
    text = plan(rounds.pseudo_label_weights(rounds.pseudo_labels(sampled, q.CONFIG, [0, 1])))
    assert not [line for line in text.splitlines() if "Filter" in line and "greatest" in line]


def test_features_lie_above_the_draw(spark, sf):
    """Words are hashed for drawn rows only: the draw's explode is below that step."""
    pool = splits.part_of(splits.with_part(views.docs_text(spark, sf), splits.TENTH, 1), splits.UNLABELLED)
    drawn = subsample.bernoulli_draw(pool, {0: 10}, 180, q.K)
    lines = plan(views.word_features(drawn)).splitlines()
    explode = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    features = [i for i, line in enumerate(lines) if "features#" in line and "UDF" in line]
    assert features and max(features) < explode
    assert not [line for line in lines[explode:] if "split(" in line]


def test_only_needed_columns_are_read(spark, sf):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(q.b5_bag_summary(spark, sf))).group(1)
    assert schema == "event_id:bigint"
    unlabelled = splits.part_of(q._parts(spark, sf), splits.UNLABELLED)
    counted = plan(unlabelled.agg(F.count(F.lit(1)))).split("ReadSchema: struct<")[1]
    assert counted.startswith("doc_id:bigint>")


def test_exact_bags_move_features_once(spark, sf):
    """Positions are worked out on ids, so features pass one exchange only."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(bags.exact_bags(q._labelled(spark, sf), 3, n_rows=20))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    lines = text.splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert sum("code#" in lines[i + 1] for i in exchanges) == 1


def test_bag_weights_reach_the_training_aggregate_combined(spark, sf):
    rows = bags.in_bag_rows_of_all(q._bagged(spark, sf), [0, 1])
    text = plan(rows.groupBy("k", "code", "label").agg(F.sum("weight")))
    assert "partial_sum" in text and text.count("Exchange") == 1
