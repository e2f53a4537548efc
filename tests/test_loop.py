"""The whole loop: stopping, reproducibility, presets, learning."""

import pytest
from pyspark.sql import functions as F

from peerlabel import (
    CoTrainConfig,
    bucket_members,
    cotrain,
    cotrain_partly_labelled,
    cotrain_split,
    logistic_members,
    supervised_baseline,
    tree_members,
)
from peerlabel.sources import splits, views


@pytest.fixture(scope="module")
def flags(spark, testdata):
    rows = views.docs_flags(spark, f"{testdata}/sf0.01").persist()
    yield rows
    rows.unpersist()


def run(rows, config, n_members=5):
    members = bucket_members(n_members, config.n_classes, len(views.STOP_WORDS), 5)
    parts = splits.with_part(rows, splits.TENTH, config.seed)
    return cotrain(
        splits.part_of(parts, "labelled"), splits.part_of(parts, "unlabelled", drop_label=True), members, config
    )


@pytest.fixture(scope="module")
def usual(flags):
    return run(flags, CoTrainConfig(n_classes=4, max_rounds=2))


def test_same_result_for_any_partitioning(flags, usual):
    again = run(flags.repartition(7), CoTrainConfig(n_classes=4, max_rounds=2))
    assert again.rounds == usual.rounds and again.voters == usual.voters


def test_history_and_sizes(spark, usual):
    history = usual.history(spark).collect()
    assert len(history) == 10
    assert usual.n_labelled + usual.n_unlabelled == 1000
    for row in history:
        assert row.updated == (row.gate1 and row.gate2 and row.gate3)
        assert row.n <= usual.n_unlabelled and (row.gate1 or row.n == 0)


def test_min_max_confidence_is_all_or_nothing(usual):
    assert all(row["s"] == row["li_size"] for row in usual.rounds)


def test_members_that_failed_keep_their_model(usual):
    last = {row["k"]: row for row in usual.rounds if row["round"] == 1}
    first = {row["k"]: row for row in usual.rounds if row["round"] == 0}
    for k, voter in enumerate(usual.voters):
        if not first[k]["updated"] and not last[k]["updated"]:
            assert voter == usual.first_voters[k]
        expected = (first[k]["err"], first[k]["s"]) if first[k]["updated"] else (0.5, first[k]["s_prev"])
        assert (last[k]["err_prev"], last[k]["s_prev"]) == expected


def test_stops_when_nobody_changes(flags):
    """A threshold no confidence can pass leaves every set empty."""
    result = run(flags, CoTrainConfig(n_classes=4, threshold=1.0, max_rounds=5))
    assert {row["round"] for row in result.rounds} == {0}
    # Nobody is confident on the labelled rows either, so no error is known.
    assert all(row["err"] is None and not row["gate1"] for row in result.rounds)


def test_runs_until_nobody_changes(flags):
    """Without a cap of its own, a run ends with a round without updates, after others."""
    result = run(flags, CoTrainConfig(n_classes=4))
    updates = {}
    for row in result.rounds:
        updates[row["round"]] = updates.get(row["round"], 0) + row["updated"]
    assert len(updates) > 2 and len(updates) < 100
    assert updates.pop(max(updates)) == 0 and all(updates.values())


def test_features_are_made_for_drawn_rows_only(spark, flags, usual):
    """Raw rows and a step that makes features give the run that ready features give."""
    raw = flags.withColumnRenamed("code", "raw")
    asked = []

    def featurise(rows):
        asked.append(rows)
        return rows.withColumn("code", F.col("raw"))

    parts = splits.with_part(raw, splits.TENTH, 1)
    members = bucket_members(5, 4, len(views.STOP_WORDS), 5)
    result = cotrain(
        splits.part_of(parts, "labelled"),
        splits.part_of(parts, "unlabelled", drop_label=True),
        members,
        CoTrainConfig(n_classes=4, max_rounds=2),
        featurise,
    )
    assert result.rounds == usual.rounds and result.voters == usual.voters
    assert "drawn" not in asked[0].columns and all("drawn" in rows.columns for rows in asked[1:])


def test_separate_test_tables_and_distributions(spark, flags, usual):
    train, test = flags.filter("row_id % 3 > 0"), flags.filter("row_id % 3 = 0")
    members = bucket_members(3, 4, len(views.STOP_WORDS), 5)
    job = cotrain_split(train, members, CoTrainConfig(n_classes=4, max_rounds=1), test=test)
    assert job.test_errors().first().n_rows == test.count()
    assert job.result.n_labelled + job.result.n_unlabelled == train.count()
    partly = train.withColumn("label", F.when(F.col("row_id") % 5 == 0, F.col("label")))
    job = cotrain_partly_labelled(partly, members, CoTrainConfig(n_classes=4, max_rounds=1), test=test)
    assert job.test_errors().first().n_rows == test.count()
    assert supervised_baseline(train, members[0], 4, test=test).first().n_rows == test.count()
    scored = usual.score(flags, dist=True)
    assert "dist" in scored.columns and "dist" not in usual.score(flags).columns
    assert scored.filter("confidence <> array_max(dist)").count() == 0


def test_scoring_a_stream(spark, testdata, flags, usual):
    """Scoring is a narrow step, so a stream of documents gets the same answers."""
    folder = f"{testdata}/sf0.01"
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(folder)
    scored = usual.score(views.flags_of(stream)).select("row_id", "prediction")
    query = scored.writeStream.format("memory").queryName("scored_stream").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = usual.score(flags).select("row_id", "prediction")
    assert sorted(map(tuple, spark.table("scored_stream").collect())) == sorted(map(tuple, batch.collect()))


def test_exact_draw_never_exceeds_its_size(flags):
    config = CoTrainConfig(n_classes=4, max_rounds=1, subsample="exact")
    result = run(flags, config)
    assert all(row["li_size"] <= row["n"] for row in result.rounds)
    assert all(row["gate3"] for row in result.rounds if row["gate1"])


def test_paper_preset(flags):
    result = run(flags, CoTrainConfig.preset("paper", 4, threshold=0.6, max_rounds=1))
    assert any(row["s"] < row["li_size"] for row in result.rounds)
    assert result.rounds[0]["s_prev"] == pytest.approx(result.n_unlabelled / 10)


def test_one_round_variants(spark, flags, usual):
    """Cached inputs change nothing, another seed does; caches are released."""
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    plain = run(flags, CoTrainConfig(n_classes=4, max_rounds=1, persist_inputs=True))
    assert plain.rounds == usual.rounds[:5]
    assert run(flags, CoTrainConfig(n_classes=4, max_rounds=1, seed=2)).rounds != plain.rounds
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_no_signal_stops_at_once(spark, testdata):
    rows = views.emb_label(spark, f"{testdata}/sf0.01")
    members = logistic_members(3, 10, max_iter=5)
    job = cotrain_split(rows, members, CoTrainConfig(n_classes=10), splits.TENTH_AND_TEST)
    assert len(job.result.rounds) == 3
    assert not any(row["gate1"] or row["updated"] for row in job.result.rounds)
    assert job.result.voters == job.result.first_voters


def test_learning_on_language(spark, testdata):
    rows = views.docs_lang(spark, f"{testdata}/sf0.01").persist()
    job = cotrain_split(rows, logistic_members(3, 4, max_iter=20), CoTrainConfig(n_classes=4, max_rounds=2))
    errors = {r.stage: r.error for r in job.test_errors().collect()}
    assert errors["first"] < 0.3 and errors["last"] <= errors["first"] + 0.05
    baseline = supervised_baseline(rows, logistic_members(1, 4, max_iter=20)[0], 4).first()
    assert baseline.n_rows == job.test.count() and baseline.error < 0.2
    scored = job.scored_test()
    assert scored.filter(~F.col("prediction").between(0, 3)).count() == 0
    rows.unpersist()


def test_learning_on_quality(spark, testdata):
    rows = views.docs_quality(spark, f"{testdata}/sf0.01")
    config = CoTrainConfig.preset("paper", 2, max_rounds=2)
    job = cotrain_partly_labelled(rows, tree_members(3, 2, features_per_node=4), config)
    errors = {r.stage: r.error for r in job.test_errors().collect()}
    assert errors["last"] <= errors["first"] + 0.05 and errors["last"] < 0.13


def test_bad_inputs(spark, flags):
    config = CoTrainConfig(n_classes=4)
    members = bucket_members(3, 4, 8, 5)
    good = flags.filter("row_id < 100")
    with pytest.raises(ValueError, match="labels"):
        cotrain(good.withColumn("label", F.lit(4)), good, members, config)
    with pytest.raises(ValueError, match="labels"):
        cotrain(good.withColumn("label", F.lit(None).cast("int")), good, members, config)
    with pytest.raises(ValueError, match="no labelled"):
        cotrain(good.filter("false"), good, members, config)
    with pytest.raises(ValueError, match="no unlabelled"):
        cotrain(good, good.filter("false"), members, config)
    with pytest.raises(ValueError, match="members"):
        cotrain(good, good, members[:1], config)
