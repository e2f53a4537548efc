"""Registered queries: one per operator, each over whole tables of ``sf_dir``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from peerlabel.config import CoTrainConfig
from peerlabel.functions import gates, voting
from peerlabel.functions.exact import exact_sum
from peerlabel.operators import bags, metrics, rounds, subsample
from peerlabel.operators.joint_trees import grow, tree_members_jointly
from peerlabel.operators.members import (
    bucket_members,
    logistic_members,
    tree_members,
    with_votes,
)
from peerlabel.plans import jobs
from peerlabel.plans.cotrain import MemberState, bagged_voters, cotrain, finish_round, start_round
from peerlabel.sources import splits, views
from peerlabel.sources.tables import local_table, parse_features, parse_numbers

K = 5
C = len(views.LANGUAGES)
N_BITS = len(views.STOP_WORDS)
FLAGS_PER_MEMBER = 5
SEED = 1
N_TREES, TREE_FEATURES, TREE_DEPTH = 3, 4, 5
LITTLE = 1e-4  # regularisation that keeps a saturated model finite
CONFIG = CoTrainConfig(n_classes=C, n_members=K, init_s_prime=100.0, seed=SEED)
PAPER = CoTrainConfig.preset("paper", C, n_members=K, threshold=0.6, seed=SEED)


def flag_members(soft=False):
    return bucket_members(K, C, N_BITS, FLAGS_PER_MEMBER, SEED, soft=soft)


# -- shared steps -------------------------------------------------------------


def _parts(spark, sf):
    return splits.with_part(views.docs_flags(spark, sf), splits.TENTH, SEED)


def _labelled(spark, sf):
    return splits.part_of(_parts(spark, sf), splits.LABELLED)


def _unlabelled(spark, sf):
    return splits.part_of(_parts(spark, sf), splits.UNLABELLED, drop_label=True)


def _bagged(spark, sf):
    return bags.poisson_bags(_labelled(spark, sf), K, SEED)


def _voters(spark, sf):
    return bagged_voters(_bagged(spark, sf), flag_members(), CONFIG)


def _voted(spark, sf):
    return with_votes(views.docs_flags(spark, sf), _voters(spark, sf))


def _voted_bagged(spark, sf, voters=None):
    return with_votes(_bagged(spark, sf), voters or _voters(spark, sf))


def _spread(dist, n, prefix="p"):
    return [dist[c].alias(f"{prefix}_{c}") for c in range(n)]


def _errors(spark, sf, voters=None):
    return rounds.labelled_errors(_voted_bagged(spark, sf, voters), CONFIG)


def _opened(spark, sf, voters, n_unlabelled):
    """Round 0 as it begins, by member: K rows, on the driver."""
    return start_round(_voted_bagged(spark, sf, voters), [MemberState()] * K, n_unlabelled, CONFIG)


def _first_round(spark, sf):
    """Voters, opened members and the sampled, voted unlabelled rows of round 0."""
    voters = _voters(spark, sf)
    pool = _unlabelled(spark, sf)
    n_unlabelled = pool.count()
    opened = _opened(spark, sf, voters, n_unlabelled)
    sizes = {k: row["n"] for k, row in opened.items() if row["gate1"]}
    sampled = with_votes(subsample.bernoulli_draw(pool, sizes, n_unlabelled, K, SEED, 0), voters)
    return voters, opened, sorted(sizes), sampled


def _member_table(spark, by_member, schema):
    names = [column.split()[0] for column in schema.split(", ")]
    rows = [(k, *(row[n] for n in names[1:])) for k, row in sorted(by_member.items())]
    return local_table(spark, rows, schema)


# -- A: sources and splits ----------------------------------------------------


def a1_parse_features(spark, sf):
    parsed = parse_features(views.csv_rows(spark, sf), "features", "label")
    return parsed.select(*_spread(F.col("features"), 4, "f"), "label")


def a4_split(spark, sf):
    labelled = _labelled(spark, sf).select("row_id", F.lit(splits.LABELLED).alias("part"), "label")
    unlabelled = _unlabelled(spark, sf).select(
        "row_id", F.lit(splits.UNLABELLED).alias("part"), F.lit(-1).alias("label")
    )
    return labelled.unionByName(unlabelled)


def a6_sizes(spark, sf):
    return splits.part_sizes(_parts(spark, sf))


# -- B: bootstrap -------------------------------------------------------------


def _bag_columns(bagged):
    return bagged.select("row_id", *_spread(F.col("bag"), K, "bag"))


def b1_bag_counts(spark, sf):
    return _bag_columns(bags.poisson_bags(views.event_ids(spark, sf), K, SEED))


def b2_exact_bootstrap(spark, sf):
    return _bag_columns(bags.exact_bags(views.order_ids(spark, sf), K, seed=SEED))


def b1_block_bags(spark, sf):
    """Draws within blocks of 10,000 positions, each block's counts adding up to its size."""
    return _bag_columns(bags.block_bags(views.event_ids(spark, sf), K, seed=SEED))


def b2_weighted_bootstrap(spark, sf):
    """Orders drawn with replacement in proportion to their price."""
    return _bag_columns(bags.weighted_bags(views.order_weights(spark, sf), K, seed=SEED))


def b3_inbag_rows(spark, sf):
    bagged = bags.poisson_bags(views.event_ids(spark, sf), K, SEED)
    return bags.in_bag_rows_of_all(bagged, list(range(K)), expand=True).select("row_id", "k", "weight")


def b4_oob_flags(spark, sf):
    bagged = bags.poisson_bags(views.event_ids(spark, sf), K, SEED)
    flags = bagged.withColumn("in_bag", bags.in_bag_flags(F.col("bag"), K))
    return flags.select("row_id", *_spread(F.col("in_bag"), K, "in_bag"), F.lit(1.0).alias("weight"))


def b5_bag_summary(spark, sf):
    return bags.bag_summary(bags.poisson_bags(views.event_ids(spark, sf), K, SEED), K)


# -- C: members ---------------------------------------------------------------


def c1_bucket_votes(spark, sf):
    rows = views.docs_flags(spark, sf)
    voters = _voters(spark, sf)
    return rows.select("row_id", *[v.predicted().alias(f"vote_{k}") for k, v in enumerate(voters)])


def _bag_codes(bagged, untied):
    """Codes of bag 0, those whose heaviest class is tied left out if ``untied``."""
    weights = bags.in_bag_rows(bagged, 0).groupBy("code", "label").agg(F.sum("weight").alias("w"))
    return _codes(weights, untied)


def _codes(weights, untied):
    best = weights.groupBy("code").agg(F.sort_array(F.collect_list("w"), asc=False).alias("ws"))
    clear = (F.size("ws") == 1) | (F.get("ws", F.lit(0)) > F.get("ws", F.lit(1)))
    return F.broadcast(best.filter(clear if untied else F.lit(True)).select("code"))  # 256 rows at most


def _bag_of_labelled(rows):
    labelled = splits.part_of(splits.with_part(rows, splits.TENTH, SEED), splits.LABELLED)
    return bags.poisson_bags(labelled, K, SEED)


def _settled(voted, codes):
    """Every row of ``voted``, and whether its code is one of ``codes``."""
    marked = voted.join(codes.withColumn("_known", F.lit(True)), "code", "left")
    return marked.withColumn("settled", F.col("_known").isNotNull())


def c2_lr_every(spark, sf):
    """One logistic regression on one-hot codes, trained on its bag; its vote on every
    document. Where the bag settles the code (``settled``) it must be the code's heaviest class."""
    rows = views.docs_one_hot(spark, sf)
    bagged = _bag_of_labelled(rows)
    voter = logistic_members(1, C, reg_param=LITTLE)[0].fit(bags.in_bag_rows(bagged, 0))
    voted = _settled(voter.vote(rows, "dist"), _bag_codes(bagged, untied=True))
    return voted.select("row_id", "settled", *_spread(F.col("dist"), C, "v"))


def _where_settled(voted):
    """Every document; votes are NULL where SQL cannot know them."""
    known = [F.when(F.col("settled"), F.col(f"v_{c}")).alias(f"v_{c}") for c in range(C)]
    return voted.select("row_id", "settled", *known)


def c2_lr_member(spark, sf):
    """Every document, with the vote of ``c2_lr_every`` where the bag settles it."""
    return _where_settled(c2_lr_every(spark, sf))


def c2_lr_words(spark, sf):
    """The same learner on 64 hashed words of the whole text; its vote on every document."""
    rows = views.docs_lang(spark, sf)
    voter = logistic_members(1, C)[0].fit(bags.in_bag_rows(_bag_of_labelled(rows), 0))
    return voter.vote(rows, "dist").select("row_id", "label", *_spread(F.col("dist"), C, "v"))


def c3_hard_vote(spark, sf):
    classes = c1_bucket_votes(spark, sf)
    return classes.select("row_id", *_spread(voting.hard_vote(F.col("vote_0"), C), C, "v"))


def c4_tree_every(spark, sf):
    """One tree over all flags, trained on its bag; its class shares on every document.
    A full-grown tree splits all codes of the bag that differ: there (``settled``) they are
    the bag's shares."""
    rows = views.docs_flag_vector(spark, sf)
    bagged = _bag_of_labelled(rows)
    voter = tree_members(1, C, features_per_node=N_BITS)[0].fit(bags.in_bag_rows(bagged, 0))
    voted = _settled(voter.vote(rows, "dist"), _bag_codes(bagged, untied=False))
    shares = [F.round(F.col("dist")[c], 9).alias(f"v_{c}") for c in range(C)]
    return voted.select("row_id", "settled", *shares)


def c4_tree_member(spark, sf):
    """Every document, with the shares of ``c4_tree_every`` where the bag has its code."""
    return _where_settled(c4_tree_every(spark, sf))


def c4_tree_grown(spark, sf):
    """Three random trees over counts of short strings, each with four features a node, trained
    together on their bags; the shares of each for every document."""
    rows = views.docs_counts(spark, sf)
    ks = list(range(N_TREES))
    members = tree_members_jointly(N_TREES, C, TREE_FEATURES, max_depth=TREE_DEPTH, seed=SEED)
    voters = grow(members, bags.in_bag_rows_at_once(_bag_of_labelled(rows), ks))
    long = bags.each_member(with_votes(rows, voters).select("row_id", "votes"), ks)
    shares = [F.round(F.col("votes")[F.col("k")][c], 9).alias(f"v_{c}") for c in range(C)]
    return long.select("row_id", "k", *shares)


def c4_tree_words(spark, sf):
    """One tree on 64 hashed words, 16 random ones a node; its shares on every document."""
    rows = views.docs_lang(spark, sf)
    voter = tree_members(1, C, features_per_node=16)[0].fit(bags.in_bag_rows(_bag_of_labelled(rows), 0))
    return voter.vote(rows, "dist").select("row_id", "label", *_spread(F.col("dist"), C, "v"))


def c5_subspace_sizes(spark, sf):
    """Features per member for every row width found in the raw feature table."""
    widths = views.csv_rows(spark, sf).groupBy(F.size(parse_numbers(F.col("features"))).alias("n_features"))
    return widths.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_features",
        "n_rows",
        gates.subspace_size_ceil(F.col("n_features")).alias("size_ceil"),
        gates.subspace_size_floor(F.col("n_features")).alias("size_floor"),
    )


def c6_round0_state(spark, sf):
    judged = bags.in_bag_rows_of_all(_voted_bagged(spark, sf), list(range(K)))
    own = F.array_position(F.col("votes")[F.col("k")], F.lit(1.0)) - 1
    wrong = F.when(own != F.col("label"), F.col("weight")).otherwise(F.lit(0.0))
    return (
        judged.groupBy("k")
        .agg(F.sum("weight").alias("bag_weight"), F.sum(wrong).alias("bag_wrong"))
        .select(
            "k",
            F.lit(MemberState().err_prev).alias("err_prev"),
            F.lit(MemberState().s_prev).alias("s_prev"),
            "bag_weight",
            "bag_wrong",
        )
    )


def c7_baseline_error(spark, sf):
    """The supervised baseline on one-hot codes, tested on every test document; errors are
    counted where the training rows settle a code."""
    parts = splits.with_part(views.docs_one_hot(spark, sf), splits.TENTH_AND_TEST, SEED)
    train = parts.filter(F.col("part") != splits.TEST)
    weights = train.groupBy("code", "label").agg(F.count(F.lit(1)).alias("w"))
    voter = logistic_members(1, C, reg_param=LITTLE)[0].fit(train.withColumn("weight", F.lit(1.0)))
    voted = with_votes(_settled(splits.part_of(parts, splits.TEST), _codes(weights, untied=True)), [voter], C)
    scored = voting.classify(voted, 1, C, voting.SUM)
    missed = F.col("settled") & (F.col("prediction") != F.col("label"))
    counts = scored.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("settled").alias("n_settled"), F.count_if(missed).alias("wrong")
    )
    return counts.withColumn("error", F.try_divide(F.col("wrong").cast("double"), F.col("n_settled")))


def c7_every_error(spark, sf):
    """The same baseline, tested on every test document."""
    member = logistic_members(1, C, reg_param=LITTLE)[0]
    return jobs.supervised_baseline(views.docs_one_hot(spark, sf), member, C, seed=SEED)


def c7_words_error(spark, sf):
    """The baseline on 64 hashed words of the whole text, tested on every test document."""
    return jobs.supervised_baseline(views.docs_lang(spark, sf), logistic_members(1, C)[0], C, seed=SEED)


# -- D: ensemble scoring ------------------------------------------------------


def d1_member_votes(spark, sf):
    repeated = bags.each_member(_voted(spark, sf).select("row_id", "votes"), list(range(K)))
    long = repeated.withColumn("vote", F.col("votes")[F.col("k")])
    return long.select("row_id", "k", *_spread(F.col("vote"), C, "v"))


def d2_ensemble_dist(spark, sf):
    scored = voting.classify(_voted(spark, sf), K, C, voting.SUM)
    return scored.select("row_id", *_spread(F.col("dist"), C))


def d3_loo_dist(spark, sf):
    judged = rounds.leave_one_out_decisions(_voted(spark, sf), CONFIG)
    return judged.select("row_id", "k", *_spread(F.col("dist"), C))


def d3_soft_loo(spark, sf):
    """The same of members that vote with the shares of the classes in a row's bucket."""
    voters = bagged_voters(_bagged(spark, sf), flag_members(soft=True), PAPER)
    judged = rounds.leave_one_out_decisions(with_votes(views.docs_flags(spark, sf), voters), PAPER)
    return judged.select("row_id", "k", *[F.round(F.col("dist")[c], 9).alias(f"p_{c}") for c in range(C)])


def d2_scored_dist(spark, sf):
    """The ensemble's distribution as ``score`` gives it, after one round."""
    result = _loop(spark, sf, CoTrainConfig(n_classes=C, n_members=K, max_rounds=1, seed=SEED))
    scored = result.score(views.docs_flags(spark, sf), dist=True)
    return scored.select("row_id", *_spread(F.col("dist"), C), "prediction")


def d4_oob_loo_dist(spark, sf):
    judged = rounds.out_of_bag_decisions(_voted_bagged(spark, sf), CONFIG)
    return judged.select("row_id", "k", *_spread(F.col("dist"), C))


def _line_dists(spark, sf):
    """Both scalings of four whole numbers per order line, standing in for class sums."""
    sums = {
        "s_0": F.col("l_quantity"),
        "s_1": (F.col("l_linenumber") * 7).cast("double"),
        "s_2": (F.col("l_partkey") % 50).cast("double"),
        "s_3": (F.col("l_suppkey") % 50).cast("double"),
    }
    lines = views.table(spark, sf, "lineitem").withColumns(sums)
    columns = [F.col(name) for name in sums]
    minmax = voting.normalise(columns, voting.MINMAX)
    share = voting.normalise(columns, voting.SUM)
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        *[x.alias(f"minmax_{c}") for c, x in enumerate(minmax)],
        *[x.alias(f"share_{c}") for c, x in enumerate(share)],
    )


def _four(prefix):
    return [F.col(f"{prefix}_{c}") for c in range(4)]


def d5_normalise_minmax(spark, sf):
    return _line_dists(spark, sf).select("l_orderkey", "l_linenumber", *_four("minmax"))


def d6_normalise_sum(spark, sf):
    return _line_dists(spark, sf).select("l_orderkey", "l_linenumber", *_four("share"))


def d7_argmax(spark, sf):
    tops = _line_dists(spark, sf).withColumns(
        {"top_minmax": voting.confidence(_four("minmax")), "top_share": voting.confidence(_four("share"))}
    )
    return tops.select(
        "l_orderkey",
        "l_linenumber",
        voting.argmax(_four("minmax"), F.col("top_minmax"), voting.MINMAX).alias("winner_minmax"),
        voting.argmax(_four("share"), F.col("top_share"), voting.SUM).alias("winner_share"),
    )


def d8_confidence(spark, sf):
    return _line_dists(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        voting.confidence(_four("minmax")).alias("confidence_minmax"),
        voting.confidence(_four("share")).alias("confidence_share"),
    )


def d9_classify(spark, sf):
    return voting.classify(_voted(spark, sf), K, C, CONFIG.normaliser).select("row_id", "prediction")


def d10_high_confidence(spark, sf):
    judged = rounds.leave_one_out_decisions(_voted(spark, sf), PAPER)
    verdict = voting.high_confidence(F.col("confidence"), F.col("decision"), CONFIG.threshold)
    return judged.select("row_id", "k", verdict.alias("v")).select("row_id", "k", "v.*")


# -- E: the round -------------------------------------------------------------


def e1_oob_error(spark, sf):
    return rounds.out_of_bag_errors(_errors(spark, sf))


def e1_weighted_error(spark, sf):
    """Out-of-bag errors where labelled rows weigh a third to five thirds."""
    weighed = _voted_bagged(spark, sf).withColumn("weight", (F.col("row_id") % 5 + 1) / F.lit(3.0))
    return rounds.out_of_bag_errors(rounds.labelled_errors(weighed, CONFIG, "weight"))


def e2_draw_size(spark, sf):
    n_unlabelled = _unlabelled(spark, sf).count()
    opened = _opened(spark, sf, _voters(spark, sf), n_unlabelled)
    return _member_table(spark, opened, "k INT, gate1 BOOLEAN, s_prev DOUBLE, n BIGINT")


def _twentieths(n_rows):
    return {k: n_rows * (k + 1) // 20 for k in range(K)}


def _drawn_pairs(drawn):
    ids = bags.each_member(drawn, list(range(K)))
    return ids.filter(F.col("drawn")[F.col("k")]).select("k", "row_id")


def e3_subsample_bernoulli(spark, sf):
    rows = views.event_ids(spark, sf)
    n = rows.count()
    return _drawn_pairs(subsample.bernoulli_draw(rows, _twentieths(n), n, K, SEED))


def e4_subsample_exact(spark, sf):
    rows = views.event_ids(spark, sf)
    n = rows.count()
    return _drawn_pairs(subsample.exact_draw(rows, _twentieths(n), n, K, SEED))


def e4_weighted_draw(spark, sf):
    """Orders in random order up to a twentieth to a quarter of all prices."""
    rows = views.order_weights(spark, sf)
    _, whole = bags.weight_total(rows, F.col("weight"))
    sizes = {k: n for k, n in _twentieths(math.floor(whole)).items()}
    return _drawn_pairs(subsample.weighted_draw(rows, sizes, whole, K, SEED))


def e5_exact_sums(spark, sf):
    """Sums of thirds of prices that come out the same however the lines are dealt out."""
    lines = views.table(spark, sf, "lineitem")
    third = F.col("l_extendedprice") / F.lit(3.0)
    return lines.groupBy("l_returnflag", "l_linestatus").agg(exact_sum(third).alias("s"))


def e5_li_weight(spark, sf):
    _, _, ks, sampled = _first_round(spark, sf)
    return rounds.every_member(
        rounds.pseudo_label_weights(rounds.pseudo_labels(sampled, CONFIG, ks)), list(range(K))
    )


def e6_pseudo_labels(spark, sf):
    _, _, ks, sampled = _first_round(spark, sf)
    return rounds.pseudo_labels(sampled, CONFIG, ks).select("k", "row_id", "pseudo_label", "confidence")


def e8_gates(spark, sf):
    _, opened, ks, sampled = _first_round(spark, sf)
    closed = finish_round(sampled, opened, ks, CONFIG, spark)
    return _member_table(
        spark,
        closed,
        "k INT, err DOUBLE, err_prev DOUBLE, n BIGINT, li_size BIGINT, s DOUBLE, s_prev DOUBLE, "
        "gate1 BOOLEAN, gate2 BOOLEAN, gate3 BOOLEAN, updated BOOLEAN",
    )


def _retrain_long(spark, sf):
    voters, opened, ks, sampled = _first_round(spark, sf)
    closed = finish_round(sampled, opened, ks, CONFIG, spark)
    updated = [k for k, row in sorted(closed.items()) if row["updated"]]
    labelled = bags.each_member(_labelled(spark, sf), updated)
    labels = rounds.pseudo_labels(sampled, CONFIG, updated)
    return voters, rounds.retraining_rows(labelled, labels, "code", weighted=False)


def e9_retrain_set(spark, sf):
    _, rows = _retrain_long(spark, sf)
    return rows.select("k", "row_id", "label", "weight")


def _loop(spark, sf, config):
    return cotrain(_labelled(spark, sf), _unlabelled(spark, sf), flag_members(), config)


def e9_round1_votes(spark, sf):
    """Votes on every document after the members that passed were retrained."""
    one_round = CoTrainConfig(n_classes=C, n_members=K, max_rounds=1, seed=SEED)
    result = _loop(spark, sf, one_round)
    rows = views.docs_flags(spark, sf)
    return rows.select("row_id", *[v.predicted().alias(f"vote_{k}") for k, v in enumerate(result.voters)])


def e11_loop_history(spark, sf):
    return _loop(spark, sf, CONFIG).history(spark)


def e11_paper_history(spark, sf):
    return _loop(spark, sf, PAPER).history(spark)


# -- F: metrics ---------------------------------------------------------------


def _classified(spark, sf):
    return voting.classify(_voted(spark, sf), K, C, CONFIG.normaliser)


def f1_error_rate(spark, sf):
    return metrics.error_rate(_classified(spark, sf))


def f2_error_by_class(spark, sf):
    return metrics.error_by_class(_classified(spark, sf))


def f3_train_error(spark, sf):
    return rounds.training_error(_errors(spark, sf))


# -- whole jobs ---------------------------------------------------------------


def lang_job(spark, sf):
    """Language of a document from hashed word counts, 10 % of the labels known.

    Words are hashed for the labelled and the drawn documents only.
    """
    return jobs.cotrain_split(
        views.docs_text(spark, sf),
        logistic_members(K, C),
        CoTrainConfig(n_classes=C, seed=SEED),
        featurise=views.word_features,
    )


def _flag_job(spark, sf):
    return jobs.cotrain_split(views.docs_flags(spark, sf), flag_members(), CONFIG)


def f1_test_error(spark, sf):
    return _flag_job(spark, sf).test_errors()


def g1_scored_test(spark, sf):
    """The whole job with lookup members: its answers on the test part."""
    return _flag_job(spark, sf).scored_test().select("row_id", "label", "prediction", "confidence")


def g1_lang(spark, sf):
    return lang_job(spark, sf).test_errors()


def g1_quality(spark, sf):
    """Quality of a document from text statistics; most rows were never annotated."""
    config = CoTrainConfig.preset("paper", 2, n_features=8, seed=SEED)
    members = tree_members(K, 2, features_per_node=config.features_each(), seed=SEED)
    return jobs.cotrain_partly_labelled(views.docs_quality(spark, sf), members, config).test_errors()


REGISTERED = (
    a1_parse_features, a4_split, a6_sizes,
    b1_bag_counts, b1_block_bags, b2_exact_bootstrap, b2_weighted_bootstrap, b3_inbag_rows, b4_oob_flags, b5_bag_summary,
    c1_bucket_votes, c2_lr_every, c2_lr_member, c2_lr_words, c3_hard_vote, c4_tree_every, c4_tree_grown,
    c4_tree_member, c4_tree_words, c5_subspace_sizes, c6_round0_state, c7_baseline_error, c7_every_error, c7_words_error,
    d1_member_votes, d2_ensemble_dist, d2_scored_dist, d3_loo_dist, d3_soft_loo, d4_oob_loo_dist, d5_normalise_minmax,
    d6_normalise_sum, d7_argmax, d8_confidence, d9_classify, d10_high_confidence,
    e1_oob_error, e1_weighted_error, e2_draw_size, e3_subsample_bernoulli, e4_subsample_exact,
    e4_weighted_draw, e5_exact_sums, e5_li_weight,
    e6_pseudo_labels, e8_gates, e9_retrain_set, e9_round1_votes, e11_loop_history,
    e11_paper_history,
    f1_test_error, f1_error_rate, f2_error_by_class, f3_train_error,
    g1_scored_test, g1_lang, g1_quality,
)
