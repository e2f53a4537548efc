"""Exact sums; weights in bags, errors, draws and whole loops."""

import hashlib
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from peerlabel.checks import queries as q
from peerlabel.config import CoTrainConfig
from peerlabel.functions.exact import exact_sum
from peerlabel.operators import bags, rounds, subsample
from peerlabel.operators.members import bucket_members
from peerlabel.plans.cotrain import cotrain
from peerlabel.sources import views


# -- sums ---------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["fractions", "mixed signs", "large and small"])
def test_sums_are_exact_in_any_layout(spark, kind):
    rng = random.Random(kind)
    make = {
        "fractions": lambda: rng.choice([0.8, 5 / 6, 1 / 7, 0.1]),
        "mixed signs": lambda: rng.choice([1, -1]) * rng.random() * 10 ** rng.randint(-3, 9),
        "large and small": lambda: rng.choice([1e14, 1e-6, 3.0]) * rng.random(),
    }[kind]
    terms = [make() for _ in range(4000)]
    rows = spark.createDataFrame([(x,) for x in terms], "x DOUBLE")
    found = {rows.repartition(p).agg(exact_sum(F.col("x")).alias("s")).first().s for p in (1, 7, 64)}
    assert found == {math.fsum(terms)}


def test_sums_of_nothing_and_of_no_numbers(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, 1e-20), (2, -1e-20), (3, None), (3, 2.5)], "g INT, x DOUBLE")
    sums = {r.g: r.s for r in rows.groupBy("g").agg(exact_sum(F.col("x")).alias("s")).collect()}
    assert sums == {1: None, 2: 0.0, 3: 2.5}
    with pytest.raises(Exception, match="(?i)overflow|cast"):
        spark.createDataFrame([(float("nan"),)], "x DOUBLE").agg(exact_sum(F.col("x"))).collect()


@pytest.mark.parametrize("n_members, soft", [(5, False), (6, False), (7, False), (6, True)])
def test_histories_do_not_depend_on_the_layout(spark, testdata, n_members, soft):
    """Votes are fifths and sixths here; their sums decide gates and buckets."""
    docs = views.docs_flags(spark, f"{testdata}/sf0.001").cache()
    members = bucket_members(n_members, q.C, q.N_BITS, 5, 1, soft=soft)
    config = CoTrainConfig.preset("paper", q.C, threshold=0.55, init_s_prime=20.0, max_rounds=2)
    seen = set()
    for parts in (1, 7, 64):
        rows = docs.repartition(parts)
        result = cotrain(rows.filter("row_id % 4 = 0"), rows.filter("row_id % 4 > 0").drop("label"), members, config)
        seen.add((repr([tuple(r.values()) for r in result.rounds]), repr(result.voters)))
    docs.unpersist()
    assert len(seen) == 1 and "True" in next(iter(seen))[0]


# -- bootstrap ----------------------------------------------------------------


def wide_uniform(i, salt):
    return int(hashlib.md5(f"{i}:{salt}".encode()).hexdigest()[:13], 16) / 2**52


def line_of(weights, seed=1):
    """Rows as runs of units, the heavy ones last."""
    factor = 2.0 ** (51 - math.floor(math.log2(sum(weights.values()))))
    units = {i: math.floor(w * factor + 0.5) for i, w in weights.items()}
    order = sorted((u > bags.HEAVY_UNITS, hashlib.md5(f"{i}:{seed}:dense".encode()).hexdigest(), i) for i, u in units.items() if u)
    at, line = 0, []
    for _, _, i in order:
        line.append((at, i))
        at += units[i]
    return line, at


@pytest.mark.parametrize("kind", ["even", "skewed", "one heavy", "few", "zeros"])
def test_weighted_bags_follow_the_line(spark, kind):
    rng = random.Random(3)
    weights = {
        "even": {i: 1.0 for i in range(9000)},
        "skewed": {i: rng.random() ** -1.5 for i in range(5000)},
        "one heavy": {**{i: 1.0 for i in range(6000)}, 7: 3000.0},
        "few": {1: 0.1, 2: 0.3, 5: 0.6},
        "zeros": {i: float(i % 3 == 0) for i in range(300)},
    }[kind]
    rows = spark.createDataFrame(list(weights.items()), "row_id LONG, weight DOUBLE").repartition(6)
    got = {r.row_id: list(r.bag) for r in bags.weighted_bags(rows, 3).collect()}
    line, whole = line_of(weights)
    expected = {i: [0, 0, 0] for i in weights}
    starts = [s for s, _ in line]
    import bisect

    for j in range(3 * len(weights)):
        unit = math.floor(wide_uniform(j, "1:wdraw") * whole)
        expected[line[bisect.bisect_right(starts, unit) - 1][1]][j % 3] += 1
    assert got == expected


def test_weighted_counts_are_as_likely_as_the_weights(spark):
    rows = spark.range(4000).select(F.col("id").alias("row_id"), F.pow(F.lit(1.5), F.col("id") % 8).alias("weight"))
    found = bags.weighted_bags(rows, 5, seed=4).select("row_id", F.explode("bag").alias("n"))
    by_class = {r.c: r.n for r in found.groupBy((F.col("row_id") % 8).alias("c")).agg(F.sum("n").alias("n")).collect()}
    whole = sum(1.5**c for c in range(8))
    assert sum(by_class.values()) == 20000
    for c, n in by_class.items():
        p = 1.5**c / whole
        assert abs(n - 20000 * p) < 5 * math.sqrt(20000 * p * (1 - p))


def test_a_heavy_row_is_no_hot_key(spark):
    """Draws of a row with most of the weight are summed before they meet."""
    rows = spark.range(50_000).select(F.col("id").alias("row_id"), F.when(F.col("id") == 3, 1e6).otherwise(1.0).alias("weight"))
    bag = {r.row_id: r.bag for r in bags.weighted_bags(rows, 2).filter("bag[0] > 100").collect()}
    assert set(bag) == {3} and abs(bag[3][0] / 50_000 - 1e6 / 1_049_999) < 0.01
    plan = bags.weighted_bags(rows, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("bad", [[1.0, -1.0], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [1.0, float("inf")]])
def test_wrong_weights_fail(spark, bad):
    rows = spark.createDataFrame(list(enumerate(bad)), "row_id LONG, weight DOUBLE")
    with pytest.raises(ValueError, match="weights are"):
        bags.weighted_bags(rows, 2)


def test_no_rows_have_no_bags(spark):
    assert bags.weighted_bags(spark.createDataFrame([], "row_id LONG, weight DOUBLE"), 2).count() == 0


@pytest.mark.parametrize("n", [1, 99, 100, 250])
def test_blocks_are_drawn_from_themselves(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "row_id")
    found = bags.block_bags(rows, 3, block=100)
    placed = bags.with_dense_position(found, n).withColumn("block", F.floor(F.col("pos") / 100))
    sums = placed.groupBy("block").agg(F.count(F.lit(1)).alias("size"), *[F.sum(F.col("bag")[k]).alias(f"n{k}") for k in range(3)])
    for r in sums.collect():
        assert r.n0 == r.n1 == r.n2 == r["size"] and r["size"] in (100, n % 100)


# -- errors and draws ---------------------------------------------------------


def test_weighted_errors(spark):
    """Rows 0 and 1 are judged right and wrong by the other members; weights of 1 change nothing."""
    config = CoTrainConfig(n_classes=2, n_members=3)
    good, bad = [[1.0, 0.0]] * 3, [[0.0, 1.0]] * 3
    rows = [(0, [0, 0, 0], good, 0.1), (0, [0, 0, 0], bad, 0.7), (1, [0, 0, 0], bad, 0.3), (1, [1, 1, 1], good, 9.0)]
    table = spark.createDataFrame(rows, "label INT, bag ARRAY<INT>, votes ARRAY<ARRAY<DOUBLE>>, w DOUBLE")
    weighed = rounds.out_of_bag_errors(rounds.labelled_errors(table, config, "w")).collect()
    assert all(r.counted == math.fsum([0.1, 0.7, 0.3]) and r.wrong == 0.7 and r.err == 0.7 / r.counted for r in weighed)
    ones = rounds.out_of_bag_errors(rounds.labelled_errors(table.withColumn("w", F.lit(1.0)), config, "w")).collect()
    plain = rounds.out_of_bag_errors(rounds.labelled_errors(table, config)).collect()
    assert sorted(map(tuple, ones)) == sorted(map(tuple, plain))


def draw_order(i, k):
    h = hashlib.md5(f"{i}:1:sub:0:{k // 4}".encode()).hexdigest()
    return int(h[8 * (k % 4) : 8 * (k % 4) + 8], 16), i


@pytest.mark.parametrize("kind", ["ones", "fractions", "heavy", "zeros"])
def test_weighted_draw_stops_at_the_weight(spark, kind):
    rng = random.Random(kind)
    weight = {"ones": lambda: 1.0, "fractions": lambda: rng.choice([0.1, 0.8, 5 / 6]), "heavy": lambda: rng.random() ** -2, "zeros": lambda: float(rng.randint(0, 1))}[kind]
    weights = {i: weight() for i in range(2500)}
    rows = spark.createDataFrame(list(weights.items()), "row_id LONG, weight DOUBLE")
    whole = math.fsum(weights.values())
    sizes = {0: 0, 1: math.floor(whole / 9), 3: math.floor(whole / 2), 4: math.ceil(whole)}
    seen = []
    for parts in (1, 7):
        drawn = subsample.weighted_draw(rows.repartition(parts), sizes, whole, 5).collect()
        seen.append({k: {r.row_id for r in drawn if r.drawn[k]} for k in range(5)})
    assert seen[0] == seen[1] and seen[0][2] == set()
    for k, n in sizes.items():
        expected, upto = set(), []
        for i in sorted(weights, key=lambda i: draw_order(i, k)):
            upto.append(weights[i])
            if math.fsum(upto) > n:
                break
            expected.add(i)
        assert seen[0][k] == expected
    if kind == "ones":
        exact = subsample.exact_draw(rows, sizes, 2500, 5).collect()
        assert {k: {r.row_id for r in exact if r.drawn[k]} for k in range(5)} == seen[0]


# -- whole loops --------------------------------------------------------------


@pytest.mark.parametrize("preset", ["spark", "paper"])
def test_weights_of_one_change_no_loop(spark, testdata, preset):
    docs = views.docs_flags(spark, f"{testdata}/sf0.001").withColumn("w", F.lit(1.0))
    members = q.flag_members()
    config = CoTrainConfig.preset(preset, q.C, threshold=0.6, init_s_prime=20.0, max_rounds=3, bootstrap="poisson")
    plain, weighed = (
        cotrain(docs.filter("row_id % 4 = 0"), docs.filter("row_id % 4 > 0").drop("label"), members, c).rounds
        for c in (config, replace(config, weight_col="w"))
    )
    assert weighed == plain


def test_a_row_of_weight_two_is_like_two_rows_for_the_errors(spark, testdata):
    docs = views.docs_flags(spark, f"{testdata}/sf0.001").withColumn("w", F.lit(2.0))
    members = q.flag_members()
    config = CoTrainConfig(q.C, max_rounds=1, weight_col="w", bootstrap="exact", init_s_prime=None, subsample="exact")
    first = cotrain(docs.filter("row_id % 4 = 0"), docs.filter("row_id % 4 > 0").drop("label"), members, config)
    other = cotrain(
        docs.filter("row_id % 4 = 0").withColumn("w", F.lit(1.0)),
        docs.filter("row_id % 4 > 0").drop("label").withColumn("w", F.lit(1.0)),
        members,
        config,
    )
    assert first.n_unlabelled == 2 * other.n_unlabelled
    assert [r["err"] for r in first.rounds] == [r["err"] for r in other.rounds]
