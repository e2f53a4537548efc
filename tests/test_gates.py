"""Update rules: edge cases and a replay of a published run."""

import pytest
from pyspark.sql import functions as F

from peerlabel.config import CoTrainConfig, subspace_size
from peerlabel.functions import gates
from peerlabel.plans.cotrain import close_round, open_round

# A published run with 5 members and 44,934 unlabelled rows.
# round, member, out-of-bag error, rows drawn, their weight, updated;
# None where the member was turned away before drawing.
UNLABELLED = 44934
DECISIONS = [
    (0, 0, 0.044566253574833174, 1121, 1096.0, True),
    (0, 1, 0.05050984111927911, 989, 996.0, False),
    (0, 2, 0.051585423568386184, 969, 987.0, False),
    (0, 3, 0.052029864675688285, 960, 987.0, False),
    (0, 4, 0.04728132387706856, 1057, 999.0, True),
    (1, 0, 0.03163361661945231, 1544, 1577.0, False),
    (1, 1, 0.02353494939985879, 2124, 2172.0, False),
    (1, 2, 0.022700401986285174, 2202, 2185.0, True),
    (1, 3, 0.020455602045560205, 2444, 2454.0, False),
    (1, 4, 0.03583138173302108, 1318, 1261.0, True),
    (2, 0, 0.01941974730931212, 2515, 2525.0, False),
    (2, 1, 0.008557166627050155, 5843, 5913.0, False),
    (2, 2, 0.02429245283018868, None, None, False),
    (2, 3, 0.011108484991727724, 4501, 4349.0, True),
    (2, 4, 0.02203469292076887, 2050, 1977.0, True),
    (3, 0, 0.00942507068803016, 5182, 5214.0, False),
    (3, 1, 0.0, 44934, 44934.0, True),
    (3, 2, 0.01118781242561295, 4433, 4548.0, False),
    (3, 3, 0.01050420168067227, 4599, 4481.0, True),
    (3, 4, 0.010397412199630314, 4189, 4194.0, False),
    (4, 0, 2.3430178069353328e-4, 44934, 44934.0, True),
    (4, 1, 0.0, None, None, False),
    (4, 2, 4.7404598246029864e-4, 44934, 44934.0, True),
    (4, 3, 0.0, 44934, 44934.0, True),
    (4, 4, 0.0, 44934, 44934.0, True),
    (5, 0, 0.0018674136321195146, None, None, False),
    (5, 1, 0.003058823529411765, None, None, False),
    (5, 2, 0.0027945971122496508, None, None, False),
    (5, 3, 0.001876172607879925, None, None, False),
    (5, 4, 0.0018885741265344666, None, None, False),
]


def test_published_run_is_reproduced(spark):
    state = {k: (0.5, 0.0) for k in range(5)}
    for round_no in range(6):
        published = {d[1]: d for d in DECISIONS if d[0] == round_no}
        rows = [(k, published[k][2], *state[k], published[k][4] or 0.0) for k in range(5)]
        table = spark.createDataFrame(rows, "k INT, err DOUBLE, err_prev DOUBLE, s_prev DOUBLE, s DOUBLE")
        # Every confidence was 1, so the set's size equals its weight.
        sized = open_round(table, 100.0, UNLABELLED).withColumn("li_size", F.col("s").cast("bigint"))
        for row in close_round(sized).collect():
            _, _, err, n, s, updated = published[row.k]
            assert row.gate1 == (n is not None)
            assert row.n == (n or 0)
            assert row.updated == updated
            state[row.k] = (err, s) if updated else (row.err_prev, row.s_prev)


def closed(spark, err, err_prev, s_prev, li_size, s, n_unlabelled=1000):
    table = spark.createDataFrame(
        [(0, err, err_prev, s_prev, li_size, s)],
        "k INT, err DOUBLE, err_prev DOUBLE, s_prev DOUBLE, li_size BIGINT, s DOUBLE",
    )
    return close_round(open_round(table, 100.0, n_unlabelled)).first()


def test_no_error_draws_everything(spark):
    assert closed(spark, 0.0, 0.5, 100.0, 10, 10.0, UNLABELLED).n == UNLABELLED


def test_empty_set_keeps_initial_weight(spark):
    row = closed(spark, 0.1, 0.5, 0.0, 0, 0.0)
    assert row.gate1 and not row.gate2 and row.s_prev == 100.0 and not row.updated


def test_unknown_error_closes_gate_one(spark):
    row = closed(spark, None, 0.5, 0.0, 0, 0.0)
    assert not row.gate1 and row.n == 0 and row.s_prev == 0.0 and not row.updated


def test_over_draw_is_refused(spark):
    assert not closed(spark, 0.05050984111927911, 0.5, 100.0, 996, 996.0).gate3
    assert closed(spark, 0.05050984111927911, 0.5, 100.0, 989, 989.0).gate3


def test_tiny_error_does_not_overflow(spark):
    assert closed(spark, 1e-300, 0.5, 100.0, 10, 10.0, 50).n == 50


@pytest.mark.parametrize("m,ceil,floor", [(1, 1, 2), (8, 4, 4), (64, 7, 7), (784, 11, 10)])
def test_subspace_sizes(spark, m, ceil, floor):
    row = spark.range(1).select(
        gates.subspace_size_ceil(F.lit(m)).alias("a"), gates.subspace_size_floor(F.lit(m)).alias("b")
    ).first()
    assert (row.a, row.b) == (ceil, floor)
    assert subspace_size(m) == ceil and subspace_size(m, rule="floor") == floor
    assert subspace_size(m, given=3) == 3


@pytest.mark.parametrize(
    "options",
    [
        {"n_classes": 1},
        {"n_members": 1},
        {"init_s_prime": 0.0},
        {"init_s_prime": -5.0},
        {"max_rounds": 0},
        {"normaliser": "softmax"},
        {"subsample": "some"},
        {"bootstrap": "none"},
        {"threshold": -0.1},
        {"parallelism": 0},
    ],
)
def test_bad_settings_are_rejected(options):
    with pytest.raises(ValueError):
        CoTrainConfig(**{"n_classes": 3, **options})


def test_presets():
    spark_like, paper = CoTrainConfig.preset("spark", 3), CoTrainConfig.preset("paper", 3)
    assert spark_like.threshold == 0.75 and spark_like.normaliser == "minmax"
    assert spark_like.subsample == "bernoulli" and not spark_like.retrain_weights
    assert paper.normaliser == "sum" and paper.subsample == "exact" and paper.bootstrap == "exact"
    assert paper.retrain_weights and paper.starting_weight(500) == 50 and paper.starting_weight(5000) == 100
    assert spark_like.for_members(4).n_members == 4
    with pytest.raises(ValueError):
        CoTrainConfig(n_classes=3, n_members=5).for_members(4)
