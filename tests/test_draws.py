"""Splits, bags and subsamples: sizes, reproducibility, brute force."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from peerlabel.functions.hashing import row_key, uniform, wide_words
from peerlabel.operators import bags, subsample
from peerlabel.sources import splits

N = 5000


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(N).select((F.col("id") * 7 + 3).alias("row_id"))


def test_uniform_is_the_leading_digest_word(spark):
    got = spark.range(1).select(uniform(F.lit(42), "1:split")).first()[0]
    expected = int(hashlib.md5(b"42:1:split:0").hexdigest()[:8], 16) / 2**32
    assert got == expected


def test_split_is_stable_and_complete(ids):
    one = splits.with_part(ids.repartition(7), splits.TENTH_AND_TEST)
    two = splits.with_part(ids.coalesce(1), splits.TENTH_AND_TEST)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    sizes = {r.part: r.n_rows for r in splits.part_sizes(one).collect()}
    assert sum(sizes.values()) == N
    assert abs(sizes["labelled"] - 0.08 * N) < 5 * math.sqrt(0.08 * 0.92 * N)
    assert abs(sizes["test"] - 0.2 * N) < 5 * math.sqrt(0.2 * 0.8 * N)


def test_split_weights_are_scaled():
    assert splits.boundaries({"a": 1, "b": 3}) == [("a", 0.25), ("b", 1.0)]
    with pytest.raises(ValueError):
        splits.boundaries({"a": -1, "b": 2})


def test_row_key_tells_rows_apart(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "x"), ("x", None)], "p STRING, q STRING")
    assert rows.select(row_key(["p", "q"])).distinct().count() == 4


def test_small_shares_are_not_rounded_up(spark):
    """A draw of 100 of 10^12 rows accepts that share of the words, to 2^-52."""
    for size, n in ((100, 10**12), (1, 3 * 10**9), (5, 5), (7, 3), (0, 9)):
        accepted = subsample.words_accepted(size, n) / 2**52
        assert 0 <= accepted - min(1, size / n) <= 2**-52
    word = spark.range(1).select(wide_words(F.lit(42), "1:sub:0", 3)[2]).first()[0]
    assert word == int(hashlib.md5(b"42:1:sub:0:1").hexdigest()[:13], 16)


def test_poisson_bags(ids):
    bagged = bags.poisson_bags(ids.repartition(6), 6, seed=5)
    again = bags.poisson_bags(ids.coalesce(2), 6, seed=5)
    assert sorted(map(tuple, bagged.select("row_id", "bag").collect())) == sorted(
        map(tuple, again.select("row_id", "bag").collect())
    )
    for row in bags.bag_summary(bagged, 6).collect():
        assert abs(row.bag_size - N) < 5 * math.sqrt(N)
        assert row.in_bag_rows + row.out_of_bag_rows == N
        assert abs(row.out_of_bag_rows / N - math.exp(-1)) < 0.04


def test_members_draw_independently(ids):
    correlation = bags.poisson_bags(ids, 6).agg(
        *[F.corr(F.col("bag")[a], F.col("bag")[b]).alias(f"c{a}{b}") for a, b in ((0, 1), (1, 4), (3, 5))]
    ).first()
    assert all(abs(c) < 0.08 for c in correlation)


def test_exact_bags_draw_n_of_n(ids):
    bagged = bags.exact_bags(ids, 3)
    rows = bagged.collect()
    assert len(rows) == N and len({r.row_id for r in rows}) == N
    for k in range(3):
        assert sum(r.bag[k] for r in rows) == N


def test_dense_positions(ids):
    positions = [r.pos for r in bags.with_dense_position(ids, N).select("pos").collect()]
    assert sorted(positions) == list(range(N))


def test_expanded_rows_equal_weights(ids):
    bagged = bags.poisson_bags(ids, 2)
    repeated = Counter(r.row_id for r in bags.in_bag_rows(bagged, 1, expand=True).collect())
    weighted = {r.row_id: r.weight for r in bags.in_bag_rows(bagged, 1).collect()}
    assert repeated == weighted
    joint = bags.in_bag_rows_of_all(bagged, [0, 1]).filter("k = 1").select("row_id", "weight").collect()
    assert {r.row_id: r.weight for r in joint} == weighted


def drawn(table, k):
    return {r.row_id for r in table.filter(F.col("drawn")[k]).collect()}


@pytest.mark.parametrize("method", ["bernoulli", "exact"])
def test_draws_do_not_depend_on_partitions(ids, method):
    sizes = {0: 40, 2: 3000}
    one = subsample.draw(method, ids.repartition(9), sizes, N, 3, round_no=2)
    two = subsample.draw(method, ids.coalesce(1), sizes, N, 3, round_no=2)
    assert all(drawn(one, k) == drawn(two, k) for k in range(3))
    assert drawn(one, 1) == set()


def test_exact_draw_sizes(ids):
    table = subsample.exact_draw(ids, {0: 0, 1: 1, 2: 777, 3: N, 4: N + 5}, N, 5)
    assert [len(drawn(table, k)) for k in range(5)] == [0, 1, 777, N, N]


def test_exact_draw_with_equal_hash_words(ids, monkeypatch):
    """Ties in the hash are settled by row id, whatever their number."""
    monkeypatch.setattr(subsample, "words", lambda row_id, salt, n: [F.lit(123456).cast("bigint")] * n)
    table = subsample.exact_draw(ids, {0: 50}, N, 1)
    assert drawn(table, 0) == {i * 7 + 3 for i in range(50)}


def test_exact_draw_matches_sorting(ids):
    got = drawn(subsample.exact_draw(ids, {0: 300}, N, 1, seed=9, round_no=1), 0)

    def rank(i):
        return int(hashlib.md5(f"{i}:9:sub:1:0".encode()).hexdigest()[:8], 16), i

    assert got == set(sorted((i * 7 + 3 for i in range(N)), key=rank)[:300])


@pytest.mark.parametrize("n", [1, 7, 2500, N - 1])
def test_both_ways_to_the_cut_agree(ids, n):
    hashed = subsample._with_words(ids, [0, 2], 3, 4, 1, "row_id")
    near = subsample._cuts_near_expectation(hashed, {0: n, 2: n}, "row_id", N)
    assert set(near) == {0, 2}
    assert near == subsample._cuts_by_histogram(hashed, {0: n, 2: n}, "row_id", N)


def test_nothing_to_draw(ids):
    assert subsample.bernoulli_draw(ids, {}, N, 3).count() == 0
