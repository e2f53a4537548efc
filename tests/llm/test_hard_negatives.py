"""Mined rows against all pairs; bounds against exact scores."""

import math
import random

import numpy as np
import pytest

from conftest_llm import with_clashes
from peerlabel.llm import hard_negatives as hn

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"


def brute(rows):
    valid = []
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        valid.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    last = hn.NO_ID
    out = []
    for i, v, label in valid:
        if i is None or i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), last if j is None else j, k) for j, w, k in valid if j != i]
        for score, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fit = sorted(s for s in scored if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score)[:10]
            out += [(i, None if j == last else j, r, None if n == last else n, -score, -s) for r, (s, n, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(df, **options):
    found = hn.HardNegatives(**options).mine(df)
    assert found.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    return sorted((tuple(r) for r in found.collect()), key=str)


def rows_of(rng, n, dim, n_centres=6, spread=0.1):
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(n_centres)]
    out = []
    for i in range(n):
        centre = rng.choice(centres)
        out.append((i, [float(np.float32(c + rng.gauss(0, spread))) for c in centre], rng.randint(0, 9)))
    return out


@pytest.mark.parametrize("dim", [1, 3, 64, 100])
def test_all_pairs(spark, dim):
    rows = rows_of(random.Random(dim), 900, dim)
    df = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(4), "id", "v", "vector", "code", "anchor", "rank", "score")
    assert mined(df) == brute(rows)


@pytest.mark.parametrize("block", [1, 4, 100])
def test_blocks_of_anchors(spark, block):
    rows = rows_of(random.Random(9), 1200, 16)
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block) == brute(rows)


def test_nulls_ties_repeats_and_short_vectors(spark):
    rng = random.Random(4)
    rows = rows_of(rng, 500, 8, n_centres=2, spread=0.0)  # two vectors only: ties everywhere
    rows += rows[:120] + [(100, [0.5] * 8, 3), (200, [0.1] * 3, 4), (300, [], 4), (4001, [0.2] * 20, 5)]
    rows += [(None, rng.choice(rows)[1], rng.randint(0, 9)) for _ in range(40)]
    rows += [(600, None, 1), (700, [0.1] * 8, None), (800, [0.1, None] * 4, 1), (900, [float("nan")] * 8, 1), (1000, [float("inf")] * 8, 1)]
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_one_hot_label_and_vector(spark):
    rows = [(i, [0.25] * 8, 1) for i in range(3000)] + [(i, [0.2 + (i % 5) / 100] * 8, i % 10) for i in range(3000, 4000)]
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(6)) == brute(rows)


def test_empty_table_and_no_anchor(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 2)], SCHEMA)) == []


def test_huge_components_are_scored_exactly(spark):
    big = [(0, [3e5] * 4, 1), (1, [3e5, 3e5, 3e5, 2.9e5], 1), (2, [1.5e5] * 4, 2), (3, [2.5e5] * 4, 2), (4, [1e-3] * 4, 2)]
    rows = [(i * 100 if i == 0 else i, v, k) for i, v, k in big]
    doubles = "vec_id LONG, embedding ARRAY<DOUBLE>, label INT"
    got = mined(spark.createDataFrame([(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows], doubles))
    assert got == brute(rows)
    beyond = [(0, [1e300] * 2, 1), (1, [1e300] * 2, 2), (2, [1e300] * 2, 1), (3, [1e308] * 2, 1)]
    assert mined(spark.createDataFrame(beyond, doubles)) == []  # the scores of both are the greatest long


@pytest.mark.parametrize("dim", [1, 7, 64, 130])
def test_intervals_hold_every_score(dim):
    rng = np.random.default_rng(dim)
    vectors = np.floor(rng.standard_normal((300, dim)) * rng.choice([0, 1, 30, 3000], (300, 1)))
    turned = vectors @ hn.rotation(dim, 11)
    along = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    rest = np.sqrt(np.maximum((vectors**2).sum(axis=1) - along**2, 0))
    codes = hn.Codes(np.arange(300), np.zeros(300, np.int64), vectors, hn.words_of((turned >= 0).astype(np.uint8)), along, rest)
    low, high = hn.Queries.of(codes, 11).bounds(codes)
    exact = vectors @ vectors.T
    assert (low <= exact).all() and (exact <= high).all()
    norms = np.sqrt((vectors**2).sum(axis=1))
    if dim > 1:  # and say something: narrower than the product of the lengths
        assert (high - low).sum() < 1.5 * (norms[:, None] * norms).sum()


def test_few_pairs_are_scored(monkeypatch):
    """Where neighbours stand out, most intervals end below what is still asked for."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 64)) * 100
    vectors = np.floor(centres[rng.integers(0, 40, 20000)] + rng.standard_normal((20000, 64)) * 20)
    turned = vectors @ hn.rotation(64, 11)
    along = np.abs(turned).sum(axis=1) / 8
    codes = hn.Codes(np.arange(20000), np.arange(20000) % 3, vectors, hn.words_of((turned >= 0).astype(np.uint8)), along, np.sqrt((vectors**2).sum(axis=1) - along**2))
    seen, plain = [], hn.scores
    monkeypatch.setattr(hn, "scores", lambda a, v: seen.append(len(v)) or plain(a, v))
    search = hn.Search(hn.Queries.of(codes.part(slice(0, 20)), 11), [[(hn.LEAST, hn.MOST)]] * 20, True, 5)
    search.add(codes)
    assert sum(seen) < 0.2 * 20 * 20000 / 3
