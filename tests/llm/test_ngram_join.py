"""The join against all pairs of sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import with_clashes
from peerlabel.llm import ngram_join, queries
from peerlabel.llm.components import smallest_reachable


def sets_of(texts):
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        n = min(5, len(words))
        out.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set())
    return out


def brute(ids, texts):
    """Smallest id reachable, by all pairs."""
    sets = sets_of(texts)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda k: ids[k])
                root[b] = a
    return {ids[i]: (len(sets[i]), ids[find(i)]) for i in range(len(ids))}


def corpus(n, seed=3):
    """Near copies with words changed, passages in common, short and empty texts, ties."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 14, 40, 90, 300]))]
        if rng.random() < 0.3:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = [rng.choice(words)]
            texts.append(rng.choice([" ", "\n", "\t "]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return texts[: n - 4] + ["", None, " \n", texts[0]]


@pytest.mark.parametrize("options", [{}, {"leaf_points": 2, "group_pairs": 2, "dimensions": 4}])
def test_components_match_all_pairs(docs_of, options):
    texts = corpus(160)
    docs = with_clashes(docs_of(texts), "id", "n", "set_id", "cell", "hub")
    got = ngram_join.NgramJoin(**options).components(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(range(len(texts)), texts)


def test_a_large_group_and_a_chain(docs_of):
    """Many near copies of one text, and a chain in which neighbours only are similar."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    group = []
    for i in range(80):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{i}"
        group.append(" ".join(copy))
    chain = [" ".join(f"c{j}" for j in range(10 * i, 10 * i + 120)) for i in range(12)]
    texts = group + chain + [group[0]] * 10
    got = ngram_join.NgramJoin(leaf_points=8, group_pairs=7).components(docs_of(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(range(len(texts)), texts)


def test_null_and_repeated_ids_and_empty_tables(spark, docs_of):
    join = ngram_join.NgramJoin()
    text = "one two three four five six seven"
    rows = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text), (7, None), (None, None)], "doc_id LONG, text STRING")
    got = sorted(map(tuple, join.components(rows).collect()), key=str)
    assert got == sorted([(None, 3, None), (5, 3, 5), (5, 3, 5), (9, 3, 5), (7, 0, 7), (None, 0, None)], key=str)
    assert join.components(docs_of([""]).limit(0)).count() == 0


def test_cells_lose_no_link():
    rng = np.random.default_rng(1)
    linked = 0
    for trial in range(6000):
        n = int(rng.integers(1, 40)) if trial % 2 else int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        more = rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 2)), dtype=np.uint64)
        b = np.unique(np.concatenate([a[int(rng.integers(0, n // 4 + 2)) :], more]))
        both = len(np.intersect1d(a, b))
        if both and both * 180 >= 80 * (len(a) + len(b)):
            linked += 1
            # Whatever is taken for frequent, however often.
            some = np.unique(np.concatenate([rng.permutation(a)[: len(a) // 2], more[:3], a[:1]]))
            for frequent in (some[:0], some):
                order = frequent, rng.integers(2, 9, len(frequent))
                assert len(np.intersect1d(ngram_join.cells_of(a, 80, *order), ngram_join.cells_of(b, 80, *order)))
    assert linked > 500


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((30, 20), (60, 80), (40, 0)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 100 + n)]
        root = {v: v for pair in pairs for v in pair}
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                low = min(root[a], root[b])
                if (root[a], root[b]) != (low, low):
                    root[a] = root[b] = low
                    changed = True
        found = smallest_reachable(spark.createDataFrame(pairs, "a LONG, b LONG"))
        assert {r.id: r.root for r in found.collect()} == {v: r for v, r in root.items() if v != r}
    assert smallest_reachable(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


def test_plan_has_no_cross_join(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    join = ngram_join.NgramJoin()
    plan = join._mapped(docs, lambda n, found: [], "n long")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
    assert queries.op3_ngram_jaccard.__name__ == "op3_ngram_jaccard"


def test_repeated_ids_with_different_texts_lose_no_link(spark):
    """A near copy finds the text it copies, whichever of the rows of that id holds it."""
    rng = random.Random(12)
    a = [f"a{rng.randint(0, 900)}" for _ in range(150)]
    b = [f"b{rng.randint(0, 900)}" for _ in range(150)]
    near = lambda words, at: " ".join([*words[:at], "odd", *words[at:]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, near(a, 149)), (7, near(b, 149)), (9, "alone " * 3)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id LONG, text STRING").repartition(2)
        got = {(r.doc_id, r.component_id) for r in ngram_join.NgramJoin().components(docs).collect()}
        assert got == {(5, 5), (6, 5), (7, 5), (9, 9)}
