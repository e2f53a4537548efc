"""Steps of all orders against a walk over the documents themselves."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from conftest_llm import with_clashes
from peerlabel.llm.filter_audit import FilterAudit, contract

LABELS = "doc_id LONG, quality INT, toxic INT"


def fails_of(docs):
    """By the words of the contract, one document at a time."""
    smallest = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            smallest[text or ""] = min(smallest.get(text or "", doc_id), doc_id)
    for doc_id, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        yield (
            len(words) < 100,
            100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            bool(re.search(r"[#$%&*|]", text)),
            doc_id is not None and doc_id > smallest[text],
        )


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    by_part = {}
    for doc, fails in zip(docs, fails_of(docs), strict=True):
        by_part.setdefault(doc[2] or "", []).append((doc[0], fails))
    out = {}
    for part, members in by_part.items():
        total = dict.fromkeys(range(5), 0)
        for order in permutations(range(5)):
            left, gone = members, []
            for step, f in enumerate(order, 1):
                removed = [m for m in left if m[1][f]]
                out[part, "".join("ABCDE"[i] for i in order), step] = [
                    len(left) - len(removed),
                    len(removed),
                    sum(m[1][f] for m in gone),
                    sum(m[1][f] and sum(m[1]) == 1 for m in members),
                    sum(m[0] in good for m in removed),
                    sum(m[0] in toxic for m in removed),
                ]
                total[f] += len(removed)
                gone, left = gone + removed, [m for m in left if not m[1][f]]
        for (p, order, step), row in out.items():
            if p == part and len(row) == 6:
                row.append(total["ABCDE".index(order[step - 1])])
    return {k: tuple(v) for k, v in out.items()}


def some(rng, n):
    words = [f"w{i}" for i in range(300)] + ["SHOUT", "LOUDER", "é", "#tag", "a&b"]
    texts = [None, "", " \n", "ONE"]
    for _ in range(n):
        size = rng.choice([1, 99, 100, 101, 150])
        few = rng.random() < 0.3
        text = " ".join(rng.choice(words[: 20 if few else 300]) for _ in range(size))
        if rng.random() < 0.3:
            text += " " + " ".join(rng.choice(words[300:]) for _ in range(rng.randint(1, 120)))
        texts.append(text)
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(3 * n)]
    docs += [rng.choice(docs) for _ in range(10)]  # repeated rows
    docs += [(d[0], "other", d[2]) for d in docs[:3]]  # ids that are not unique
    docs += [(None, rng.choice(texts), "en") for _ in range(5)]
    labels = [(rng.randint(0, 4 * n), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(2 * n)]
    return docs, [*labels, *labels[:5], (None, 1, 1)]


def found(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_every_order_and_step(spark, seed):
    docs, labels = some(random.Random(seed), 60)
    table = spark.createDataFrame(docs, "doc_id LONG, text STRING, lang STRING").repartition(5)
    table = with_clashes(table, "part", "cell", "n", "good", "toxic", "digest", "first", "kept", "quality")
    marks = with_clashes(spark.createDataFrame(labels, LABELS), "text", "lang", "part", "n", "labelled")
    got = FilterAudit().audit(table, marks)
    assert got.schema.simpleString().startswith("struct<part:string,filter_order:string,step:int,kept:bigint")
    expected = brute(docs, labels)
    assert len(expected) == 600 * 3 and found(got) == expected


def test_a_part_without_removals_has_all_its_rows(spark):
    docs = [(1, " ".join(f"w{i}" for i in range(120)), "en")]
    got = found(FilterAudit().audit(spark.createDataFrame(docs, "doc_id LONG, text STRING, lang STRING"), spark.createDataFrame([], LABELS)))
    assert len(got) == 600 and set(got.values()) == {(1, 0, 0, 0, 0, 0, 0)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id LONG, text STRING, lang STRING")
    assert FilterAudit().audit(empty, spark.createDataFrame([], LABELS)).count() == 0


def test_contraction_of_other_numbers_of_filters(spark):
    """Two filters: 3 rows pass both, 5 fail y, 7 fail x, 11 fail both."""
    rows = [("p", 0, 3, 0, 0), ("p", 1, 5, 1, 0), ("p", 2, 7, 2, 0), ("p", 3, 11, 4, 1)]
    tally = spark.createDataFrame(rows, "part STRING, cell INT, n LONG, good LONG, toxic LONG")
    assert found(contract(tally, "xy")) == {
        ("p", "xy", 1): (8, 18, 0, 7, 6, 1, 18 + 7),
        ("p", "xy", 2): (3, 5, 11, 5, 1, 0, 5 + 16),
        ("p", "yx", 1): (10, 16, 0, 5, 5, 1, 5 + 16),
        ("p", "yx", 2): (3, 7, 11, 7, 2, 0, 18 + 7),
    }


def test_copies_meet_as_sums(spark):
    """Thousands of copies of a text are a few rows where the smallest id is found."""
    docs = spark.range(0, 20000, 1, 6).select(F.col("id").alias("doc_id"), F.lit("same " * 120).alias("text"), F.lit("en").alias("lang"))
    got = found(FilterAudit().audit(docs, spark.createDataFrame([(0, 1, 0), (5, 1, 0)], LABELS)))
    assert got["en", "EABCD", 1] == (1, 19999, 0, 0, 1, 0, 60 * 19999)  # B fails all, so E removes in the orders that have it first
    assert got["en", "BEACD", 1][:2] == (0, 20000)
