"""The grammar's round trip on adversarial texts; the mask against the sources."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from conftest_llm import with_clashes
from peerlabel.llm.chat_format import ChatFormatter, loss_text, parse

SCHEMA = "conv_id LONG, turn INT, role STRING, text STRING"
BITS = ["\\", "#", "### ", "###", "<", "</turn>", "</turn>\n", "/turn>", ": ", ":", " ", "\n", "a", "é", "😀", "user", "\\\\", "\r", "$1"]


def read_back(made):
    return made.select(
        "conv_id", "n_turns", "formatted", "round_trip", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("learnt")
    ).collect()


def source_of(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [(r, t) for *_, r, t in sorted(turns)] for conv, turns in by_conv.items()}


def check(found, rows):
    source = source_of(rows)
    assert {r.conv_id for r in found} == set(source) and len(found) == len(source)
    for r in found:
        turns = source[r.conv_id]
        assert r.round_trip and r.n_turns == len(turns)
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.learnt == "".join(text for role, text in turns if role == "assistant")


@pytest.mark.parametrize("seed", range(4))
def test_adversarial_texts(spark, seed):
    rng = random.Random(seed)

    def text():
        return rng.choice([None, "", "".join(rng.choice(BITS) for _ in range(rng.randint(1, 12)))])

    rows = [(rng.randint(0, 150), rng.randint(0, 4), rng.choice(["user", "assistant", "assistant", text()]), text()) for _ in range(900)]
    rows += [(None, 1, "assistant", "a"), (None, None, None, None), (3, None, "assistant", "\\"), *rows[:20]]
    table = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(5), "formatted", "loss", "n_turns", "header", "body", "place", "of", "span")
    check(read_back(ChatFormatter().format(table)), rows)


def test_only_what_conflicts_is_escaped(spark):
    plain = ["clean", "C:\\new \\ folder", "#hash ## and < or \\n", "a:b"]
    hard = {"### x": 1, "a </turn> b": 1, "\\### Assistant: </turn> ok": 2, "ends in \\": 2, "\\#": 2}
    rows = [(i, 0, "user", t) for i, t in enumerate([*plain, *hard])] + [(99, 0, "a:b", "x")]
    made = {r.conv_id: r for r in ChatFormatter().turns(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in enumerate(plain):
        assert made[i].escapes == 0 and made[i].rendered == f"### user: {t}</turn>\n"
    for i, level in enumerate(hard.values(), len(plain)):
        assert made[i].escapes == level
    assert made[99].rendered == "### a\\:b: x</turn>\n"


def test_the_planted_conversation(spark):
    text = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    found = read_back(ChatFormatter().format(spark.createDataFrame(rows, SCHEMA)))
    check(found, rows)
    assert found[0].formatted == "".join(f"### {r}: \\\\\\### Assistant: \\</turn> ok</turn>\n" for r in ("user", "assistant"))


def test_faulty_texts_are_no_conversations(spark):
    faulty = ["x", "### user: a", "### user: a</turn>", "### user a</turn>\n", "### user: a</turn>\nrest", " ### user: a</turn>\n", "### user: ### a</turn>\n"]
    rows = spark.createDataFrame([(t,) for t in [*faulty, "", "### : </turn>\n"]], "t STRING").select("t", parse(F.col("t")).alias("turns")).collect()
    assert {r.t: r.turns for r in rows if r.turns is not None} == {"": [], "### : </turn>\n": [("", "")]}


def test_long_texts_and_many_turns(spark):
    """Nothing recurses with the length of a text, and reading spans is linear."""
    long = "word \\ # < ### é " * 60_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "assistant", "\\" * 300_000)]
    rows += [(2, i, "assistant" if i % 2 else "user", f"turn {i} é </turn>") for i in range(5000)]
    check(read_back(ChatFormatter().format(spark.createDataFrame(rows, SCHEMA))), rows)


def test_empty_table_and_plan(spark, testdata):
    assert ChatFormatter().format(spark.createDataFrame([], SCHEMA)).count() == 0
    made = ChatFormatter().format(spark.read.parquet(f"{testdata}/sf0.001/conversations.parquet"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("hashpartitioning") == 1  # the window and the texts share one exchange


def test_digests_of_the_query(spark, testdata):
    from peerlabel.llm.queries import conversations_of, op13_chat_format

    sf = f"{testdata}/sf0.001"
    rows = [tuple(r) for r in conversations_of(spark, sf).collect()]
    source = source_of(rows)
    for r in op13_chat_format(spark, sf).collect():
        listed = "".join(f"{role}\n{text}\n" for role, text in source[r.conv_id])
        assert r.turns_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.n_turns == len(source[r.conv_id])
    assert -7 in source
