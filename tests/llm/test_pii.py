"""Rules against regular expressions; the CRF on held-out and on altered texts."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import with_clashes
from peerlabel.llm import crf, pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def brute(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_rules_match_the_patterns():
    rng = random.Random(4)
    parts = ["@", "a", "b.c", ".", "-", "+", "1", "255", "256", "4111111111111111", "4111 1111 1111 1111", " ", "(", ")", "é", "00000001", "%", "\n", "5-5"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.rule_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    assert pii.rule_spans("a" * 200_000 + "@") == []
    assert pii.rule_spans("@" * 200_000) == []
    assert len(pii.rule_spans("a@b.c " * 20_000)) == 20_000


def test_gradient_of_the_field():
    """Expected counts are the derivative of the log partition function."""
    rng = np.random.default_rng(0)
    e, moves = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3))
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)

    def log_z(e, moves):
        total = 0.0
        for b in range(3):
            alpha = e[b, 0]
            for t in range(1, mask[b].sum()):
                alpha = np.log(np.exp(alpha[:, None] + moves).sum(0)) + e[b, t]
            total += np.log(np.exp(alpha).sum())
        return total

    node, edge = crf.expectations(e, moves, mask)
    step = 1e-6
    for b, t, y in ((0, 2, 1), (1, 1, 0), (2, 0, 2)):
        more = e.copy()
        more[b, t, y] += step
        assert node[b, t, y] == pytest.approx((log_z(more, moves) - log_z(e, moves)) / step, abs=1e-4)
    more = moves.copy()
    more[1, 2] += step
    assert edge[1, 2] == pytest.approx((log_z(e, more) - log_z(e, moves)) / step, abs=1e-4)


def test_viterbi_against_all_paths_and_certain_words():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(60):
        n, t = 3, int(rng.integers(1, 6))
        e, moves = rng.normal(size=(1, t, n)) * 2, rng.normal(size=(n, n))
        before, after = rng.integers(0, 2, 1).astype(float), rng.integers(0, 2, 1).astype(float)

        def score(p):
            s = sum(e[0, i, y] for i, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False))
            return s + before[0] * moves[0, p[0]] + after[0] * moves[p[-1], 0]

        best = max(itertools.product(range(n), repeat=t), key=score)
        path, gain = crf.viterbi(e, moves, np.array([t]), (before, after))
        assert tuple(path[0]) == best and gain[0] == pytest.approx(score(best) - score((0,) * t))
        sure = crf.Crf((1,), np.zeros((1, n)), moves).certain(e[0])
        assert all(best[i] == 0 for i in np.flatnonzero(sure))


@pytest.fixture(scope="module")
def model(spark, testdata):
    return pii.PiiFinder().train(spark.read.parquet(f"{testdata}/sf0.1/documents.parquet"))


def test_model_finds_held_out_data(spark, testdata, model):
    """On documents it was not trained on, the field alone finds what the rules find."""
    docs = spark.read.parquet(f"{testdata}/sf0.01/documents.parquet").where("text RLIKE '[0-9@]'")
    import pyarrow as pa

    from peerlabel.llm import bytewords

    hit = total = wrong = 0
    texts = [r.text for r in docs.select("text").collect()]
    for words in bytewords.split(pa.array(texts), bytewords.NOT_SPACE, hashed=False):
        found = pii.added_spans(words, model, 4.0)
        for t in range(len(words)):
            raw = texts[words.row0 + t].encode()
            base = [(len(texts[words.row0 + t][:s].encode()), len(texts[words.row0 + t][:e].encode())) for _, s, e in pii.rule_spans(texts[words.row0 + t])]
            mine = [(s, e) for _, s, e in found.get(t, [])]
            total += len(base)
            hit += sum(any(a < e and s < b for a, b in mine) for s, e in base)
            wrong += sum(not any(a < e and s < b for s, e in base) for a, b in mine)
            assert all(0 <= a < b <= len(raw) for a, b in mine)
    assert total >= 80 and hit >= 0.9 * total and wrong <= 0.05 * total


def test_no_rule_reads_rewritten_forms():
    rng = random.Random(8)
    found = {0: "some.one+x@mail4.example.com", 1: "97.51.17.173", 2: "4111 1111 1111 1111", 3: "+1 (017) 555-7713"}
    for kind, text in found.items():
        assert brute(text) == [(kind, 0, len(text))]
        forms = {pii.rewritten(kind, text, rng) for _ in range(300)} - {None}
        assert len(forms) >= 5
        for form in forms:
            assert brute(form) == [], form
            line = f"see {text}, or {text} now"
            shown, spans = pii.with_rewritten(line, brute(line), rng, 1.0)
            assert len(spans) == 2 and all(shown[s:e] != "" for _, s, e in spans)
            assert re.sub("|".join(re.escape(shown[s:e]) for _, s, e in spans), "X", shown) == "see X, or X now"
    assert pii.with_rewritten("+4111 1111 1111 1111", [(2, 1, 20), (3, 0, 20)], rng, 1.0) == (
        "+4111 1111 1111 1111", [(3, 0, 20)]
    )


def test_model_finds_forms_that_no_rule_reads(testdata, spark, model):
    """Held-out recall on rewritten forms, by kind, and ordinary numbers left alone."""
    import pyarrow as pa

    rows = spark.read.parquet(f"{testdata}/sf0.01/documents.parquet").where("text RLIKE '[0-9@]'").orderBy("doc_id").collect()
    rng = random.Random(77)
    made = [pii.with_rewritten(r.text, pii.rule_spans(r.text), rng, 1.0) for r in rows]
    total, hit = [0] * 4, [0] * 4
    for (text, spans), found in zip(made, pii.find_spans(pa.array([t for t, _ in made]), model, 4.0), strict=True):
        for kind, start, end in spans:
            total[kind] += 1
            hit[kind] += any(k == kind and s < end and start < e for k, s, e, _ in found)
    assert sum(total) >= 80 and sum(hit) >= 0.9 * sum(total), (hit, total)
    assert all(h >= 0.8 * t for h, t in zip(hit, total, strict=True)), (hit, total)
    plain = [f"It was {pii.ordinary(rng)} when we came to the house" for _ in range(2000)]
    wrong = sum(bool(found) for found in pii.find_spans(pa.array(plain), model, 4.0))
    assert wrong <= 0.02 * len(plain), wrong


def test_added_spans_and_redaction(spark, docs_of, model):
    texts = [
        "call +1 (017) 555-7713 or write to some.one@mail4.example.com now",
        "the number 4417744280351547 99 is there",  # the rule takes 99 as part of it
        "nothing here at all, version 2.0 of 1999",
        None,
        "",
        "é" * 3000 + " 97.51.17.173 " + "word " * 3000,
    ]
    finder = pii.PiiFinder()
    docs = with_clashes(docs_of(texts), "id", "spans", "rule")
    got = {r.doc_id: r for r in finder.find(docs, model, redact=True, keep=("lang",)).collect()}
    assert got[0].text == "call [PHONE] or write to [EMAIL] now"
    assert [s.kind for s in got[0].spans] == ["email", "phone"] and got[0].lang == "en"
    assert got[2].text == texts[2] and got[2].spans == []
    assert got[3].text is None and got[4].text == "" and got[3].spans == []
    assert got[5].text == "é" * 3000 + " [IP] " + "word " * 3000
    for r in got.values():
        base = [(pii.KINDS[k], s, e) for k, s, e in brute(texts[r.doc_id] or "")]
        assert [(s.kind, s.start, s.end) for s in r.spans if s.rule] == base
        assert not [1 for s in r.spans for o in r.spans if s is not o and not s.rule and s.start < o.end and o.start < s.end]
    plain = finder.find(docs, None).collect()
    assert all(s.rule for r in plain for s in r.spans)


def test_no_training_data(spark, docs_of):
    finder = pii.PiiFinder()
    assert finder.train(docs_of(["no numbers", None, ""])) is None
    assert finder.train(docs_of([]).limit(0)) is None
    assert finder.find(docs_of([]).limit(0), None).count() == 0
    assert finder.train(docs_of(["room 12"])) is None


def test_query(spark, testdata):
    import hashlib

    folder = f"{testdata}/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op7_personal_data(spark, folder).collect():
        base = brute(texts[r.doc_id])
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert set(listed) <= set(r.spans.split(",")) or not listed


def test_overlapping_spans_are_cut_once():
    assert pii.redacted("a 1.2.3.4 b", [(1, 2, 9, True), (2, 4, 9, True)]) == "a [IP] b"
    assert pii.redacted("abcdef", [(0, 0, 3, True), (3, 2, 5, True)]) == "[EMAIL]f"
    assert F is not None


def test_sample_does_not_depend_on_the_layout(spark, docs_of):
    """The same runs from any partitioning, and no text takes the sample of the others."""
    long = " ".join(f"number {i} of very many plain words in a row here and there" for i in range(3000))
    texts = [long] + [f"write to user{i}@example.org or call +1 (555) 010-{1000 + i} from 10.0.0.{i} today" for i in range(60)]
    finder = pii.PiiFinder(sample_runs=200)

    def runs(n_partitions):
        docs = docs_of(texts).repartition(n_partitions).orderBy("doc_id" if n_partitions == 1 else F.rand(3))
        return sorted((str(r.features), str(r.labels)) for r in finder.labelled_runs(docs).collect())

    one = runs(1)
    assert one == runs(7)
    assert len(one) == 60 + finder.text_runs
    assert sum(any(c in labels for c in "12345678") for _, labels in one) == 60
