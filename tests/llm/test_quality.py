"""Counts against plain Python; thresholds against exact quantiles."""

import math
import random
import re
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest_llm import with_clashes
from peerlabel.llm import bytewords, quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    runs = {}
    for i in range(len(words) - 7):
        runs.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for places in runs.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered))


@pytest.mark.parametrize("chunk", [1, 50, 1 << 20])
def test_counts(monkeypatch, chunk):
    monkeypatch.setattr(bytewords, "CHUNK_BYTES", chunk)
    rng = random.Random(chunk)
    texts = [None, "", "\n\n", "a\na\n a\na", "x " * 9, "é€😀 \xa0 #|<", "a b c d e f g h " * 3 + "\n" + "a b c d e f g h", "z " * 20000]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", "é", "#", " a b c d e f g h"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    made = quality.count(pa.array(texts, pa.string()))
    assert list(zip(*(made[c].tolist() for c in quality.COUNTS), strict=True)) == [brute(t) for t in texts]


def corpus(docs_of):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(300)]

    def clean():
        return " ".join(rng.choice(words) for _ in range(rng.randint(30, 80)))

    texts = [clean() for _ in range(300)]
    texts += [" ".join(w + "###" for w in clean().split()) for _ in range(20)]  # junk
    texts += ["too short", "", None, "again and again and again and again so " * 30]
    return texts


def test_verdicts(docs_of):
    texts = corpus(docs_of)
    docs = with_clashes(docs_of(texts), "kept", "base_failed", "t_symbols", "rows", "level")
    rules = quality.QualityRules(min_rows=50)
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n, chars, symbols, lines, repeats = brute(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (r.base_failed and r.kept)
    assert all(got[i].kept for i in range(300))
    assert not any(got[i].kept for i in range(300, len(texts)))


def test_thresholds_adapt_to_their_group(spark, docs_of):
    """What is usual in one source is odd in another; small groups follow their language."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]

    def text(share):
        return " ".join(rng.choice(words) + ("#" if rng.random() < share else "") for _ in range(60))

    code = docs_of([text(1.0) for _ in range(100)], source="code")
    prose = docs_of([text(0.0) for _ in range(100)] + [text(1.0)], source="prose")
    small = docs_of([text(0.0), text(1.0)], source="small", lang="xx")
    shift = {"code": 0, "prose": 1000, "small": 2000}
    docs = code.unionByName(prose).unionByName(small)
    docs = docs.withColumn("doc_id", F.col("doc_id") + F.create_map(*[F.lit(x) for kv in shift.items() for x in kv])[F.col("source")])
    rules = quality.QualityRules(min_rows=50)
    kept = {r.doc_id: r.kept for r in rules.judge(docs).collect()}
    assert all(kept[i] for i in range(100)) and not kept[1100] and kept[1000]
    levels = {(r.lang, r.source): (r.rows, r.level) for r in rules.thresholds(rules.scored(docs)).collect()}
    assert levels == {("en", "code"): (100, "source"), ("en", "prose"): (101, "source"), ("xx", "small"): (2, "all")}


def brute_threshold(own, lang, everyone, least, gap, lent, of_language, min_rows):
    """The middle of the first wide gap, from plain sorted lists."""

    def quantiles(values):
        values = sorted(values)
        return [values[math.ceil(i * len(values) / 128) - 1] for i in range(1, 129)]

    weights = {"own": len(own), "lang": lent * len(lang) / (len(lang) + lent), "all": lent * lent / (len(lang) + lent)}
    parts = {"own": own, "lang": lang, "all": everyone}
    if of_language:
        weights, parts = {"own": len(own), "lang": lent}, {"own": own, "lang": lang}
    points = sorted((v, weights[name]) for name, values in parts.items() for v in quantiles(values))
    total, seen, median, bulk, last = 128 * sum(weights.values()), 0.0, None, None, None
    for value, weight in points:
        if bulk is not None:
            wider = math.floor(abs(bulk) * min_rows / len(lang)) if of_language else 0
            if value - last >= gap * max(bulk - median, least) + wider:
                return last + (value - last) // 2
        seen, last = seen + weight, value
        median = value if median is None and seen >= 0.5 * total - 1e-6 else median
        bulk = value if bulk is None and seen >= 0.75 * total - 1e-6 else bulk
    return None


@pytest.mark.parametrize("of_language", [False, True])
def test_thresholds_of_small_groups_match_plain_lists(docs_of, of_language):
    rng = random.Random(7)
    text = lambda n: " ".join("w" * max(1, round(rng.gauss(n, 0.5))) for _ in range(40))
    sizes = {("en", "a"): [5] * 90 + [9] * 4, ("en", "b"): [5] * 7 + [30], ("en", "c"): [4, 5, 6] * 20, ("de", "a"): [8] * 300 + [20] * 3, ("xx", "a"): [5]}
    docs, scores, first = None, {}, 0
    for (lang, source), lengths in sizes.items():
        texts = [text(n) for n in lengths]
        scores[lang, source] = [brute(t)[1] * 1000 // brute(t)[0] for t in texts]
        part = docs_of(texts, lang=lang, source=source).withColumn("doc_id", F.col("doc_id") + first)
        docs, first = (part if docs is None else docs.unionByName(part)), first + len(texts)
    measure = quality.Measure("len", quality.WORD_LENGTH, 30, of_language)
    rules = quality.QualityRules(min_rows=50, measures=(measure,), max_repeat_percent=100)
    got = {(r.lang, r.source): r.t_len for r in rules.thresholds(rules.scored(docs)).collect()}
    everyone = [x for values in scores.values() for x in values]
    by_lang = {lang: [x for (of, _), values in scores.items() if of == lang for x in values] for lang, _ in scores}
    expected = {key: brute_threshold(scores[key], by_lang[key[0]], everyone, 30, 6, 5.0, of_language, 50) for key in scores}
    assert got == expected and sum(t is not None for t in got.values()) >= 2


def test_thresholds_decide(spark, testdata):
    """On the given tables the learnt thresholds reject, group by group; those of other groups
    would not do; and the least spreads, the only constants left, change nothing."""
    docs = spark.read.parquet(f"{testdata}/sf0.1/documents.parquet")
    rules = quality.QualityRules()
    scored = rules.scored(docs).drop("text").persist()
    limits = rules.thresholds(scored).persist()
    kept = {r.doc_id for r in rules.verdicts(scored, limits).where("kept").collect()}
    learnt = limits.where(F.coalesce(*(f"t_{m.name}" for m in rules.measures)).isNotNull()).count()
    rejected = rules.verdicts(scored, limits).where("NOT kept AND NOT base_failed").select("lang", "source").distinct().count()
    assert (limits.count(), learnt, rejected) == (80, 80, 80)
    bare = tuple(replace(m, least_spread=1) for m in rules.measures[:1]) + rules.measures[1:]
    assert {r.doc_id for r in replace(rules, measures=bare).verdicts(scored, replace(rules, measures=bare).thresholds(scored)).where("kept").collect()} == kept
    # Every group with the thresholds of the next one.
    rows = sorted(limits.collect(), key=lambda r: (r.lang, r.source))
    moved = [(a.lang, a.source, *b[2:]) for a, b in zip(rows, rows[1:] + rows[:1], strict=True)]
    other = {r.doc_id for r in rules.verdicts(scored, spark.createDataFrame(moved, limits.schema)).where("kept").collect()}
    assert len(kept ^ other) > 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{testdata}/sf0.1/labels.parquet").collect()}
    judged = [labels[r.doc_id] for r in scored.where("NOT base_failed").select("doc_id").collect() if r.doc_id in labels and r.doc_id not in kept]
    good = [r.doc_id for r in scored.where("NOT base_failed").collect() if labels.get(r.doc_id) == 1]
    assert sum(judged) <= 0.02 * len(judged) and sum(i not in kept for i in good) <= 0.002 * len(good)
    scored.unpersist(), limits.unpersist()


def test_null_groups_repeats_and_empty_tables(spark, docs_of):
    docs = docs_of(["some words " * 3] * 3 + [None])
    bare = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long")})
    rows = quality.QualityRules().judge(bare.unionByName(bare)).collect()
    assert len(rows) == 8 and all(r.base_failed and not r.kept for r in rows)
    assert quality.QualityRules().judge(docs.limit(0)).count() == 0


def styled(docs_of, parts):
    """Documents of (number, word maker, lang, source) parts, ids from 0 on."""
    rng = random.Random(5)
    made, first = None, 0
    for n, word, lang, source in parts:
        texts = [" ".join(word(rng) for _ in range(40)) for _ in range(n)]
        part = docs_of(texts, lang=lang, source=source).withColumn("doc_id", F.col("doc_id") + first)
        made, first = (part if made is None else made.unionByName(part)), first + n
    return made


def english(rng):
    return f"word{rng.randint(0, 300)}"


def unspaced(rng):
    return "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(rng.randint(25, 60)))


@pytest.mark.parametrize("n", [1, 4, 30, 250])
def test_word_length_of_a_rare_language_is_its_own(docs_of, n):
    docs = styled(docs_of, [(400, english, "en", "web"), (n, unspaced, "zh", "web"), (n, unspaced, None, "news")])
    assert quality.QualityRules().judge(docs).where("kept").count() == 400 + 2 * n


@pytest.mark.parametrize("n", [60, 199, 200])
def test_groups_under_min_rows_have_fences_of_their_own(docs_of, n):
    code = lambda rng: english(rng) + rng.choice(["#", "##"])
    docs = styled(docs_of, [(800, english, "en", "web"), (n, code, "en", "code"), (1, code, "en", "web")])
    kept = {r.doc_id for r in quality.QualityRules().judge(docs).where("kept").collect()}
    assert kept == set(range(800 + n))


def test_rows_lent_keep_odd_documents_out_of_tiny_groups(docs_of):
    junk = lambda rng: english(rng) + "###"
    docs = styled(docs_of, [(300, english, "en", "web"), (2, english, "en", "tiny"), (1, junk, "en", "tiny"), (1, junk, "xx", "web")])
    kept = {r.doc_id for r in quality.QualityRules().judge(docs).where("kept").collect()}
    assert kept == set(range(302))
