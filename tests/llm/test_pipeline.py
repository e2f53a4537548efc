"""The pipeline, stage by stage, on planted cases."""

import hashlib
import itertools
import random
import re
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from peerlabel.llm import common, pii
from peerlabel.llm.common import materialize, table
from test_quality import brute as counts_of, brute_threshold

PII = ("+1 (017) 555-7713", "some.one@mail4.example.com", "97.51.17.173", "4111111111111111")


@pytest.fixture(scope="module")
def folder(spark, testdata, tmp_path_factory):
    """Real documents, and some planted among them."""
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{testdata}/sf0.001/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{testdata}/sf0.001/benchmark.parquet").collect()]
    rng = random.Random(9)
    words = ["".join(p) for p in itertools.product("aeiou", "bdfgklmnprst", ("", "n", "sta"), "aeiou")]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    clean, copied = prose(200), prose(100)
    near = copied.split()
    near[50] = "changed"
    planted = {
        9000: clean,
        9001: copied,
        9002: copied,
        9003: " ".join(near),
        9004: f"{prose(60)} {items[0]} {prose(60)}",
        9005: f"{prose(60)} {PII[0]} and {PII[1]} {prose(60)} {PII[2]} {prose(9)} {PII[3]}.",
        9006: "short one",
        9007: " ".join(w + "###" for w in prose(80).split()),
        9008: None,
        9009: "",
    }
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in planted.items()]
    more = spark.createDataFrame(rows, docs.schema)
    docs.unionByName(more).coalesce(2).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id STRING, text STRING").coalesce(1).write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {}
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), name.replace(" ", "-"))
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == list(pipeline.COLUMNS)
        if name == "personal data":
            text = docs.where("doc_id = 9005").first().text
            assert not any(p in text for p in PII) and all(f"[{k.upper()}]" in text for k in pii.KINDS)
            assert docs.where("n_chars <> length(text)").count() == 0
    assert {9000, 9001, 9002, 9003, 9004, 9005} <= ids["quality rules"]
    assert not {9006, 9007, 9008, 9009} & ids["quality rules"]
    assert {9001, 9004} <= ids["n-gram Jaccard join"] and not {9002, 9003} & ids["n-gram Jaccard join"]
    assert {9000, 9001, 9005} <= ids["benchmark decontamination"] and 9004 not in ids["benchmark decontamination"]
    assert ids["personal data"] == ids["BPE encoding and decoding"] == ids["benchmark decontamination"]
    assert docs.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    assert docs.where(F.size("ids") != F.col("n_tokens")).count() == 0


def kept_by_quality(rows):
    """Documents within the thresholds of their groups, from plain lists."""
    scores = {}
    for r in rows:
        n, chars, symbols, lines, repeats = counts_of(r.text)
        if n >= 20 and 100 * repeats <= 30 * n:
            length = chars * 1000 // n
            scores[r] = [symbols * 1000 // max(chars, 1), lines * 1000 // n, repeats * 1000 // n, length, -length]
    groups = {}
    for r in scores:
        groups.setdefault((r.lang, r.source), []).append(r)
    out = []
    for (lang, _), members in groups.items():
        limits = []
        for i, (least, alone) in enumerate([(5, False), (10, False), (40, False), (50, True), (50, True)]):
            own = [scores[r][i] for r in members]
            of_lang = [s[i] for r, s in scores.items() if r.lang == lang]
            limits.append(brute_threshold(own, of_lang, [s[i] for s in scores.values()], least, 6, 20.0, alone, 200))
        out += [r for r in members if all(t is None or x <= t for x, t in zip(scores[r], limits, strict=True))]
    return out


def first_of_each_group(rows):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}

    sets = [(r, shingles(r.text)) for r in sorted(rows, key=lambda r: r.doc_id)]
    group = list(range(len(sets)))
    for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    return [r for i, (r, _) in enumerate(sets) if group[i] == i]


def uncontaminated(rows, items):
    def words_of(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = {tuple(w[i : i + 13]) for w in map(words_of, items) for i in range(max(len(w) - 12, 1)) if w}
    for r in rows:
        words, hit = words_of(r.text), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
        if not (hit and 20 * len(hit) >= len(words)):
            yield r


def test_run_row_for_row(spark, folder):
    """All five stages against plain Python; the personal data with the model trained in its stage."""
    rows = table(spark, folder, "documents").collect()
    items = [r.text for r in table(spark, folder, "benchmark").collect()]
    left = list(uncontaminated(first_of_each_group(kept_by_quality(rows)), items))
    schema = table(spark, folder, "documents").schema
    masked = pipeline.personal_data(spark, spark.createDataFrame(left, schema), folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(pipeline.WORD_BPE))
    tokenizer.no_truncation(), tokenizer.no_padding()
    expected = {}
    for r in masked:
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        digest = hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        expected[r.doc_id] = (r.lang, r.source, len(ids), ids, digest)
    assert set(expected) == {r.doc_id for r in left} and len(left) > 100 and len(rows) - len(left) > 20
    shared = Path(common.shared_dir(spark, "x").removeprefix("file://")).parent
    before = set(shared.iterdir())
    result = pipeline.run(spark, folder)
    assert {r.doc_id: tuple(r)[1:] for r in result.collect()} == expected and result.count() == len(expected)
    assert [p.name.rsplit("-", 1)[0] for p in shared.iterdir() if p not in before] == ["BPE-encoding-and-decoding"]



def test_one_row_of_each_group_stays(spark, folder):
    text = lambda seed: " ".join(f"{seed}{i}" for i in range(60))
    rows = [(5, text("a")), (5, text("a")), (5, text("b")), (6, text("a") + " more"), (7, text("b")), (8, text("c")), (8, text("c").upper()), (8, None), (None, text("a")), (None, text("a")), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], table(spark, folder, "documents").schema)
    got = [(r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs.repartition(3), folder).collect()]
    expected = [(5, text("a")), (5, text("b")), (8, text("c").upper()), (8, None), (None, text("a")), (None, text("a")), (9, ""), (9, "")]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_empty_and_null_rows(spark, folder):
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    empty = spark.createDataFrame([], schema)
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None)], schema)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
        assert stage(spark, nulls, folder).count() in (0, 2)
