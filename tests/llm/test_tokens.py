"""Token counts and BPE against the library itself."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest_llm import with_clashes
from peerlabel.llm import bpe, queries, token_counts

tokenizers = pytest.importorskip("tokenizers")

ODD = [
    "",
    None,
    " ",
    "a<|endoftext|> b <|endoftext|>  c\n\n d  e　　f  é é  x's 'll  don't\t\tq \r\n z",
    "ΣΑΣ İ ß ǅ ﬁ ½²3 ⅷ १२",
    "x" * 5000,
    "a\x85 b   c\x1c\x1dd ᠎ e​",
    "é Å <|startoftext|>ab<|startoftext|",
    "日本語 テスト ok 한국어 한",
    "'sth 'T'S DON'T we'LL",
    "\x00\x01﻿ trailing  ",
    "ÿ ÿ\xa0 ÿ ",
]


def texts_of(n=60):
    rng = random.Random(7)
    letters = ["the", " ", "ing", "\n", "é", "1", "'s", "_", "  ", "ß", "☃", "\t"]
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_bpe():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(queries.BYTE_BPE))


@pytest.fixture(scope="module")
def word_bpe():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))


def test_counts_match_the_library(spark, docs_of, byte_bpe):
    texts = texts_of()
    docs = with_clashes(docs_of(texts), "id", "n_tokens")
    counter = token_counts.TokenCounter(public_tokenizers.path(queries.BYTE_BPE), batch=50, remembered=10, limit=5)
    got = {r.doc_id: r for r in counter.counts(docs).collect()}
    for i, text in enumerate(texts):
        n = len(byte_bpe.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 5)
    assert counter.counts(docs.limit(0)).count() == 0
    repeated = docs.unionByName(docs).withColumn("doc_id", F.lit(None).cast("long"))
    assert counter.counts(repeated).agg(F.sum("n_tokens")).first()[0] == 2 * sum(r.n_tokens for r in got.values())


def test_long_text_and_empty_batches(byte_bpe):
    text = "wörd and more, " * 20000 + "y" * 3000
    counter = token_counts.TokenCounter("")
    totals = counter.count(pa.array([text, None, ""], pa.string()), byte_bpe, {})
    assert totals.tolist() == [len(byte_bpe.encode(text, add_special_tokens=False).ids), 0, 0]
    assert list(token_counts.balanced([], 10)) == []
    batches = list(token_counts.balanced(["aaaa", "bb", "c" * 9, "d"], 6))
    assert [b for _, b in batches] == [["aaaa", "bb"], ["c" * 9], ["d"]]


def test_queries_on_real_documents(spark, testdata, byte_bpe, word_bpe):
    folder = f"{testdata}/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op2_token_counts(spark, folder).collect():
        assert r.n_tokens == len(byte_bpe.encode(texts[r.doc_id], add_special_tokens=False).ids)
    for r in queries.op4_bpe_round_trip(spark, folder).collect():
        ids = word_bpe.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = word_bpe.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_encode_and_decode_columns(spark, docs_of, word_bpe):
    texts = texts_of()
    codec = bpe.BpeCodec(public_tokenizers.path(queries.WORD_BPE))
    docs = with_clashes(docs_of(texts), "row", "made", "value")
    encoded = codec.encode(docs)
    assert encoded.columns == [*docs.columns, "ids"]
    decoded = codec.decode(encoded.withColumnRenamed("text", "was"))
    for r in decoded.collect():
        ids = word_bpe.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.was == texts[r.doc_id]
        assert r.text == word_bpe.decode(ids, skip_special_tokens=False)
    assert codec.encode(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(None,)], "ids ARRAY<INT>")
    assert codec.decode(nothing).first().text == ""


def test_words_forgotten_do_not_matter(word_bpe):
    small = bpe.Vocabulary(public_tokenizers.path(queries.WORD_BPE), remembered=3)
    for text in texts_of():
        ids = word_bpe.encode(text or "", add_special_tokens=False).ids
        assert [int.from_bytes(small.encode(text or "")[i : i + 4], "little") for i in range(0, 4 * len(ids), 4)] == ids


def test_merge_skips_stale_entries():
    size = 100
    merges = {1 * size + 1: (0, 2), 2 * size + 2: (1, 3), 2 * size + 1: (2, 4)}
    assert bpe.merge([1] * 7, merges, size) == [3, 2, 1] or bpe.merge([1] * 7, merges, size) == [3, 4]
    assert bpe.merge([1, 1, 1], merges, size) == [4]
    assert bpe.merge([5], merges, size) == [5]


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path(queries.BYTE_BPE))
