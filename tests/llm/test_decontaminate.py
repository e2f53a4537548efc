"""The suffix automaton and its hits against windows listed one by one."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from conftest_llm import with_clashes
from peerlabel.llm import bytewords
from peerlabel.llm.decontaminate import Block, Decontaminator, build_block, pieces

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(texts, items, window):
    runs = {}
    for name, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            runs.setdefault(tuple(words[i : i + n]), set()).add(str(name))
    out = []
    for text in texts:
        words, covered, found = words_of(text), set(), set()
        for n in {len(r) for r in runs}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in runs:
                    found |= runs[tuple(words[i : i + n])]
                    covered.update(range(i, i + n))
        out.append((len(words), len(covered), sorted(found), bool(covered) and 20 * len(covered) >= len(words)))
    return out


@pytest.mark.parametrize("window, block_words", [(3, 10**6), (3, 6), (1, 4), (5, 10**6), (2, 3)])
@pytest.mark.parametrize("held_bytes", [0, 10**9])
def test_hits_match_windows(spark, docs_of, window, block_words, held_bytes):
    rng = random.Random(window)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))) for i in range(9)]
    items += [(20, None), (21, "É é-A"), (1, "a b"), (1, "a b"), (22, ""), (23, " ".join("abcabdabcdcb"))]
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += [None, "", "...", "É, (é) a!", "d " * 3000 + "a b c a"]
    docs = with_clashes(docs_of(texts), "id", "n_hit", "spans", "items")
    table = spark.createDataFrame(items, "item_id LONG, text STRING")
    finder = Decontaminator(window=window, block_words=block_words, held_bytes=held_bytes)
    got = finder.hits(docs, table, keep=("lang",)).collect()
    expected = brute(texts, items, window)
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in sorted(got)] == expected
    for r in got:
        assert sum(s.words for s in r.spans) == r.n_hit
        raw = (r.text or "").encode()
        assert all(words_of(raw[s.start : s.end].decode()) == words_of(raw[s.start : s.end].decode("utf-8")) for s in r.spans)
        assert [len(words_of(raw[s.start : s.end].decode())) for s in r.spans] == [s.words for s in r.spans]


def test_spans_are_removed(spark, docs_of):
    item = "one two three four five six seven"
    texts = [f"Before it. {item.upper()}! After it.", "x " * 400 + item, "clean text", None]
    table = spark.createDataFrame([("i", item)], "item_id STRING, text STRING")
    finder = Decontaminator(window=5, max_span=6)
    hits = finder.hits(docs_of(texts), table)
    left = {r.doc_id: r.text for r in finder.remove_spans(hits).collect()}
    assert left == {0: "Before it. ! After it.", 1: "x " * 400, 2: "clean text", 3: None}
    kept = Decontaminator(window=5, max_span=7)
    left = {r.doc_id: r.text for r in kept.remove_spans(hits).collect()}
    assert left[0] == "Before it. ! After it." and left[1] == texts[1]


def test_empty_tables(spark, docs_of):
    finder = Decontaminator()
    none = spark.createDataFrame([], "item_id LONG, text STRING")
    docs = docs_of(["some words here", None])
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in finder.hits(docs, none).collect()) == [(0, 0, False), (3, 0, False)]
    assert finder.hits(docs.limit(0), none).count() == 0


def test_every_window_lies_in_one_piece():
    for n in range(40):
        for window, most in ((3, 3), (3, 7), (5, 2), (1, 4)):
            cut = [p.tolist() for p in pieces(np.arange(n), window, most)]
            assert all(len(p) <= max(most, window) for p in cut)
            assert (n > 0) == bool(cut)
            runs = [tuple(range(i, i + min(window, n))) for i in range(max(n - window + 1, 1 if n else 0))]
            assert sorted(tuple(p[i : i + min(window, n)]) for p in cut for i in range(len(p) - min(window, n) + 1)) == runs


def test_blocks_grow_with_their_words():
    """40,000 items of 13 words: the block is small, and comes back from its file as it was."""

    def block(n_items):
        rng = random.Random(1)
        texts = [" ".join(str(rng.randrange(20_000)) for _ in range(13)) for _ in range(n_items)]
        runs = []
        for words in bytewords.split(pa.array(texts), bytewords.ALNUM, lower=True):
            runs += [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        return build_block([f"i\\{i}\0é" for i in range(n_items)], runs, 13)

    small, large = block(10_000), block(40_000)
    assert large.nbytes <= 4.5 * small.nbytes and large.nbytes < 60 << 20
    again = Block.load(small.dump())
    assert again.names == small.names and (again.window, again.shortest) == (13, 13)
    assert all((again.arrays[k] == v).all() for k, v in small.arrays.items())


def test_items_without_spaces_fill_blocks(spark, docs_of):
    """Words are counted, not spaces; and a long item of one word repeated is hit throughout."""
    items = [(i, ",".join(f"w{i}x{j}" for j in range(100))) for i in range(50)] + [(99, "same " * 4000)]
    table = spark.createDataFrame(items, "item_id LONG, text STRING")
    finder = Decontaminator(block_words=1000)
    assert len(finder.blocks(table)) >= 9
    texts = ["and " + items[7][1], "same " * 3000, "same " * 12]
    got = sorted(finder.hits(docs_of(texts), table).collect())
    assert [(r.n_hit, r["items"]) for r in got] == [(100, ["7"]), (3000, ["99"]), (0, [])]
