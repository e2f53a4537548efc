"""Byte-level words against regular expressions."""

import random
import re

import pyarrow as pa
import pytest

from peerlabel.llm import bytewords as b

RULES = [
    (b.NOT_SPACE, r"[^\x20\x09-\x0D]+"),
    (b.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
]
ODD = ["", " ", "a", " a ", "é à\tB\x0bc\x0c\x1cD", "日本 語", "x" * 3000, None, "a\n\nb", "  　x", "_A1_b-é"]


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def words_of(texts, rule):
    out, hashes = [None] * len(texts), {}
    for w in b.split(pa.array(texts, pa.string()), rule, lower=True):
        for t in range(len(w)):
            span = range(w.first[t], w.first[t + 1])
            out[w.row0 + t] = [bytes(w.data[w.start[i] : w.end[i]]).decode() for i in span]
            for i in span:
                assert hashes.setdefault(int(w.hash[i]), out[w.row0 + t][i - w.first[t]]) == out[w.row0 + t][i - w.first[t]]
    assert len(set(hashes.values())) == len(hashes)
    return out


@pytest.mark.parametrize("rule, pattern", RULES)
@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_words_match_the_pattern(monkeypatch, rule, pattern, chunk):
    monkeypatch.setattr(b, "CHUNK_BYTES", chunk)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("aB 1\n.é☃") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    assert words_of(texts, rule) == [re.findall(pattern, lowered(t or "")) for t in texts]


def test_slices_of_arrays():
    texts = pa.array(ODD, pa.string()).slice(3, 5)
    got = [w.row0 + t for w in b.split(texts, b.NOT_SPACE) for t in range(len(w))]
    assert got == [0, 1, 2, 3, 4]


def test_run_hashes_tell_order_and_length_apart():
    import numpy as np

    h = np.array([1, 2, 1, 2, 1], np.uint64)
    runs = b.run_hash(h, 2)
    assert runs[0] == runs[2] and runs[1] == runs[3] and runs[0] != runs[1]
    assert len(b.run_hash(h, 6)) == 0 and b.run_hash(h[:1], 1)[0] not in set(runs.tolist())
