"""BPE encoding and decoding of whole texts.

A word's symbols form a doubly linked list; a heap holds the ranks of the merges that
are possible between neighbours. The lowest rank is merged first, leftmost on ties;
heap entries whose symbols have changed since are skipped. Decoding concatenates the
vocabulary's strings.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from peerlabel.llm.common import text_or_empty

REMEMBERED_WORDS = 200_000
IDS_BYTES = 16 << 20


class Vocabulary:
    """A word BPE read from a tokenizer file: lower-cased words, white space dropped.

    Of the file it takes the vocabulary, the merges, the end-of-word mark, the pattern
    that finds words and the special tokens. ``decoder: null`` in such a file means that
    tokens are joined by a space.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._check(spec)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        suffix = spec["model"]["end_of_word_suffix"]
        size = 1 + max([*self.ids.values(), *self.special.values()])
        strings = [""] * size
        for text, i in [*self.ids.items(), *self.special.items()]:
            strings[i] = text
        self.strings = pa.array(strings)
        self.size = size
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            pair = self.ids[left] * size + self.ids[right]
            self.merges[pair] = (rank, self.ids[left + right])
        byte_texts = byte_characters()
        self.byte_ids = [self.ids[c] for c in byte_texts]
        self.last_byte_ids = [self.ids[c + suffix] for c in byte_texts]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find_words = regex.compile(pattern).findall
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words = _Encoded(self, remembered)

    @staticmethod
    def _check(spec: dict) -> None:
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", ())]
        splits = [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", ())]
        plain = not any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
        known = (
            model["type"] == "BPE"
            and not model["dropout"]
            and not model["ignore_merges"]
            and kinds == ["NFC", "Replace", "Lowercase"]
            and splits == ["Split", "ByteLevel"]
            and spec["decoder"] is None
            and plain
        )
        if not known:
            raise ValueError("this tokenizer file asks for steps that are not built here")

    def encode(self, text: str) -> bytes:
        """The ids of a text as int32 bytes."""
        if "<|" not in text:  # quick: no special token can be inside
            return b"".join(map(self.words.__getitem__, self.find_words(normalise(text))))
        parts = []
        for i, part in enumerate(self.cut_special.split(text)):
            if i % 2:
                parts.append(np.int32(self.special[part]).tobytes())
            else:
                parts.extend(map(self.words.__getitem__, self.find_words(normalise(part))))
        return b"".join(parts)

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode()
        symbols = [self.byte_ids[b] for b in raw]
        symbols[-1] = self.last_byte_ids[raw[-1]]
        return merge(symbols, self.merges, self.size)


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    """Read once a Python worker; its encoded words are kept for one task only, since the
    worker goes on to other stages."""
    return Vocabulary(path)


class _Encoded(dict):
    """Encoded words of a task, emptied when full and at its end."""

    def __init__(self, vocabulary: Vocabulary, limit: int):
        super().__init__()
        self.vocabulary, self.limit = vocabulary, limit

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.vocabulary.encode_word(word), np.int32).tobytes()
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids


def merge(symbols: list[int], merges: dict[int, tuple[int, int]], size: int) -> list[int]:
    """Merge neighbours by rank until no merge is left."""
    n = len(symbols)
    if n == 1:
        return symbols
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    get = merges.get
    for i in range(n - 1):
        found = get(symbols[i] * size + symbols[i + 1])
        if found:
            heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
    heapq.heapify(heap)
    while heap:
        _, i, left, right, merged = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # stale: one of the two has been merged meanwhile
        symbols[i], symbols[j] = merged, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = get(merged * size + symbols[k])
            if found:
                heapq.heappush(heap, (found[0], i, merged, symbols[k], found[1]))
        h = before[i]
        if h >= 0:
            found = get(symbols[h] * size + merged)
            if found:
                heapq.heappush(heap, (found[0], h, symbols[h], merged, found[1]))
    return [s for s in symbols if s >= 0]


def normalise(text: str) -> str:
    """NFC and lower case, each character by itself: a last sigma is no exception."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is visible and no
    space, else the next free one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


@dataclass(frozen=True)
class BpeCodec:
    """Encodes and decodes columns with the vocabulary of a tokenizer file."""

    tokenizer_path: str

    def encode(self, df: DataFrame, text_col: str = "text", out: str = "ids") -> DataFrame:
        """``df`` with the ids of ``text_col`` as array<int>; NULL encodes as empty.

        All columns and rows stay; a column of the name ``out`` is replaced.
        """
        return self._with_column(df, text_col, out, ArrayType(IntegerType()), text_or_empty(text_col), encode_texts)

    def decode(self, df: DataFrame, ids_col: str = "ids", out: str = "text") -> DataFrame:
        """``df`` with the text of ``ids_col``: the tokens' strings joined by a space.

        NULL ids decode as no tokens; an id beyond the vocabulary fails.
        """
        ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
        return self._with_column(df, ids_col, out, StringType(), ids, decode_ids)

    def round_trip(self, df: DataFrame, text_col: str = "text", ids: str = "ids", digest: str = "decoded_sha256") -> DataFrame:
        """``df`` with the ids of ``text_col`` and the digest of what they decode to, in one pass.

        NULL encodes as empty. All rows and all other columns stay; columns of the two names are replaced.
        """
        others = [c for c in df.columns if c not in (ids, digest)]
        row = F.struct(F.lit(0).alias("__"), *(F.col(f"`{c}`") for c in others))
        narrowed = df.select(row.alias("row"), text_or_empty(text_col).alias("value"))
        path = self.tokenizer_path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = vocabulary_of(path)
            for batch in batches:
                done = 0
                for made in encode_texts(batch.column(1), vocabulary):
                    rows = batch.column(0).slice(done, len(made))
                    done += len(made)
                    (decoded,) = decode_ids(made, vocabulary)
                    yield pa.RecordBatch.from_arrays([rows, made, _sha256(decoded)], ["row", "ids", "digest"])
            vocabulary.words.clear()

        fields = [StructField("ids", ArrayType(IntegerType())), StructField("digest", StringType())]
        mapped = narrowed.mapInArrow(run, StructType([narrowed.schema.fields[0], *fields]))
        kept = [F.col("row").getField(c).alias(c) for c in others]
        return mapped.select(*kept, F.col("ids").alias(ids), F.col("digest").alias(digest))

    def digests(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_tokens, ids_sha256, decoded_sha256) per row, in one pass.

        A NULL text counts as empty, with the digests of an empty string. Repeated and
        NULL ids stay; an empty table gives an empty one.
        """
        narrowed = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
        kind = dict(narrowed.dtypes)["id"]
        schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
        path = self.tokenizer_path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = vocabulary_of(path)
            for batch in batches:
                row = 0
                for ids in encode_texts(batch.column(1), vocabulary):
                    yield _digest(batch.column(0).slice(row, len(ids)), ids, vocabulary)
                    row += len(ids)
            vocabulary.words.clear()

        return narrowed.mapInArrow(run, schema).withColumnRenamed("id", id_col)

    def _with_column(self, df, source, out, kind, value, step) -> DataFrame:
        others = [c for c in df.columns if c != out]
        row = F.struct(F.lit(0).alias("__"), *(F.col(f"`{c}`") for c in others))
        narrowed = df.select(row.alias("row"), value.alias("value"))
        schema = narrowed.schema.fields[0]
        path = self.tokenizer_path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = vocabulary_of(path)
            for batch in batches:
                done = 0
                for made in step(batch.column(1), vocabulary):
                    rows = batch.column(0).slice(done, len(made))
                    done += len(made)
                    yield pa.RecordBatch.from_arrays([rows, made], ["row", "made"])
            vocabulary.words.clear()

        made = StructType([schema, StructField("made", kind)])
        mapped = narrowed.mapInArrow(run, made)
        kept = [F.col("row").getField(c).alias(c) for c in others]
        return mapped.select(*kept, F.col("made").alias(out))


def encode_texts(texts: pa.Array, vocabulary: Vocabulary) -> Iterator[pa.ListArray]:
    """The ids of texts, in arrays of about IDS_BYTES."""
    encoded, size = [], 0
    for text in texts:
        encoded.append(vocabulary.encode(text.as_py() or ""))
        size += len(encoded[-1])
        if size >= IDS_BYTES:
            yield _lists(encoded)
            encoded, size = [], 0
    if encoded:
        yield _lists(encoded)


def _lists(encoded: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(encoded) + 1, np.int64)
    np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
    ids = pa.array(np.frombuffer(b"".join(encoded), np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)


def decode_ids(ids: pa.ListArray, vocabulary: Vocabulary) -> Iterator[pa.Array]:
    tokens = vocabulary.strings.take(ids.flatten())
    lengths = pc.fill_null(pc.list_value_length(ids), 0)
    offsets = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(lengths.to_numpy(zero_copy_only=False), out=offsets[1:])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens)
    yield pc.binary_join(lists, " ")


def _digest(keys: pa.Array, ids: pa.ListArray, vocabulary: Vocabulary) -> pa.RecordBatch:
    numbers = pa.ListArray.from_arrays(ids.offsets, pc.cast(ids.values, pa.string()))
    (decoded,) = decode_ids(ids, vocabulary)
    return pa.RecordBatch.from_arrays(
        [
            keys,
            pc.cast(pc.list_value_length(ids), pa.int64()),
            _sha256(pc.binary_join(numbers, " ")),
            _sha256(decoded),
        ],
        ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _sha256(texts: pa.Array) -> pa.Array:
    from hashlib import sha256

    raw = pc.cast(texts, pa.binary())
    return pa.array([sha256(value.as_buffer()).hexdigest() for value in raw])
