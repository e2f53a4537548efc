"""Token counts: lengths of byte-level BPE encodings, without keeping any ids.

Texts are cut into pieces at places where the tokenizer's own pre-split always cuts.
Pieces that a task has not seen lately are encoded in batches of about equal bytes;
only the lengths of their encodings are kept, and summed per text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlabel.llm.bytewords import IS_SPACE, chunks, span_hash, text_bytes
from peerlabel.llm.common import text_or_empty

BATCH_BYTES = 1 << 20
REMEMBERED_PIECES = 1_000_000


@dataclass(frozen=True)
class TokenCounter:
    """``batch`` is the size in bytes of the lists given to the tokenizer, ``remembered``
    bounds the lengths that a task keeps; neither changes any count.

    Pieces are told apart by 64-bit hashes.
    """

    tokenizer_path: str
    batch: int = BATCH_BYTES
    remembered: int = REMEMBERED_PIECES
    limit: int = 512

    def counts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_bytes, n_tokens, over_limit), a row for each row of ``docs``.

        A NULL text counts as empty: no bytes, no tokens. Ids may repeat or be NULL;
        other columns are not read. An empty table gives an empty one.
        """
        narrowed = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
        kind = dict(narrowed.dtypes)["id"]
        counted = narrowed.mapInArrow(self._run, f"id {kind}, n_bytes long, n_tokens long")
        return counted.select(
            F.col("id").alias(id_col),
            "n_bytes",
            "n_tokens",
            (F.col("n_tokens") > self.limit).alias("over_limit"),
        )

    def _run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, lengths = worker_state(self.tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            n_tokens = self.count(texts, tokenizer, lengths)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, pa.array(n_tokens)], ["id", "n_bytes", "n_tokens"]
            )

    def count(self, texts: pa.Array, tokenizer, lengths: dict[int, int]) -> np.ndarray:
        """The number of tokens of each text; ``lengths`` is what the task remembers."""
        totals = np.zeros(len(texts), np.int64)
        raw, all_bounds = text_bytes(texts)
        for row, stop in chunks(all_bounds):
            data = raw[all_bounds[row] : all_bounds[stop]]
            start, end, first = pieces(data, all_bounds[row : stop + 1] - all_bounds[row])
            if not len(start):
                continue
            keys, where, which = np.unique(
                span_hash(data, start, end), return_index=True, return_inverse=True
            )
            if len(lengths) > self.remembered:
                lengths.clear()
            keys = keys.tolist()
            new = [i for i, key in enumerate(keys) if key not in lengths]
            spans = zip(start[where[new]].tolist(), end[where[new]].tolist(), strict=True)
            strings = [data[s:e].tobytes().decode() for s, e in spans]
            for positions, batch in balanced(strings, self.batch):
                encoded = tokenizer.encode_batch_fast(batch, add_special_tokens=False)
                for i, encoding in zip(positions, encoded, strict=True):
                    lengths[keys[new[i]]] = len(encoding)
            sums = np.zeros(len(start) + 1, np.int64)
            np.cumsum(np.array([lengths[key] for key in keys], np.int64)[which], out=sums[1:])
            totals[row:stop] = sums[first[1:]] - sums[first[:-1]]
        return totals


@lru_cache(maxsize=2)
def worker_state(path: str):
    """The tokenizer and known lengths, which a Python worker keeps from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    lengths: dict[int, int] = {}
    return tokenizer, lengths


def pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of texts, and where each text's pieces begin.

    A cut is safe where white space follows something that is none: the pre-split joins
    white space only to what comes after it, looks at nothing before, and no special
    token holds any. So that no rule about rarer white space matters, a cut needs an
    ASCII space after a visible ASCII character or a two-byte one from U+00C0 on. A text
    without such places is one piece.
    """
    one, two = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    one[1:], two[2:] = data[:-1], data[:-2]
    visible = (one >= 0x21) & (one <= 0x7E) | (one >= 0x80) & (two >= 0xC3) & (two <= 0xDF)
    starts = IS_SPACE[data] & visible
    inner = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[inner] = True
    start = np.flatnonzero(starts)
    return start, np.append(start[1:], len(data)), np.searchsorted(start, bounds)


def balanced(strings: list[str], size: int) -> Iterator[tuple[range, list[str]]]:
    """Runs of strings of about ``size`` UTF-8 bytes each; a longer one goes alone."""
    begin, total = 0, 0
    for i, string in enumerate(strings):
        n = len(string) if string.isascii() else len(string.encode())
        if total and total + n > size:
            yield range(begin, i), strings[begin:i]
            begin, total = i, 0
        total += n
    if begin < len(strings):
        yield range(begin, len(strings)), strings[begin:]
