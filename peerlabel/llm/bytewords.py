"""Words of a batch of texts as numpy arrays over their UTF-8 bytes.

All word rules here separate words at ASCII bytes, so they can be applied to bytes:
no multi-byte character holds an ASCII byte. Hashes are 64-bit polynomial hashes of
the bytes, mixed with the length; two different words share one with a probability
of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

BYTES = np.arange(256)
IS_SPACE = (BYTES == 0x20) | ((BYTES >= 0x09) & (BYTES <= 0x0D))
NOT_SPACE = ~IS_SPACE
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)
# After lower-casing: digits, a-z and every byte of a character beyond ASCII.
ALNUM = ((BYTES >= 48) & (BYTES <= 57)) | ((BYTES >= 97) & (BYTES <= 122)) | (BYTES >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        filled = np.full(max(n, CHUNK_BYTES + 1), base, dtype=U64)
        filled[0] = 1
        have = np.multiply.accumulate(filled)
        if n <= CHUNK_BYTES + 1:
            _powers[base] = have
    return have[:n]


@dataclass
class Words:
    """Words of texts ``row0 .. row0 + n``: word i is data[start[i]:end[i]]."""

    row0: int
    data: np.ndarray
    bounds: np.ndarray  # n + 1 byte offsets of the texts
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n + 1 positions: text t has words first[t] .. first[t + 1] - 1
    hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.bounds) - 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts; NULL is empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize)
    bounds = bounds.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK_BYTES each; a longer text is a run of its own."""
    row, n = 0, len(bounds) - 1
    while row < n:
        stop = int(np.searchsorted(bounds, bounds[row] + CHUNK_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, stop
        row = stop


def split(
    column: pa.Array, is_word: np.ndarray, lower: bool = False, hashed: bool = True
) -> Iterator[Words]:
    """The words of a column, some texts at a time; every text comes once."""
    raw, all_bounds = text_bytes(column)
    for row, stop in chunks(all_bounds):
        data = raw[all_bounds[row] : all_bounds[stop]]
        data = LOWER[data] if lower else data
        bounds = all_bounds[row : stop + 1] - all_bounds[row]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = is_word[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside[:-1]
        before[bounds] = False
        start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:] = inside[1:]
        edges = bounds[1:] - 1
        after[edges[edges >= 0]] = False
        end = np.flatnonzero(inside[:-1] & ~after) + 1
        words = Words(row, data, bounds, start, end, np.searchsorted(start, bounds))
        if hashed:
            words.hash = span_hash(data, start, end)
        yield words


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start[i]:end[i]], from one running sum over all bytes."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=sums[1:])
    part = (sums[end] - sums[start]) * powers(BASE_INVERSE, len(data) + 1)[start]
    return mix(part ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))


def run_hash(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` consecutive values, in order."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, length, dtype=U64)
    for j in range(length):
        total = mix(total * U64(0x2545F4914F6CDD1D) + values[j : j + n])
    return total
