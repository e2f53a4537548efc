"""Keyed randomness: every random choice is a function of (seed, salt, row id).

The values do not depend on partitioning, task retries or evaluation order, so a
lost executor recomputes exactly the rows it held before.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS_PER_DIGEST = 4
WORD_RANGE = 4294967296  # 2^32
WIDE_HEX_DIGITS = 13
WIDE_RANGE = 4503599627370496  # 2^52


def digest(row_id: Column, salt: str) -> Column:
    return F.md5(F.concat(row_id.cast("string"), F.lit(f":{salt}")).cast("binary"))


def _hex_to_long(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def words(row_id: Column, salt: str, n: int) -> list[Column]:
    """``n`` independent 32-bit integers per row; one digest serves four of them."""
    blocks = [
        digest(row_id, f"{salt}:{block}")
        for block in range((n + WORDS_PER_DIGEST - 1) // WORDS_PER_DIGEST)
    ]
    return [
        _hex_to_long(F.substring(blocks[i // WORDS_PER_DIGEST], 8 * (i % WORDS_PER_DIGEST) + 1, 8))
        for i in range(n)
    ]


def uniforms(row_id: Column, salt: str, n: int) -> list[Column]:
    """``n`` independent uniforms in [0, 1) per row."""
    return [w / F.lit(float(WORD_RANGE)) for w in words(row_id, salt, n)]


def uniform(row_id: Column, salt: str) -> Column:
    return uniforms(row_id, salt, 1)[0]


def wide_uniform(row_id: Column, salt: str) -> Column:
    """A 52-bit uniform in [0, 1), for positions in tables beyond 2^32 rows."""
    text = F.substring(digest(row_id, salt), 1, WIDE_HEX_DIGITS)
    return _hex_to_long(text) / F.lit(float(WIDE_RANGE))


def wide_words(row_id: Column, salt: str, n: int) -> list[Column]:
    """``n`` independent 52-bit integers per row; one digest serves two of them."""
    blocks = [digest(row_id, f"{salt}:{block}") for block in range((n + 1) // 2)]
    return [
        _hex_to_long(F.substring(blocks[i // 2], WIDE_HEX_DIGITS * (i % 2) + 1, WIDE_HEX_DIGITS)) for i in range(n)
    ]


def row_key(columns: list[str]) -> Column:
    """A row id for tables without a unique key: digest of all given columns."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    return F.md5(F.concat_ws("\x1f", *parts).cast("binary"))
