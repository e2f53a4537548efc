"""Sums of doubles that do not depend on the order in which they are added.

A double is cut into whole numbers of 24 bits each; these are summed as BIGINT, which is
exact in any order, and put together again once. Terms below 2^48 in size are exact
down to 2^-96, the bits below which are rounded for each term alone. A sum has room
for 2^39 (half a trillion) terms; one that overflows fails.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB_BITS = 24
HIGHEST, LOWEST = 1, -4  # limbs count units of 2^24, 1, 2^-24 ... 2^-96
N_LIMBS = HIGHEST - LOWEST + 1


def limbs(x: Column) -> list[Column]:
    """BIGINT columns, from the lowest unit to the highest, that add up to ``x``."""

    def rounded(i: int) -> Column:
        return F.rint(x * F.lit(2.0 ** (-LIMB_BITS * i)))

    above = [rounded(i) - rounded(i + 1) * F.lit(2.0**LIMB_BITS) for i in range(LOWEST, HIGHEST)]
    return [part.cast("bigint") for part in (*above, rounded(HIGHEST))]


def total(sums: list[Column]) -> Column:
    """The double that summed limbs stand for. Its sign is always that of the exact sum."""
    half, radix = 1 << (LIMB_BITS - 1), 1 << LIMB_BITS

    def add(state: Column, limb: Column) -> Column:
        whole = limb + state["carry"]
        carry = F.shiftright(whole + F.lit(half), LIMB_BITS)
        return F.struct(
            carry.alias("carry"),
            (state["value"] + (whole - carry * F.lit(radix)) * state["unit"]).alias("value"),
            (state["unit"] * F.lit(float(radix))).alias("unit"),
        )

    start = F.struct(
        F.lit(0).cast("bigint").alias("carry"),
        F.lit(0.0).alias("value"),
        F.lit(2.0 ** (LIMB_BITS * LOWEST)).alias("unit"),
    )
    return F.aggregate(F.array(*sums), start, add, lambda s: s["value"] + s["carry"] * s["unit"])


def exact_sum(x: Column) -> Column:
    """An aggregate like ``F.sum`` of doubles, the same for every order of the rows.

    NULLs are skipped; no value at all gives NULL.
    """
    return total([F.sum(part) for part in limbs(x)])
