"""Update rules of one round, as column expressions on one row per member."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _true_or_false(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def gate_error_fell(err: Column, err_prev: Column) -> Column:
    """Gate 1. An unknown error (no confident out-of-bag row) keeps it closed."""
    return _true_or_false(err < err_prev)


def starting_weight(gate1: Column, s_prev: Column, initial: float) -> Column:
    """The earlier pseudo-label weight, set to its initial value when first needed."""
    return F.when(gate1 & (s_prev == 0), F.lit(float(initial))).otherwise(s_prev)


def draw_size(err: Column, err_prev: Column, s_prev: Column, n_unlabelled: float) -> Column:
    """``min(ceil(err' s' / err - 1), |U|)``; everything when the error is zero."""
    everything = F.lit(math.ceil(n_unlabelled)).cast("bigint")
    # Compared as doubles first: the quotient can exceed the range of BIGINT.
    wanted = F.ceil(F.least(F.try_divide(err_prev * s_prev, err) - 1, F.lit(float(n_unlabelled))))
    return F.when(err == 0, everything).otherwise(F.least(wanted.cast("bigint"), everything))


def gate_set_grew(s_prev: Column, li_size: Column) -> Column:
    """Gate 2: more pseudo-labelled rows than the earlier weight."""
    return _true_or_false(s_prev < li_size)


def gate_noise_fell(err: Column, s: Column, err_prev: Column, s_prev: Column) -> Column:
    """Gate 3: the weighted error of the new set is below that of the last one."""
    return _true_or_false(err * s < err_prev * s_prev)


def subspace_size_ceil(n_features: Column) -> Column:
    """``ceil(log2(m) + 1)``: features per member of the ``spark`` preset."""
    return F.ceil(F.log(n_features) / F.log(F.lit(2.0)) + 1).cast("int")


def subspace_size_floor(n_features: Column) -> Column:
    """``int(log2(m + 1)) + 1`` of the ``paper`` preset; the class column counts too."""
    return F.floor(F.log(n_features + 1) / F.log(F.lit(2.0))).cast("int") + 1
