"""Drawing a subsample of the unlabelled rows for every member at once."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peerlabel.functions.exact import LOWEST, N_LIMBS, limbs, total
from peerlabel.functions.hashing import WIDE_RANGE, WORD_RANGE, wide_words, words

WORD_BITS = 32
MAX_TOP_BITS = 16
SPREAD = 8


def _with_words(rows, ks, n_members, seed, round_no, row_id):
    """Append each member's hash word as ``_w{k}``; members share digests."""
    every = words(F.col(row_id), f"{seed}:sub:{round_no}", n_members)
    return rows.withColumns({f"_w{k}": every[k] for k in sorted(ks)})


def _keep_drawn(hashed: DataFrame, kept: list[str], flags: dict[int, Column], n_members: int) -> DataFrame:
    """Rows drawn for any member, with ``drawn ARRAY<BOOLEAN>``.

    A one-or-none explode, not a filter: a filter would be pushed below the hash
    words and compute every digest again for each member.
    """
    flag = [flags.get(k, F.lit(False)) for k in range(n_members)]
    chosen = F.explode(F.when(reduce(or_, flag), F.array(F.array(*flag)))).alias("drawn")
    return hashed.select(*kept, chosen)


def words_accepted(size: int, n_rows: float) -> int:
    """How many of the 2^52 hash words are drawn, for ``size`` rows of ``n_rows`` on average."""
    return min(WIDE_RANGE, math.ceil(Fraction(size * WIDE_RANGE) / Fraction(n_rows)))


def bernoulli_draw(
    rows: DataFrame,
    sizes: dict[int, int],
    n_rows: int,
    n_members: int,
    seed: int = 1,
    round_no: int = 0,
    row_id: str = "row_id",
) -> DataFrame:
    """Keep each row for member k with probability ``min(1, sizes[k] / n_rows)``.

    One pass for all members. Only the row id is looked at, so rows nobody drew
    are dropped before any member is asked about them. Hash words of 52 bits keep the
    probability true to 2^-52, whatever the size of the table.
    """
    every = wide_words(F.col(row_id), f"{seed}:sub:{round_no}", n_members)
    hashed = rows.withColumns({f"_w{k}": every[k] for k in sorted(sizes)})
    flags = {k: F.col(f"_w{k}") < F.lit(words_accepted(n, n_rows)) for k, n in sizes.items()}
    return _keep_drawn(hashed, rows.columns, flags, n_members)


def exact_draw(
    rows: DataFrame,
    sizes: dict[int, int],
    n_rows: int,
    n_members: int,
    seed: int = 1,
    round_no: int = 0,
    row_id: str = "row_id",
) -> DataFrame:
    """Keep exactly ``min(sizes[k], n_rows)`` rows for member k.

    The rows with the n smallest ``(hash word, row id)``: the n-th smallest is
    located first, and the draw is then a filter. Only the about sqrt(n_rows) rows
    near it are ranked; the table itself is neither sorted nor moved.
    """
    hashed = _with_words(rows, sizes, n_members, seed, round_no, row_id)
    flags = {k: F.lit(True) for k, n in sizes.items() if n >= n_rows}
    flags.update({k: F.lit(False) for k, n in sizes.items() if n <= 0})
    partial = {k: n for k, n in sizes.items() if 0 < n < n_rows}
    if partial:
        for k, (word, last_id) in _cut_points(hashed, partial, row_id, n_rows).items():
            w = F.col(f"_w{k}")
            flags[k] = (w < word) | ((w == word) & (F.col(row_id) <= F.lit(last_id)))
    return _keep_drawn(hashed, rows.columns, flags, n_members)


def _cut_points(hashed, sizes, row_id, n_rows):
    """Per member, the hash word and row id of the n-th row in draw order."""
    cuts = _cuts_near_expectation(hashed, sizes, row_id, n_rows)
    missed = {k: n for k, n in sizes.items() if k not in cuts}
    return {**cuts, **_cuts_by_histogram(hashed, missed, row_id, n_rows)} if missed else cuts


def _cuts_near_expectation(hashed, sizes, row_id, n_rows):
    """One pass: the n-th of N uniform words lies within ``SPREAD`` deviations of n / N.

    Words below that window are only counted; those inside, about sqrt(N) rows per
    member, are ranked. A member whose cut is not in its window is left out.
    """
    pairs = []
    for k, n in sorted(sizes.items()):
        share = n / n_rows
        margin = SPREAD * math.sqrt(share * (1 - share) / n_rows)
        low = max(0, math.floor((share - margin) * WORD_RANGE))
        high = math.ceil((share + margin) * WORD_RANGE)
        w, member = F.col(f"_w{k}"), F.lit(k).alias("k")
        below = F.struct(member, F.lit(-1).cast("bigint").alias("word"), F.lit(None).alias(row_id))
        inside = F.struct(member, w.alias("word"), F.col(row_id).alias(row_id))
        pairs.append(F.when(w < low, below).when(w <= high, inside))
    near = hashed.select(F.inline(F.array(*pairs))).filter(F.col("k").isNotNull())
    counts = near.groupBy("k", "word", row_id).agg(F.count(F.lit(1)).alias("n"))
    running = counts.withColumn("upto", F.sum("n").over(W.partitionBy("k").orderBy("word", row_id)))
    wanted = _lookup(sizes)
    cut = running.filter(
        (F.col("word") >= 0) & (F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted)
    )
    return {k: (word, last_id) for k, word, last_id in cut.select("k", "word", row_id).collect()}


def _cuts_by_histogram(hashed, sizes, row_id, n_rows):
    """The same for any distribution of words, in three passes: upper bits, lower bits, ties."""
    ks = sorted(sizes)
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_w{k}").alias("word")) for k in ks])
    long = hashed.select(row_id, F.inline(pairs))

    low_bits = WORD_BITS - min(MAX_TOP_BITS, max(1, math.ceil(math.log2(n_rows) / 2)))
    top = F.shiftright("word", low_bits)
    high = _cut_bucket(long.select("k", top.alias("b")), sizes)
    tops = {k: b for k, (b, _) in high.items()}
    in_top = long.filter(top == _lookup(tops))
    low = _cut_bucket(
        in_top.select("k", F.col("word").bitwiseAND(F.lit((1 << low_bits) - 1)).alias("b")),
        {k: left for k, (_, left) in high.items()},
    )
    cut_words = {k: (tops[k] << low_bits) + b for k, (b, _) in low.items()}
    # Rows with the very same 32-bit word: |U| / 2^32 on average.
    same = in_top.filter(F.col("word") == _lookup(cut_words))
    left = {k: n for k, (_, n) in low.items()}
    ranked = same.withColumn("_r", F.row_number().over(W.partitionBy("k").orderBy(row_id)))
    last = ranked.filter(F.col("_r") == _lookup(left)).select("k", row_id).collect()
    return {k: (cut_words[k], last_id) for k, last_id in last}


def _cut_bucket(buckets, sizes):
    """Bucket in which the running count reaches ``sizes[k]``, and how many are left there."""
    counts = buckets.groupBy("k", "b").agg(F.count(F.lit(1)).alias("n"))
    running = counts.withColumn("upto", F.sum("n").over(W.partitionBy("k").orderBy("b")))
    wanted = _lookup(sizes)
    cut = running.filter((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted))
    rows = cut.select("k", "b", (wanted - (F.col("upto") - F.col("n"))).alias("left")).collect()
    return {k: (int(b), int(left)) for k, b, left in rows}


def _lookup(values: dict[int, int]) -> Column:
    out = F.lit(None).cast("bigint")
    for k, v in values.items():
        out = F.when(F.col("k") == k, F.lit(v).cast("bigint")).otherwise(out)
    return out


def weighted_draw(
    rows: DataFrame,
    sizes: dict[int, int],
    whole: float,
    n_members: int,
    seed: int = 1,
    round_no: int = 0,
    row_id: str = "row_id",
    weight_col: str = "weight",
) -> DataFrame:
    """Keep for member k the rows in draw order up to a total weight of ``sizes[k]``.

    Rows come in the order of ``(hash word, row id)``, as in :func:`exact_draw`; the first one
    with which the running weight exceeds the size ends the draw. ``whole`` is the weight of
    all rows. The cut is searched for in three passes of counted weights (upper bits
    of the words, lower bits, rows of one word); the rows are neither sorted nor moved. Running
    weights are exact sums, so the cut does not depend on the layout.
    """
    hashed = _with_words(rows, sizes, n_members, seed, round_no, row_id)
    flags = {k: F.lit(True) for k, n in sizes.items() if n >= whole}
    partial = {k: n for k, n in sizes.items() if n < whole}
    if partial:
        for k, (word, last_id) in _weight_cuts(hashed, partial, row_id, F.col(weight_col).cast("double")).items():
            w = F.col(f"_w{k}")
            same = F.lit(False) if last_id is None else F.col(row_id) <= F.lit(last_id)
            flags[k] = (w < word) | ((w == word) & same)
    return _keep_drawn(hashed, rows.columns, flags, n_members)


def _weight_cuts(hashed, sizes, row_id, weight):
    """Per member, the hash word in which the draw ends and the last row drawn of that word."""
    ks = sorted(sizes)
    low_bits = WORD_BITS - MAX_TOP_BITS
    parts = dict(zip(_LIMBS, limbs(weight)))
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_w{k}").alias("word")) for k in ks])
    long = hashed.select(row_id, *[part.alias(name) for name, part in parts.items()], F.inline(pairs))
    top = F.shiftright("word", low_bits)
    none = {k: (0,) * len(_LIMBS) for k in ks}
    tops = _first_beyond(long.withColumn("b", top), "b", sizes, none)
    in_top = long.filter(top == _lookup({k: b for k, (b, _) in tops.items()}))
    words_cut = _first_beyond(in_top, "word", sizes, {k: before for k, (_, before) in tops.items()})
    same = in_top.filter(F.col("word") == _lookup({k: w for k, (w, _) in words_cut.items()}))
    running = _running(same, row_id, {k: before for k, (_, before) in words_cut.items()})
    last = running.filter(_excess(sizes) <= 0).groupBy("k").agg(F.max(row_id).alias("last")).collect()
    last_ids = {row.k: row["last"] for row in last}
    return {k: (w, last_ids.get(k)) for k, (w, _) in words_cut.items()}


_LIMBS = tuple(f"_limb{i}" for i in range(N_LIMBS))


def _running(rows, by, before):
    """``rows`` with the running sums of their limbs in the order of ``by``, on top of ``before``."""
    order = W.partitionBy("k").orderBy(by)
    start = [_lookup({k: sums[i] for k, sums in before.items()}) for i in range(len(_LIMBS))]
    return rows.withColumns({f"{name}_upto": F.sum(name).over(order) + start[i] for i, name in enumerate(_LIMBS)})


def _excess(sizes):
    """Running weight less the size: the sign is exact."""
    sums = [F.col(f"{name}_upto") for name in _LIMBS]
    whole = -LOWEST  # the limb that counts ones
    sums[whole] = sums[whole] - _lookup(sizes)
    return total(sums)


def _first_beyond(rows, key, sizes, before):
    """Per member, the first value of ``key`` with which the running weight exceeds the size,
    and the limbs of the weight before it."""
    sums = rows.groupBy("k", F.col(key).alias("b")).agg(*[F.sum(name).alias(name) for name in _LIMBS])
    beyond = _running(sums, "b", before).filter(_excess(sizes) > 0)
    earlier = [(F.col(f"{name}_upto") - F.col(name)).alias(name) for name in _LIMBS]
    first = beyond.groupBy("k").agg(F.min_by(F.struct("b", *earlier), "b").alias("cut"))
    return {row.k: (int(row.cut["b"]), tuple(row.cut[name] for name in _LIMBS)) for row in first.collect()}


def draw(
    method: str, rows: DataFrame, sizes: dict[int, int], n_rows: float, n_members: int, *args, weight_col: str | None = None, **kwargs
) -> DataFrame:
    """The subsample by one of the methods; with weights ``sizes`` and ``n_rows`` are weights."""
    if method != "exact":
        return bernoulli_draw(rows, sizes, n_rows, n_members, *args, **kwargs)
    if weight_col is not None:
        return weighted_draw(rows, sizes, n_rows, n_members, *args, weight_col=weight_col, **kwargs)
    return exact_draw(rows, sizes, n_rows, n_members, *args, **kwargs)
