"""Bootstrap samples: how often each member draws each labelled row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peerlabel.functions.exact import exact_sum
from peerlabel.functions.hashing import digest, uniforms, wide_uniform

ROWS_PER_BUCKET = 4096
MAX_BUCKET_HEX_DIGITS = 4
BLOCK_ROWS = 10_000
UNIT_BITS = 52  # all weights together are 2^51 to 2^52 whole units
CELL_UNITS = 1 << 36  # so that the line of weights has about 2^16 cells
HEAVY_UNITS = 2 * CELL_UNITS  # 2^15 rows at most can weigh more
BUCKET_CELLS = 256


def poisson_bounds(terms: int = 11) -> list[float]:
    """Cumulative probabilities of Poisson(1): the count is the number of bounds reached."""
    total, bounds = 0.0, []
    for j in range(terms):
        total += math.exp(-1.0) / math.factorial(j)
        bounds.append(total)
    return bounds


def _poisson_count(u: str) -> Column:
    bounds = poisson_bounds()
    steps = " ".join(f"WHEN {u} < {bound!r}D THEN {j}" for j, bound in enumerate(bounds))
    return F.expr(f"CASE {steps} ELSE {len(bounds)} END")


def poisson_bags(rows: DataFrame, n_members: int, seed: int = 1, row_id: str = "row_id") -> DataFrame:
    """Append ``bag ARRAY<INT>``: independent Poisson(1) draw counts, no shuffle.

    Poisson(1) is the limit of drawing n of n rows with replacement.
    """
    names = [f"_u{k}" for k in range(n_members)]
    drawn = rows.withColumns(dict(zip(names, uniforms(F.col(row_id), f"{seed}:bag", n_members))))
    bag = F.array(*[_poisson_count(name) for name in names])
    return drawn.withColumn("bag", bag).drop(*names)


def _bucket_digits(n_rows: int) -> int:
    wanted = math.log(max(n_rows, 1) / ROWS_PER_BUCKET, 16)
    return min(MAX_BUCKET_HEX_DIGITS, max(1, math.ceil(wanted)))


def with_dense_position(
    rows: DataFrame, n_rows: int, seed: int = 1, row_id: str = "row_id"
) -> DataFrame:
    """Append ``pos`` 0..n-1 in digest order.

    Rows are ranked inside digest buckets, which are evenly filled whatever the
    ids look like; the buckets' start offsets are a table of at most 65,536 rows.
    """
    digits = _bucket_digits(n_rows)
    bucketed = rows.withColumn("_d", digest(F.col(row_id), f"{seed}:dense")).withColumn(
        "_b", F.substring("_d", 1, digits)
    )
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    ranked = bucketed.withColumn("_rank", F.row_number().over(W.partitionBy("_b").orderBy("_d", row_id)))
    # At most 16^4 rows, so the broadcast does not grow with the data.
    return (
        ranked.join(F.broadcast(offsets), "_b")
        .withColumn("pos", F.col("_start") + F.col("_rank") - 1)
        .drop("_b", "_d", "_rank", "_start")
    )


def exact_bags(
    rows: DataFrame, n_members: int, n_rows: int | None = None, seed: int = 1, row_id: str = "row_id"
) -> DataFrame:
    """Append ``bag ARRAY<INT>`` where every member draws exactly n of n rows.

    Positions and draws are worked out on ids alone; the rows themselves are
    shuffled once, to meet their counts.
    """
    ids = rows.select(row_id)
    n_rows = ids.count() if n_rows is None else n_rows
    return _bags_by_position(rows, ids, n_members, n_rows, F.lit(n_rows), F.lit(0), "draw", seed, row_id)


def block_bags(
    rows: DataFrame,
    n_members: int,
    n_rows: int | None = None,
    seed: int = 1,
    row_id: str = "row_id",
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Append ``bag ARRAY<INT>`` where rows are dealt into blocks of ``block`` positions and every
    member draws as many rows from each block as it has, so that its counts add up
    to the block's size in every block, the last and smaller one included.
    """
    ids = rows.select(row_id)
    n_rows = ids.count() if n_rows is None else n_rows
    begin = F.floor(F.col("_j") / block) * block
    size = F.least(F.lit(block), F.lit(n_rows) - begin)
    return _bags_by_position(rows, ids, n_members, n_rows, size, begin, "blockdraw", seed, row_id)


def _bags_by_position(rows, ids, n_members, n_rows, size, begin, salt, seed, row_id):
    """Counts of n draws a member, the j-th from the ``size`` positions from ``begin`` on."""
    draws = rows.sparkSession.range(n_rows * n_members).select(
        (F.col("id") % n_members).cast("int").alias("k"),
        F.floor(F.col("id") / n_members).alias("_j"),
        wide_uniform(F.col("id"), f"{seed}:{salt}").alias("_u"),
    )
    draws = draws.select("k", (begin + F.floor(F.col("_u") * size.cast("double"))).alias("pos"))
    names = [f"_c{k}" for k in range(n_members)]
    counts = draws.groupBy("pos").agg(*_counts_of(names))
    bag = F.array(*[F.coalesce(F.col(name), F.lit(0)) for name in names])
    drawn = with_dense_position(ids, n_rows, seed, row_id).join(counts, "pos", "left")
    return rows.join(drawn.select(row_id, bag.alias("bag")), row_id)


def _counts_of(names):
    return [F.sum((F.col("k") == k).cast("int")).cast("int").alias(name) for k, name in enumerate(names)]


def weight_total(rows: DataFrame, weight: Column) -> tuple[int, float]:
    """Number of rows and exact sum of their weights; weights that are NULL, negative
    or no numbers fail."""
    finite = weight.isNotNull() & ~F.isnan(weight) & (F.abs(weight) < F.lit(2.0**48))
    told = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(~finite | (weight < 0), 1)).alias("wrong"),
        exact_sum(F.when(finite, weight)).alias("total"),
    ).first()
    if told.wrong:
        raise ValueError(f"{told.wrong} weights are NULL, negative, or not below 2^48")
    return told.n, told.total or 0.0


def weighted_bags(
    rows: DataFrame,
    n_members: int,
    weight_col: str = "weight",
    seed: int = 1,
    row_id: str = "row_id",
) -> DataFrame:
    """Append ``bag ARRAY<INT>``: every member draws n of n rows, each time any row with a
    probability in proportion to its weight. Rows of weight 0 are never drawn.

    Weights become whole units, 2^52 at most for all rows, which lie one after the other
    on a line; a draw is a unit, and the row it belongs to is found in two steps. First
    its bucket, in a table of at most 2^16 digest buckets and 2^15 rows that weigh more than a
    bucket should, which is broadcast; then the row among its bucket's. Nothing is sorted
    as a whole. Draws of heavy rows are counted where they are made, so that a row with
    a third of all weight is no hot key.
    """
    weight = F.col(weight_col).cast("double")
    n_rows, whole = weight_total(rows, weight)
    if n_rows and whole <= 0:
        raise ValueError("all weights are zero")
    factor = 2.0 ** (UNIT_BITS - 1 - math.floor(math.log2(whole))) if n_rows else 1.0
    ids = rows.select(row_id, F.floor(weight * F.lit(factor) + 0.5).alias("_units")).filter(F.col("_units") > 0)
    light = ids.filter(F.col("_units") <= HEAVY_UNITS)
    heavy = ids.filter(F.col("_units") > HEAVY_UNITS)
    of_light = F.when(F.col("_units") <= HEAVY_UNITS, F.col("_units"))
    sums = ids.agg(F.coalesce(F.sum("_units"), F.lit(0)).alias("all"), F.coalesce(F.sum(of_light), F.lit(0)).alias("light")).first()

    order = digest(F.col(row_id), f"{seed}:dense")
    buckets = light.withColumn("_d", order).withColumn("_b", F.substring("_d", 1, _bucket_digits(n_rows)))
    totals = buckets.groupBy("_b").agg(F.sum("_units").alias("_size"))
    spans = totals.select("_b", F.lit(None).cast(rows.schema[row_id].dataType).alias(row_id), "_size", _before("_size", "_b"))
    ranked = heavy.withColumn("_d", order)
    spans = spans.unionByName(
        ranked.select(
            F.lit(None).cast("string").alias("_b"), row_id, F.col("_units").alias("_size"),
            (F.lit(sums["light"]) + _before("_units", "_d", row_id)).alias("_start"),
        )
    )
    # At most 2^16 buckets, 2^15 rows and 2^16 cells.
    spans = F.broadcast(spans.withColumn("_cell", _cells(F.col("_start"), F.col("_size"), F.lit(CELL_UNITS))))

    draws = rows.sparkSession.range(n_rows * n_members).select(
        (F.col("id") % n_members).cast("int").alias("k"),
        F.floor(wide_uniform(F.col("id"), f"{seed}:wdraw") * F.lit(float(sums["all"]))).alias("_unit"),
    )
    located = draws.withColumn("_cell", _cell(F.col("_unit"), F.lit(CELL_UNITS))).join(spans, "_cell")
    located = located.filter((F.col("_unit") >= F.col("_start")) & (F.col("_unit") < F.col("_start") + F.col("_size")))

    width = F.ceil(F.col("_size") / BUCKET_CELLS)
    inside = F.col("_unit") - F.col("_start")
    asked = located.filter(F.col("_b").isNotNull()).select("_b", "k", inside.alias("_at"), _cell(inside, width).alias("_sub"))
    own = W.partitionBy("_b").orderBy("_d", row_id)
    first = F.sum("_units").over(own) - F.col("_units")
    placed = buckets.withColumns({"_first": first, "_size": F.sum("_units").over(W.partitionBy("_b"))})
    placed = placed.select("_b", row_id, "_first", "_units", _cells(F.col("_first"), F.col("_units"), width).alias("_sub"))
    hits = asked.join(placed, ["_b", "_sub"]).filter(
        (F.col("_at") >= F.col("_first")) & (F.col("_at") < F.col("_first") + F.col("_units"))
    )
    names = [f"_c{k}" for k in range(n_members)]
    of_heavy = located.filter(F.col("_b").isNull())
    counts = hits.select(row_id, "k").unionByName(of_heavy.select(row_id, "k")).groupBy(row_id).agg(*_counts_of(names))
    bag = F.array(*[F.coalesce(F.col(name), F.lit(0)) for name in names])
    return rows.join(counts, row_id, "left").withColumn("bag", bag).drop(*names)


def _before(size: str, *order: str) -> Column:
    """Sum of ``size`` over all rows that come earlier; for tables of bounded length."""
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(before), F.lit(0)).alias("_start")


def _cell(unit: Column, width: Column) -> Column:
    return F.floor(unit / width)


def _cells(start: Column, size: Column, width: Column) -> Column:
    """One row for each cell that the span reaches into."""
    return F.explode(F.sequence(_cell(start, width), _cell(start + size - 1, width)))


def with_bags(
    rows: DataFrame, n_members: int, method: str, seed: int, n_rows: int | None = None, weight_col: str | None = None
) -> DataFrame:
    """Bags by one of the methods; with weights the exact one draws by them."""
    if method == "poisson":
        return poisson_bags(rows, n_members, seed)
    if weight_col is not None:
        return weighted_bags(rows, n_members, weight_col, seed)
    return (block_bags if method == "block" else exact_bags)(rows, n_members, n_rows, seed)


def in_bag_rows(bagged: DataFrame, k: int, expand: bool = False) -> DataFrame:
    """Training rows of member ``k``: ``weight`` copies in one row, or repeated rows."""
    count = F.col("bag")[k]
    drawn = bagged.filter(count > 0)
    if expand:
        copies = drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), count)))
        return copies.withColumn("weight", F.lit(1.0)).drop("_copy")
    return drawn.withColumn("weight", count.cast("double"))


def each_member(rows: DataFrame, ks: list[int]) -> DataFrame:
    """Repeat each row once per member id; a narrow step."""
    return rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))


def in_bag_rows_of_all(bagged: DataFrame, ks: list[int], expand: bool = False) -> DataFrame:
    """As :func:`in_bag_rows` for many members at once, with their id in ``k``."""
    drawn = each_member(bagged, ks).withColumn("_n", F.col("bag")[F.col("k")]).filter(F.col("_n") > 0)
    if expand:
        drawn = drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        return drawn.withColumn("weight", F.lit(1.0)).drop("_copy", "_n")
    return drawn.withColumn("weight", F.col("_n").cast("double")).drop("_n")


def in_bag_rows_at_once(bagged: DataFrame, ks: list[int], weight_col: str | None = None) -> DataFrame:
    """Each row that a member drew once, with ``weights ARRAY<DOUBLE>``: its count for each of
    ``ks``, times its weight if there is a ``weight_col``."""
    weight = F.col(weight_col) if weight_col else F.lit(1.0)
    weights = F.array(*[F.col("bag")[k] * weight for k in ks])
    drawn = F.greatest(*[F.col("bag")[k] for k in ks], F.lit(0)) > 0
    return bagged.filter(drawn).withColumn("weights", weights)


def in_bag_flags(bag: Column, n_members: int) -> Column:
    """``ARRAY<BOOLEAN>``: true where the member drew the row."""
    return F.array(*[bag[k] > 0 for k in range(n_members)])


def bag_summary(bagged: DataFrame, n_members: int) -> DataFrame:
    """Per member: draws, distinct rows drawn and rows left out."""
    # Not posexplode("bag"): it would add a size filter that computes every bag twice.
    repeated = each_member(bagged.select("bag"), list(range(n_members)))
    long = repeated.select("k", F.col("bag")[F.col("k")].alias("n"))
    return long.groupBy("k").agg(
        F.sum("n").cast("bigint").alias("bag_size"),
        F.sum((F.col("n") > 0).cast("bigint")).alias("in_bag_rows"),
        F.sum((F.col("n") == 0).cast("bigint")).alias("out_of_bag_rows"),
    )
