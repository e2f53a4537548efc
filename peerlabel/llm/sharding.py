"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised at its quantiles, so that cells are about equally full; the
cell's place on the Hilbert curve orders the rows; equal runs of that order are the
shards. Neighbours on the curve are close in every dimension, so a shard's files have
narrow ranges in all of them and readers can skip files by any.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peerlabel.llm.common import materialize, text_or_empty

ROWS_PER_GROUP = 200_000


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place of a cell on the Hilbert curve of 2^bits cells a side.

    Gray-code form: from the highest bit down, the orthant of the cell in the curve's
    present orientation is the next digit; entering it turns and reflects the axes.
    """
    n = len(point)
    entry, axis, index = 0, 0, 0
    for level in range(bits - 1, -1, -1):
        orthant = sum(((p >> level) & 1) << i for i, p in enumerate(point))
        turned = _rotate_right(orthant ^ entry, axis + 1, n)
        digit = _from_gray(turned)
        index = index << n | digit
        entry ^= _rotate_left(_entry(digit), axis + 1, n)
        axis = (axis + _direction(digit, n) + 1) % n
    return index


def _rotate_right(x: int, by: int, n: int) -> int:
    by %= n
    return (x >> by | x << (n - by)) & ((1 << n) - 1)


def _rotate_left(x: int, by: int, n: int) -> int:
    return _rotate_right(x, n - by % n, n)


def _from_gray(x: int) -> int:
    y = 0
    while x:
        y ^= x
        x >>= 1
    return y


def _entry(digit: int) -> int:
    """Corner at which the curve enters its digit-th orthant."""
    if digit == 0:
        return 0
    even = 2 * ((digit - 1) // 2)
    return even ^ (even >> 1)


def _direction(digit: int, n: int) -> int:
    """Axis along which the curve leaves its digit-th orthant."""
    if digit == 0:
        return 0
    low = digit - 1 if digit % 2 == 0 else digit
    ones = 0
    while low & 1:
        ones, low = ones + 1, low >> 1
    return ones % n


def string_cuts(docs: DataFrame, column: str, steps: list[float]) -> list[str | None]:
    """For each step the smallest value that at least that share of the rows do not exceed.

    Values count as a whole, byte by byte, however long a beginning they share. Only
    distinct values are ordered, in ranges of them; NULLs do not count.
    """
    value = F.col(f"`{column}`").alias("value")
    counts = docs.select(value).where(value.isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    placed = materialize(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "string-values")
    starts = placed.groupBy("part").agg(F.sum("n").alias("rows"))  # one row a range
    starts = starts.select("part", (F.sum("rows").over(W.orderBy("part")) - F.col("rows")).alias("start"))
    upto = F.sum("n").over(W.partitionBy("part").orderBy("value")) + F.col("start")
    running = placed.join(F.broadcast(starts), "part").select("value", upto.alias("upto"))
    total = placed.agg(F.sum("n")).first()[0] or 0
    return list(running.agg(*(F.min(F.when(F.col("upto") >= q * total, F.col("value"))) for q in steps)).first())


@dataclass(frozen=True)
class HilbertSharder:
    """``shards`` runs of the curve over ``dimensions`` (columns, strings or numbers), each
    quantised to 2^bits cells. Row counts of shards differ by one at most (law ``rows``)."""

    shards: int = 8
    dimensions: tuple[str, ...] = ("lang", "source", "n_chars")
    bits: int = 4
    accuracy: int = 10_000
    rows_per_group: int = ROWS_PER_GROUP

    def assign(self, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """``docs`` with ``curve``, ``shard`` and ``slot`` (from 0, without gaps, a shard).

        Only the id and the dimensions decide; NULL dimensions fall into the first cell.
        Ties on the curve are ordered by a hash of the id, then the id, then the dimensions;
        rows equal in all these take neighbouring slots in any order, so ids should be
        unique. With fewer rows than shards some shards stay empty. Columns of the names
        made here are replaced; names that begin with two underscores are the operator's.
        """
        kept = [c for c in docs.columns if c not in ("curve", "shard", "slot")]
        placed = self._on_curve(docs.select(*(F.col(f"`{c}`") for c in kept)))
        total, groups = self._groups(placed, id_col)
        sub = self._sub(id_col, groups)
        # Rows before each group, from counts alone: of the cells before its own, and of the
        # hash groups before it in its cell.
        counts = placed.groupBy("curve", sub.alias("__sub")).agg(F.count(F.lit(1)).alias("__n"))
        cells = counts.groupBy("curve").agg(F.sum("__n").alias("__cell"))
        before = cells.select(  # one row a cell of the grid at most
            "curve", (F.sum("__cell").over(W.orderBy("curve")) - F.col("__cell")).alias("__cells_before")
        )
        within = F.sum("__n").over(W.partitionBy("curve").orderBy("__sub")) - F.col("__n")
        starts = counts.select("curve", "__sub", within.alias("__within")).join(F.broadcast(before), "curve")
        starts = starts.select("curve", "__sub", (F.col("__within") + F.col("__cells_before")).alias("__start"))
        ordered = W.partitionBy("curve", "__sub").orderBy(
            *(F.col(f"`{c}`") for c in dict.fromkeys((id_col, *self.dimensions)))
        )
        ranked = placed.withColumn("__sub", sub).withColumn("__row", F.row_number().over(ordered) - 1)
        rank = F.col("__start") + F.col("__row")
        rows = max(total, 1)
        shard = F.expr(f"CAST((__start + __row) * {self.shards}L DIV {rows}L AS INT)")
        first = F.expr(f"(shard * {rows}L + {self.shards - 1}) DIV {self.shards}L")
        return (
            ranked.join(starts, ["curve", "__sub"])
            .withColumn("shard", shard)
            .withColumn("slot", (rank - first).cast("long"))
            .select(*(F.col(f"`{c}`") for c in kept), "curve", "shard", "slot")
        )

    def write(self, assigned: DataFrame, path: str, files_per_shard: int = 1) -> None:
        """Writes shards as folders of files that are runs of the curve."""
        width = F.max("slot").over(W.partitionBy("shard")) + 1
        run = F.floor(F.col("slot") * files_per_shard / width)
        ordered = assigned.withColumn("_run", run).repartition("shard", "_run").sortWithinPartitions("shard", "slot")
        ordered.drop("_run").write.partitionBy("shard").parquet(path)

    def _on_curve(self, docs: DataFrame) -> DataFrame:
        kinds = dict(docs.dtypes)
        steps = [q / (1 << self.bits) for q in range(1, 1 << self.bits)]
        strings = [c for c in self.dimensions if kinds[c] == "string"]
        values = {c: F.col(f"`{c}`") if c in strings else F.col(f"`{c}`").cast("double") for c in self.dimensions}
        cuts = {c: string_cuts(docs, c, steps) for c in strings}
        numbers = [c for c in self.dimensions if c not in strings]
        if numbers:
            found = docs.agg(*(F.percentile_approx(values[c], steps, self.accuracy) for c in numbers)).first()
            cuts |= dict(zip(numbers, found, strict=True))
        cell = F.lit(0)
        for name, value in values.items():
            bin_ = F.lit(0)
            for cut in (c for c in cuts[name] or [] if c is not None):
                bin_ = bin_ + F.coalesce((value > F.lit(cut)).cast("int"), F.lit(0))
            cell = cell * (1 << self.bits) + bin_
        spark = docs.sparkSession
        table = spark.createDataFrame(self._cells(), "__cell long, curve long")  # 2^(bits * dimensions) rows
        return docs.withColumn("__cell", cell.cast("long")).join(F.broadcast(table), "__cell").drop("__cell")

    def _cells(self) -> list[tuple[int, int]]:
        n, side = len(self.dimensions), 1 << self.bits
        out = []
        for cell in range(side**n):
            point = tuple(cell // side ** (n - 1 - i) % side for i in range(n))
            out.append((cell, hilbert_index(point, self.bits)))
        return out

    def _groups(self, placed: DataFrame, id_col: str) -> tuple[int, int]:
        total = placed.select(id_col).count()
        return total, max(1, -(-total // self.rows_per_group))

    @staticmethod
    def _sub(id_col: str, groups: int) -> Column:
        """Splits the rows of a cell, however many, into groups of about equal size."""
        return F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(groups))


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the size and checksum of its texts instead of the texts."""
    text = text_or_empty(text_col)
    return docs.withColumns(
        {
            "size": (F.octet_length(text) + 1).cast("long"),
            "text_crc32": F.crc32(F.encode(text, "UTF-8")).cast("long"),
        }
    ).drop(text_col)
