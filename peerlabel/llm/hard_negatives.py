"""Hard negatives of anchor vectors, by one-bit codes and exact integer scores.

Vectors are rotated at random and kept as the signs of their coordinates, with two numbers: how
far the vector lies along its code (the alignment) and how long the rest of it is. The inner product
of an anchor with the code comes from popcounts over a few bit planes of the anchor; by
Cauchy and Schwarz the rests add no more than the product of their lengths. So every pair
has an interval that is sure to hold its score. Only pairs whose interval reaches what is
still asked for are scored, in whole numbers.

The anchors are worked off in blocks of bounded size, each against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerlabel.llm.common import materialize, shared_dir

NO_ID = np.iinfo(np.int64).max  # stands for NULL: after every other id in ties
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
EXACT = float(1 << 53)
PLANES = 8  # bits a coordinate of a rotated anchor
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 2048, 64
SLACK = 1e-9  # of |q| |o|, for rounding of the floating-point bounds
ENCODED = "id long, label long, vector binary, code binary, along double, rest double"
FIELDS = (
    ("anchor", "int"), ("anchor_id", "long"), ("place", "int"),
    ("positive_id", "long"), ("positive_score", "long"), ("other_id", "long"), ("score", "long"),
)
FOUND = ", ".join(f"{name} {kind}" for name, kind in FIELDS)
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@lru_cache(maxsize=2)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix. Bounds hold for any one, so last digits may differ by machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, padded with zeros."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    padded = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    padded[:, : packed.shape[1]] = packed
    return padded.view("<u8")


@dataclass
class Codes:
    """Rows as they are searched: ids, labels, whole-number vectors and their codes."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    words: np.ndarray
    along: np.ndarray
    rest: np.ndarray

    def part(self, rows) -> Codes:
        return Codes(*(x[rows] for x in vars(self).values()))


@dataclass
class Queries:
    """Anchors with what their bounds need: bit planes, the grid's step, errors and lengths."""

    codes: Codes
    planes: np.ndarray  # (PLANES, anchors, words)
    low: np.ndarray
    step: np.ndarray
    sums: np.ndarray
    error: np.ndarray
    length2: np.ndarray
    dim: int

    @classmethod
    def of(cls, codes: Codes, seed: int) -> Queries:
        dim = codes.vectors.shape[1]
        with np.errstate(all="ignore"):
            turned = codes.vectors.astype(np.float64) @ rotation(dim, seed)
            low = turned.min(axis=1, initial=np.inf)
            step = np.maximum((turned.max(axis=1, initial=-np.inf) - low) / ((1 << PLANES) - 1), np.finfo(float).tiny)
            grid = np.rint((turned - low[:, None]) / step[:, None])
            grid = np.clip(np.nan_to_num(grid), 0, (1 << PLANES) - 1).astype(np.int64)
            # The error along a code is a mean of errors with signs, so at most that of their sizes.
            error = np.abs(turned - (low[:, None] + step[:, None] * grid)).sum(axis=1) / np.sqrt(dim)
            length2 = (codes.vectors.astype(np.float64) ** 2).sum(axis=1)
        planes = np.stack([words_of((grid >> j & 1).astype(np.uint8)) for j in range(PLANES)])
        return cls(codes, planes, low, step, grid.sum(axis=1), error, length2, dim)

    def part(self, at: slice) -> Queries:
        rest = (self.low, self.step, self.sums, self.error, self.length2)
        return Queries(self.codes.part(at), self.planes[:, at], *(x[at] for x in rest), self.dim)

    def bounds(self, rows: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of every anchor (down) with every row (across)."""
        ones = np.bitwise_count(rows.words).sum(axis=1, dtype=np.int64)
        dots = np.zeros((len(self.low), len(rows.ids)), np.float64)
        for j in range(PLANES):
            for w in range(rows.words.shape[1]):
                both = np.bitwise_count(self.planes[j][:, w, None] & rows.words[None, :, w])
                dots += both * float(1 << j)
        with np.errstate(all="ignore"):
            dots *= 2.0
            dots -= self.sums[:, None]
            dots *= self.step[:, None]
            dots += self.low[:, None] * (2.0 * ones - self.dim)[None, :]
            dots /= np.sqrt(self.dim)  # the anchor along the code, up to the error
            near = np.maximum(np.abs(dots) - self.error[:, None], 0.0)
            across = np.sqrt(np.maximum(self.length2[:, None] - near * near, 0.0))
            lengths = np.sqrt(rows.along**2 + rows.rest**2)
            width = across * rows.rest[None, :]
            width += self.error[:, None] * rows.along[None, :]
            width += (SLACK * np.sqrt(self.length2))[:, None] * lengths[None, :] + SLACK
            dots *= rows.along[None, :]
            return dots - width, dots + width


def scores(anchor: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers; those beyond a long come as the nearest long."""
    with np.errstate(all="ignore"):
        most = np.abs(anchor).max(initial=0.0) * np.abs(vectors).max(initial=0.0) * max(len(anchor), 1)
    if most < EXACT:
        return (vectors.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    whole = [int(x) for x in anchor]
    made = [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in vectors]
    return np.array([min(max(x, LEAST), MOST) for x in made], np.int64)


def best(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` by score, ties by smaller id, in that order."""
    found = np.arange(len(score))
    if len(score) > 4 * most:
        found = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
    return found[np.lexsort((ids[found], ~score[found]))][:most]


class Search:
    """What one task has found for the anchors of a block; the best of all tasks' are the best of all.

    ``windows`` lists for each anchor the (least, greatest) scores asked for; ``same``
    tells whether rows of the same label or of the others are meant.
    """

    def __init__(self, queries: Queries, windows: list[list[tuple[int, int]]], same: bool, most: int):
        self.queries, self.windows, self.same, self.most = queries, windows, same, most
        self.pool = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows)
        # A row can still come among the first of a window from this score on.
        self.least = [[lo for lo, _ in w] for w in windows]
        width = max((len(w) for w in windows), default=0)
        self.floor = np.full((len(windows), width), np.inf)
        self.ceiling = np.full((len(windows), width), -np.inf)
        for a, w in enumerate(windows):
            self.floor[a, : len(w)] = [float(lo) for lo, _ in w]
            self.ceiling[a, : len(w)] = [float(hi) for _, hi in w]

    def add(self, rows: Codes) -> None:
        for at in range(0, len(rows.ids), ROWS_AT_ONCE):
            some = rows.part(slice(at, at + ROWS_AT_ONCE))
            for first in range(0, len(self.windows), ANCHORS_AT_ONCE):
                self._tile(some, slice(first, min(first + ANCHORS_AT_ONCE, len(self.windows))))

    def _tile(self, rows: Codes, at: slice) -> None:
        asked = self.queries.part(at)
        low, high = asked.bounds(rows)
        wanted = np.zeros(low.shape, bool)
        for j in range(self.floor.shape[1]):
            # Bounds that are no numbers (of huge vectors) exclude nothing.
            wanted |= ~(high < self.floor[at, j, None]) & ~(low > self.ceiling[at, j, None])
        same = asked.codes.labels[:, None] == rows.labels[None, :]
        wanted &= same if self.same else ~same
        wanted &= asked.codes.ids[:, None] != rows.ids[None, :]
        for i in np.flatnonzero(wanted.any(axis=1)):
            if self.windows[at.start + i]:
                found = np.flatnonzero(wanted[i])
                self._update(at.start + i, scores(asked.codes.vectors[i], rows.vectors[found]), rows.ids[found])

    def _update(self, a: int, score: np.ndarray, ids: np.ndarray) -> None:
        fresh = (score >= min(self.least[a])) & (score <= max(hi for _, hi in self.windows[a]))
        if not fresh.any():
            return
        score = np.concatenate([self.pool[a][0], score[fresh]])
        ids = np.concatenate([self.pool[a][1], ids[fresh]])
        keep = np.zeros(len(score), bool)
        for j, chosen in enumerate(self._chosen(a, score, ids)):
            keep[chosen] = True
            if len(chosen) == self.most:
                self.least[a][j] = int(score[chosen[-1]])
                self.floor[a, j] = float(score[chosen[-1]])
        self.pool[a] = score[keep], ids[keep]

    def _chosen(self, a: int, score: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
        for lo, hi in self.windows[a]:
            inside = np.flatnonzero((score >= lo) & (score <= hi))
            yield inside[best(score[inside], ids[inside], self.most)]

    def results(self, positives: list[list[tuple[int, int]]] | None) -> Iterator[pa.RecordBatch]:
        """FOUND rows, a batch for some anchors; without ``positives`` their columns are NULL."""
        rows: list[tuple] = []
        for a, (score, ids) in enumerate(self.pool):
            anchor = int(self.queries.codes.ids[a])
            for j, chosen in enumerate(self._chosen(a, score, ids)):
                of, its = positives[a][j] if positives else (None, None)
                rows += [(a, anchor, j, of, its, int(ids[c]), int(score[c])) for c in chosen]
            if len(rows) > 50_000 or (rows and a == len(self.pool) - 1):
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if x == NO_ID else x for x in c] if name in ("positive_id", "other_id") else c, pa.int32() if kind == "int" else pa.int64()) for c, (name, kind) in zip(columns, FIELDS, strict=True)],
                    [name for name, _ in FIELDS],
                )
                rows = []


def blobs(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as one binary value each."""
    width = rows.shape[1] * rows.itemsize
    offsets = (np.arange(len(rows) + 1) * width).astype(np.int32)
    data = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, 0), kind)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1)


@dataclass(frozen=True)
class Coded:
    """The table of codes, the dimension of its vectors and the type of their components."""

    table: DataFrame
    dim: int
    kind: str

    def decode(self, batch: pa.RecordBatch | pa.Table) -> Codes:
        if isinstance(batch, pa.Table):
            batch = pa.concat_batches(batch.to_batches()) if batch.num_rows else pa.RecordBatch.from_pylist([], batch.schema)
        ids, labels, vectors, codes, along, rest = batch.columns
        numbers = [x.to_numpy(zero_copy_only=False) for x in (ids.fill_null(NO_ID), labels, along, rest)]
        return Codes(*numbers[:2], matrix(vectors, self.kind), matrix(codes, "<u8"), *numbers[2:])


@dataclass(frozen=True)
class HardNegatives:
    """For each anchor its first ``n_positives`` rows of the same label, and for each of these the
    first ``n_negatives`` rows of other labels that score from ``least`` to ``most`` percent of it.

    Anchors are rows whose id is divisible by ``anchor_every``. ``block`` bounds the
    anchors that are searched for at once; all blocks are searched against all rows.
    """

    anchor_every: int = 100
    n_positives: int = 5
    n_negatives: int = 10
    least: int = 30
    most: int = 90
    scale: int = 256
    block: int = 8192
    seed: int = 11

    def encode(self, rows: DataFrame) -> Coded:
        """(id, label, vector, code, along, rest) of the rows that take part.

        Left out are rows with a NULL label or vector, or a component that is NULL, not finite, or
        not finite once scaled. Shorter vectors count as filled up with zeros. A row
        without id takes part and comes after all ids in ties, but is no anchor.
        """
        vector = F.col("embedding").cast("array<double>")
        rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), vector.alias("v"))
        limit = np.finfo(float).max / self.scale
        rows = rows.where(
            F.col("label").isNotNull()
            & F.col("v").isNotNull()
            & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= limit))
        )
        shape = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
        dim, scale, seed = max(shape.dim, 1), float(self.scale), self.seed
        kind = "<f4" if (shape.most or 0.0) * scale < (1 << 23) else "<f8"  # both hold the floors exactly
        relabelled = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
        rows = rows.withColumn("label", relabelled)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(2)
                vectors = np.zeros((len(column), dim))
                sizes = column.value_lengths().to_numpy(zero_copy_only=False)
                filled = np.arange(dim)[None, :] < sizes[:, None]
                vectors[filled] = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
                with np.errstate(all="ignore"):
                    turned = vectors @ rotation(dim, seed)
                    along = np.abs(turned).sum(axis=1) / np.sqrt(dim)
                    rest = np.sqrt(np.maximum((vectors**2).sum(axis=1) - along**2, 0.0))
                signs = words_of((turned >= 0).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), blobs(vectors.astype(kind)), blobs(signs), pa.array(along), pa.array(rest)],
                    [f.split()[0] for f in ENCODED.split(", ")],
                )

        return Coded(rows.mapInArrow(run, ENCODED), dim, kind)

    def mine(self, rows: DataFrame) -> DataFrame:
        """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

        Higher scores come first, ties by smaller id. A row never is a partner of a row with
        its own id; of rows that share an id each counts, as an anchor, a positive and a negative.
        A positive with no fitting negative gives no rows, an empty table none at all.
        """
        spark = rows.sparkSession
        coded = self.encode(rows)
        coded = replace(coded, table=materialize(coded.table, "negative-codes"))
        results = shared_dir(spark, "hard-negatives")
        spark.createDataFrame([], MINED).write.parquet(results)
        for anchors in self._blocks(coded):
            queries = Queries.of(coded.decode(anchors), self.seed)
            n = len(queries.codes.ids)
            firsts = self._search(coded, queries, [[(LEAST, MOST)]] * n, None, self.n_positives)
            positives: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            for row in sorted(firsts.collect(), key=lambda r: (r.anchor, r.rank)):  # n_positives an anchor of the block
                positives[row.anchor].append((NO_ID if row.other_id is None else row.other_id, row.score))
            windows = [[(-(-self.least * s // 100), self.most * s // 100) for _, s in of] for of in positives]
            found = self._search(coded, queries, windows, positives, self.n_negatives)
            renamed = found.withColumnsRenamed({"other_id": "negative_id", "score": "negative_score"})
            renamed.select(*(f.split()[0] for f in MINED.split(", "))).write.mode("append").parquet(results)
        return spark.read.schema(MINED).parquet(results)

    def _blocks(self, coded: Coded) -> Iterator[pa.Table]:
        """The anchors, some files of them at a time: at most ``block`` rows."""
        anchors = coded.table.where(F.col("id") % self.anchor_every == 0)
        spark, path = anchors.sparkSession, shared_dir(anchors.sparkSession, "negative-anchors")
        anchors.write.option("maxRecordsPerFile", self.block).parquet(path)
        reader = spark.read.schema(anchors.schema)
        counts = reader.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).count().orderBy("file").collect()
        files: list[str] = []
        size = 0
        for row in counts:
            if files and size + row["count"] > self.block:
                yield reader.parquet(*files).toArrow()
                files, size = [], 0
            files.append(row["file"])
            size += row["count"]
        if files:
            yield reader.parquet(*files).toArrow()

    def _search(self, coded: Coded, queries: Queries, windows, positives, most: int) -> DataFrame:
        """FOUND and ``rank``: the first ``most`` rows in each window of each anchor; of the anchor's own
        label where no ``positives`` are given, of other labels else."""
        asked = coded.table.sparkSession.sparkContext.broadcast((queries, windows, positives))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Search(*asked.value[:2], asked.value[2] is None, most)
            for batch in batches:
                search.add(coded_as.decode(batch))
            yield from search.results(asked.value[2])

        coded_as = replace(coded, table=None)
        order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("other_id"))
        found = coded.table.mapInArrow(run, FOUND)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
