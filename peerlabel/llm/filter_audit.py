"""How filters interact: what each step of each order of filters keeps, removes and loses.

Every document fails or passes each of k filters, so a part of the corpus is a contingency
tensor of 2 x 2 x ... x 2 counts. Whatever is asked of an order of filters is a contraction
of that tensor: along each axis take the passing side, the failing side or both.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerlabel.llm import bytewords
from peerlabel.llm.common import text_or_empty
from peerlabel.llm.quality import CONTINUES, per_text

UPPER = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))
MARKUP = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)  # what a contraction selects along an axis
WEIGHTS = ("n", "good", "toxic")
PARTS_AT_ONCE = 256
FOUND = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(texts: pa.Array, min_words: int, distinct_percent: int, upper_percent: int) -> np.ndarray:
    """Failures of filters A to D (too short, repetitive, shouting, markup), one row a filter."""
    fails = np.zeros((4, len(texts)), bool)
    for words in bytewords.split(texts, bytewords.NOT_SPACE):
        rows = slice(words.row0, words.row0 + len(words))
        n = np.diff(words.first)
        of = np.repeat(np.arange(len(words)), n)
        # Equal words of different texts differ by the text's number, so one sort serves all.
        keys = bytewords.mix(words.hash + of.astype(np.uint64) * np.uint64(bytewords.BASE))
        order = np.argsort(keys)
        keys = keys[order]
        repeats = np.bincount(of[order][1:][keys[1:] == keys[:-1]], minlength=len(words))
        points = per_text(~CONTINUES[words.data], words.bounds)
        fails[0, rows] = n < min_words
        fails[1, rows] = 100 * (n - repeats) < distinct_percent * n
        fails[2, rows] = 100 * per_text(UPPER[words.data], words.bounds) > upper_percent * points
        fails[3, rows] = per_text(MARKUP[words.data], words.bounds) > 0
    return fails


@dataclass(frozen=True)
class FilterAudit:
    """An audit of five filters over documents, and of any k filters over a tally.

    A: fewer than ``min_words`` words; B: under ``distinct_percent`` percent of the words are
    distinct; C: over ``upper_percent`` percent of the code points are A-Z; D: holds one of
    ``#$%&*|``; E: the text is that of a smaller doc_id, anywhere in the table.
    """

    min_words: int = 100
    distinct_percent: int = 80
    upper_percent: int = 10

    def audit(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of ``contract`` for the five filters, for each language of ``docs``.

        A NULL text is empty, a NULL language the part ``''``. Rows with equal id and text
        are documents of their own: with the smallest id none of them fails E, else all.
        A NULL id is not smaller than any id and never fails E. Of several labels of
        a document any quality 1 and any toxic 1 counts. No documents, no rows.
        """
        return contract(self.tally(docs, labels), "ABCDE")

    def tally(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """(part, cell, n, good, toxic): documents by the filters they fail (bit 16 for A ... 1 for E).

        Texts become digests in the task that reads them. Rows are summed before each
        shuffle, and the smallest id of a text is found among its sums, of which there are four a
        language at most: thousands or millions of copies of a text are no large group anywhere.
        """
        counted = self._judged(docs).groupBy("digest", "doc_id", "part", "cell").agg(F.count(F.lit(1)).alias("n"))
        marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
        )
        # NULL ids have no label; spread by digest they do not meet in one task.
        missing = F.when(F.col("doc_id").isNull(), F.col("digest"))
        known = counted.withColumn("missing", missing).join(
            marks.withColumn("none", F.lit(None).cast("binary")),
            (F.col("doc_id") == F.col("labelled")) & F.col("missing").eqNullSafe(F.col("none")),
            "left",
        )
        known = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
        sums = known.groupBy("digest", "part", "cell", "good", "toxic").agg(
            F.sum("n").alias("n"),
            F.min("doc_id").alias("first"),
            F.min_by("n", "doc_id").alias("n_first"),
            F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_without_id"),
        )
        smallest = F.min("first").over(Window.partitionBy("digest"))
        firsts = F.col("n_without_id") + F.when(F.col("first") == smallest, F.col("n_first")).otherwise(0)
        sides = sums.withColumn("passes", firsts).select(
            "part",
            "good",
            "toxic",
            F.explode(
                F.array(
                    F.struct(F.col("cell").alias("cell"), F.col("passes").alias("n")),
                    F.struct((F.col("cell") + 1).alias("cell"), (F.col("n") - F.col("passes")).alias("n")),
                )
            ).alias("side"),
        )
        n = F.col("side.n")
        return sides.where(n > 0).groupBy("part", F.col("side.cell").alias("cell")).agg(
            F.sum(n).alias("n"),
            F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"),
        )

    def _judged(self, docs: DataFrame) -> DataFrame:
        """(doc_id, part, digest, cell) of every document, E not yet among the bits of the cell."""
        text = text_or_empty("text")
        plain = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
            text.alias("text"),
        )
        limits = (self.min_words, self.distinct_percent, self.upper_percent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fails = text_failures(batch.column(3), *limits)
                cell = np.array([16, 8, 4, 2]) @ fails
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(cell.astype(np.int32))], ["doc_id", "part", "digest", "cell"]
                )

        return plain.mapInArrow(run, "doc_id long, part string, digest binary, cell int")


def contract(tally: DataFrame, filters: str) -> DataFrame:
    """One row per part, order of ``filters`` (one letter each) and step, from counts by cell.

    ``tally`` has (part, cell, n, good, toxic), a cell being a number whose highest of
    k bits is the first filter, set when it fails. The filter of step s is letter s of the order.
    kept: passing this and all earlier ones; removed: failing here after passing
    the earlier ones, of these good_lost and toxic_lost; redundant: failing here but gone before;
    unique_fails: failing this filter alone; shapley: the filter's removed over all orders.
    A part is 2^k counts, however many documents it has.
    """
    k = len(filters)
    parts = tally.groupBy("part").agg(F.collect_list(F.struct("cell", *WEIGHTS)).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(at, PARTS_AT_ONCE)
                yield steps(some.column(0), tensors(some.column(1), k), filters)

    return parts.mapInArrow(run, FOUND)


def tensors(cells: pa.Array, k: int) -> np.ndarray:
    """Counts by part, weight and the sides of k filters."""
    out = np.zeros((len(cells), len(WEIGHTS), 1 << k), np.int64)
    flat = cells.flatten()
    of = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy(zero_copy_only=False))
    cell = flat.field("cell").to_numpy(zero_copy_only=False)
    for w, name in enumerate(WEIGHTS):
        np.add.at(out, (of, w, cell), flat.field(name).to_numpy(zero_copy_only=False))
    return out.reshape(len(cells), len(WEIGHTS), *[2] * k)


def selections(orders: Sequence[Sequence[int]], side: tuple, earlier: tuple, later: tuple) -> np.ndarray:
    """What is selected along each axis at every step of every order, (steps, k, 2)."""
    k = len(orders[0])
    out = np.zeros((len(orders), k, k, 2), np.int64)
    for o, order in enumerate(orders):
        for step in range(k):
            for place, axis in enumerate(order):
                out[o, step, axis] = earlier if place < step else side if place == step else later
    return out.reshape(-1, k, 2)


def select(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """(part, weight, step): the tensor contracted along each axis as chosen for the step."""
    axes = string.ascii_lowercase[: chosen.shape[1]]
    subscripts = f"PW{axes}," + ",".join(f"S{a}" for a in axes) + "->PWS"
    return np.einsum(subscripts, tensor, *(chosen[:, i] for i in range(len(axes))), optimize="greedy")


def steps(parts: pa.Array, tensor: np.ndarray, filters: str) -> pa.RecordBatch:
    k, n_parts = len(filters), len(parts)
    orders = list(permutations(range(k)))
    kept = select(tensor, selections(orders, PASS, PASS, ALL))[:, 0]
    removed, good, toxic = np.moveaxis(select(tensor, selections(orders, FAIL, PASS, ALL)), 1, 0)
    failing = select(tensor, selections(orders, FAIL, ALL, ALL))[:, 0]
    alone = select(tensor, selections(orders, FAIL, PASS, PASS))[:, 0]
    axis = np.array(orders).ravel()  # the filter of each step of each order
    totals = np.stack([removed[:, axis == i].sum(axis=1) for i in range(k)], axis=1)
    names = ["".join(filters[i] for i in order) for order in orders]
    columns = [
        parts.take(pa.array(np.repeat(np.arange(n_parts), factorial(k) * k))),
        pa.array(np.tile(np.repeat(names, k), n_parts)),
        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n_parts * factorial(k))),
        *(pa.array(x.ravel()) for x in (kept, removed, failing - removed, alone, good, toxic, totals[:, axis])),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FOUND.split(", ")])
