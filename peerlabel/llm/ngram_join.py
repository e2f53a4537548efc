"""Near duplicates by word n-grams: an exact Jaccard join over a count-vector R-tree.

A document is the set of hashes of its distinct n-grams ("shingles"). Hashing sorts the
shingles into groups; the counts of the groups are a point. The overlap of two sets is at
most the sum of the smaller counts of each group, and so is that of a set with any set of a
box, given the box's largest counts.

The tree has three levels. Its root sends points to cells without losing a link: at the
finest grouping every shingle is a group of its own, a set of n shingles shares at least
0.8 n of them with any set that it links with (for a similarity of 0.8), and so two linked
sets have one in common among the 0.2 n + 1 that come first in any order of all shingles.
These are a set's cells. The order puts frequent shingles last, so passages that many
documents share make no cells where there is anything else. Cells with the same smallest
set make a region. Below it, leaves of points carry boxes; pairs of leaves, then pairs of
points, survive by the sum of minima. What survives is verified on the sets themselves.

Most members of a region are copies of one another, so pairs are made in rounds: every set
with the smallest one of its regions; twice, every set with the one of another component
whose bound is highest; all that the bound still allows between components. Links between
documents that are connected already are not looked for; no component is lost by that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peerlabel.llm import bytewords
from peerlabel.llm.bytewords import U64, mix
from peerlabel.llm.common import arrow_batches, materialize
from peerlabel.llm.components import smallest_reachable

WORDS = 5
DIMENSIONS = 128
LEAF_POINTS = 256
GROUP_PAIRS = 500
SMALL_TABLE = 500_000
SAMPLE_OF = 8
BATCH_ROWS = 500
LEAF = (
    "region long, leaf long, members array<struct<id:long,component:long,n:long,vector:array<int>>>, "
    "low long, high long, box array<int>"
)
FREQUENT = 1_000_000


@dataclass(frozen=True)
class NgramJoin:
    """``words`` a shingle; two sets link when 100 * intersection >= percent * union.

    ``dimensions`` of the points, ``leaf_points`` a leaf, ``group_pairs`` sent to a task
    together and ``sample_of``, the share of texts that frequencies are taken from, do not
    change results.
    """

    words: int = WORDS
    percent: int = 80
    dimensions: int = DIMENSIONS
    leaf_points: int = LEAF_POINTS
    group_pairs: int = GROUP_PAIRS
    sample_of: int = SAMPLE_OF

    def components(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_shingles, component_id) per row of ``docs``.

        ``component_id`` is the smallest id reachable by links, its own if there are none.
        NULL texts and texts without words are empty sets, linked with nothing. Texts with
        fewer words than a shingle are one shingle. Equal sets link. Rows with a NULL id have
        a NULL component and link nothing. Repeated rows stay.
        """
        named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        with arrow_batches(docs.sparkSession, BATCH_ROWS):
            return self._components(named).withColumnRenamed("id", id_col)

    def _components(self, named: DataFrame) -> DataFrame:
        grouped = self._grouped(named)
        least = grouped.where("root IS NOT NULL").groupBy(F.col("root").alias("of")).agg(F.min("id").alias("component_id"))
        joined = grouped.join(least, grouped["root"] == least["of"], "left")
        own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
        return joined.select("id", F.col("n").alias("n_shingles"), own.alias("component_id"))

    def one_of_each(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row of ``docs`` of each group of linked texts: that with the smallest id, of rows
        that share it the one whose set's hash, then whose columns are smallest.

        Rows with a NULL id and texts without words are no one's duplicates and all stay.
        """
        columns = [F.col(f"`{c}`") for c in docs.columns]
        named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        with arrow_batches(docs.sparkSession, BATCH_ROWS):
            grouped = materialize(self._grouped(named), "groups")
        linked = grouped.where("root IS NOT NULL")
        chosen = linked.groupBy("root").agg(F.min(F.struct("id", "set_id")).alias("first"))
        chosen = materialize(chosen, "chosen")  # by itself, so that the join with it can split a large group
        others = linked.join(chosen, "root").where("id <> first.id").select("id")
        twice = linked.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id")
        twice = materialize(twice, "repeated-ids")
        # Where ids are unique, they tell rows apart; only rows of repeated ids are looked at again.
        unclear = others.unionByName(twice).distinct().withColumnRenamed("id", "__id")
        clear = docs.join(unclear, docs[id_col] == unclear["__id"], "left_anti")
        again = docs.join(twice.withColumnRenamed("id", "__id"), docs[id_col] == F.col("__id"), "left_semi")
        again = again.select(F.col(id_col).alias("id"), F.struct(*columns).alias("row"), F.col(text_col).alias("text"))
        with arrow_batches(docs.sparkSession, BATCH_ROWS):
            again = materialize(self.sets(again), "repeated-rows")
        firsts = chosen.select(F.col("first.id").alias("id"), F.col("first.set_id").alias("set_id"))
        kept = again.where("n > 0").join(firsts, ["id", "set_id"]).groupBy("id", "set_id").agg(F.min("row").alias("row"))
        wordless = again.where("n = 0").select("row")
        return clear.unionByName(kept.select("row").unionByName(wordless).select("row.*"))

    def _grouped(self, named: DataFrame) -> DataFrame:
        """(id, n, set_id, root) per row: sets of one ``root`` are linked. It is NULL for rows
        without id or words. All that runs Python is written to files in here."""
        sets = materialize(self.sets(named), "shingle-sets")
        reps = sets.where("n > 0 AND id IS NOT NULL").groupBy("set_id").agg(
            F.min("id").alias("rep"), F.min("n").alias("n"), F.first("vector").alias("vector")
        )
        reps = materialize(reps, "distinct-sets")
        roots = self.roots(named, reps)
        labels = reps.join(roots, reps["set_id"] == roots["id"], "left").select(
            F.col("set_id").alias("of"), F.coalesce("root", "set_id").alias("root")
        )
        has = (sets["n"] > 0) & sets["id"].isNotNull()
        return sets.join(labels, (sets["set_id"] == labels["of"]) & has, "left").select("id", "n", "set_id", "root")

    # -- sets and points

    def sets(self, named: DataFrame) -> DataFrame:
        """(id, n, set_id, vector) per row of ``named`` (id, text).

        ``set_id`` is a 64-bit hash of the set: documents with equal sets share it and are one
        from there on. ``vector`` is the point.
        """
        dimensions = self.dimensions

        def columns(n: int, found: Iterator[tuple[int, np.ndarray]]) -> list[pa.Array]:
            size, ids, vectors = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
            for row, shingles in found:
                size[row], ids[row] = len(shingles), set_id(shingles)
                vectors[row] = point_of(shingles, dimensions)
            return [pa.array(size), pa.array(ids), pa.array(vectors, pa.list_(pa.int32()))]

        return self._mapped(named, columns, "n long, set_id long, vector array<int>")

    def _mapped(self, named: DataFrame, columns, schema: str) -> DataFrame:
        """``named`` with its text replaced by what ``columns`` makes of its sets."""
        others = [c for c in named.columns if c != "text"]
        kinds = dict(named.dtypes)
        schema = ", ".join([*(f"{c} {kinds[c]}" for c in others), schema])
        at, words = len(others), self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [field.split()[0] for field in schema.split(", ")]
            for batch in batches:
                made = columns(batch.num_rows, shingle_sets(batch.column(at), words))
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], *made], names)

        return named.select(*others, "text").mapInArrow(run, schema)

    # -- components

    def roots(self, named: DataFrame, reps: DataFrame) -> DataFrame:
        """(id, root): the smallest ``set_id`` that links reach, of sets that reach a smaller."""
        regions = self._regions(named)
        chosen = regions.where("id <> region").groupBy(F.col("id").alias("x")).agg(F.min("region").alias("y"))
        pairs = materialize(self._bounded(chosen, reps), "pairs")
        roots = self._joined(pairs, named, reps, None)
        for best_only in (True, True, False):
            found = self._across(self._placed(regions, roots), reps, best_only)
            found = materialize(found.join(pairs, ["x", "y"], "left_anti"), "pairs")
            roots = self._joined(found, named, reps, roots)
            pairs = pairs.unionByName(found)
        return roots

    def _joined(self, pairs: DataFrame, named: DataFrame, reps: DataFrame, roots: DataFrame | None) -> DataFrame:
        """``roots`` with the links among ``pairs``."""
        links = self._verified(pairs, named, reps).select(F.col("x").alias("a"), F.col("y").alias("b"))
        if roots is not None:
            links = links.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))
        return smallest_reachable(materialize(links, "links"))

    def _frequent(self, named: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Frequent shingles, sorted, and how often each was seen.

        Counted in the texts whose hash falls into one of ``sample_of`` classes. This only
        orders shingles: any answer gives the same links, from more cells or fewer. Should
        there be more than ``FREQUENT`` of them, the most frequent are taken.
        """
        sample = named.where((F.pmod(F.xxhash64("text"), F.lit(self.sample_of)) == 0) & F.col("id").isNotNull())

        def columns(n: int, found: Iterator[tuple[int, np.ndarray]]) -> list[pa.Array]:
            contents, seen = [None] * n, set()
            for row, shingles in found:
                key = set_id(shingles)
                if key not in seen:  # copies count once
                    seen.add(key)
                    contents[row] = shingles.view(np.int64)
            return [pa.array(contents, pa.list_(pa.int64()))]

        counted = self._mapped(sample.select("text"), columns, "shingles array<long>")
        counted = counted.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().where("count > 1")
        counted = materialize(counted, "frequent-shingles")
        least, rows = 2, 0
        for row in counted.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).toLocalIterator():
            rows += row["n"]
            if rows > FREQUENT:
                least = row["count"] + 1
                break
        table = counted.where(F.col("count") >= least).toArrow()
        shingles = table["shingle"].to_numpy().view(U64)
        order = np.argsort(shingles)
        return shingles[order], table["count"].to_numpy()[order]

    def _regions(self, named: DataFrame) -> DataFrame:
        """(region, id): the sets of cells that hold more than one; cells with the same
        smallest set are one region, named by it.

        A batch gives the cells of a set once, so copies are combined before the shuffle.
        """
        percent = self.percent
        sent = named.sparkSession.sparkContext.broadcast(self._frequent(named))

        def columns(n: int, found: Iterator[tuple[int, np.ndarray]]) -> list[pa.Array]:
            ids, cells, seen = np.zeros(n, np.int64), [None] * n, set()
            for row, shingles in found:
                ids[row] = set_id(shingles)
                if ids[row] not in seen:
                    seen.add(int(ids[row]))
                    cells[row] = cells_of(shingles, percent, *sent.value).view(np.int64)
            return [pa.array(ids), pa.array(cells, pa.list_(pa.int64()))]

        texts = named.where("id IS NOT NULL").select("text")
        found = self._mapped(texts, columns, "id long, cells array<long>")
        members = found.select(F.explode("cells").alias("cell"), "id").repartition("cell")
        hubs = members.groupBy("cell").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top")
        hubs = hubs.select(F.col("cell").alias("of"), "hub")
        held = members.join(hubs, members["cell"] == hubs["of"]).select(F.col("hub").alias("region"), "id")
        return materialize(held.distinct(), "regions")

    def _placed(self, regions: DataFrame, roots: DataFrame) -> DataFrame:
        """(region, id, component) of the regions with more than one component."""
        roots = roots.select(F.col("id").alias("of"), "root")
        placed = regions.join(roots, regions["id"] == roots["of"], "left").select(
            "region", "id", F.coalesce("root", "id").alias("component")
        )
        mixed = placed.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        return placed.join(mixed.where("low < high").select("region"), "region")

    def _bounded(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """``pairs`` whose overlap may be large enough, by the sum of minima."""
        a = reps.select(F.col("set_id").alias("x"), F.col("n").alias("nx"), F.col("vector").alias("vx"))
        b = reps.select(F.col("set_id").alias("y"), F.col("n").alias("ny"), F.col("vector").alias("vy"))
        return pairs.join(a, "x").join(b, "y").where(self._may_link("nx", "vx", "ny", "vy")).select("x", "y")

    def _may_link(self, nx: str, vx: str, ny: str, vy: str):
        """overlap * (100 + percent) >= percent * (nx + ny), with minima for the overlap."""
        overlap = F.expr(f"aggregate(zip_with({vx}, {vy}, (a, b) -> least(a, b)), 0L, (s, c) -> s + c)")
        return overlap * (100 + self.percent) >= self.percent * (F.col(nx) + F.col(ny))

    def _verified(self, pairs: DataFrame, named: DataFrame, reps: DataFrame) -> DataFrame:
        """The linked ones of ``pairs``, by their sets.

        The sets of each y's partners are sent to it, in groups of ``group_pairs`` at most that
        each get its set as well: a set crosses the network once a pair.
        """
        size = self.group_pairs
        counts = pairs.groupBy(F.col("y").alias("hub")).agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
        part = F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part")
        members = pairs.join(counts, pairs["y"] == counts["hub"]).select(F.col("x").alias("of"), "hub", part)
        hubs = counts.select(
            F.col("hub").alias("of"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part")
        )
        asked = members.unionByName(hubs)
        asked = asked.join(reps, asked["of"] == reps["set_id"]).select("rep", "of", "hub", "part")
        asked = materialize(asked, "asked")
        asked = F.broadcast(asked) if asked.count() <= SMALL_TABLE else asked
        wanted = named.join(asked, named["id"] == asked["rep"]).select("of", "hub", "part", "text")

        def columns(n: int, found: Iterator[tuple[int, np.ndarray]]) -> list[pa.Array]:
            made, contents = np.zeros(n, np.int64), [None] * n
            for row, shingles in found:
                made[row] = set_id(shingles)
                contents[row] = shingles.tobytes()
            return [pa.array(made), pa.array(contents, pa.binary())]

        # Rows that share their id with the one asked for, but not its set, are not it.
        sets = self._mapped(wanted, columns, "made long, shingles binary").where("made = of").drop("made")
        grouped = sets.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("of") != F.col("hub"))
        return grouped.mapInArrow(_linked_to_hub(self.percent), "x long, y long")

    def _across(self, placed: DataFrame, reps: DataFrame, best_only: bool) -> DataFrame:
        """Pairs of different components of a region whose bound allows a link, by a join of
        leaves; or for each set only the one with the highest bound."""
        sized = reps.select(F.col("set_id").alias("of"), "n", "vector")
        kept = placed.join(sized, placed["id"] == sized["of"])
        # Leaves are runs of members of like size and like counts.
        order = W.partitionBy("region").orderBy("n", "vector", "id")
        leaf = F.floor((F.row_number().over(order) - 1) / self.leaf_points)
        members = F.collect_list(F.struct("id", "component", "n", "vector")).alias("members")
        leaves = kept.withColumn("leaf", leaf).groupBy("region", "leaf").agg(
            members, F.min("n").alias("low"), F.max("n").alias("high")
        )
        leaves = materialize(leaves.mapInArrow(_boxed, LEAF), "leaves")
        a, b = (
            leaves.select("region", *(F.col(c).alias(f"{c}_{side}") for c in leaves.columns if c != "region"))
            for side in ("a", "b")
        )
        pairs = a.join(b, "region").where("leaf_a <= leaf_b").where(
            (F.col("high_a") * 100 >= self.percent * F.col("low_b")) & self._may_link("low_a", "box_a", "low_b", "box_b")
        )
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                same, left, right = batch.columns
                found = [
                    leaf_pairs(_Leaf(left[row]), _Leaf(right[row]), same[row].as_py(), percent, best_only)
                    for row in range(batch.num_rows)
                ]
                columns = [np.concatenate([f[i] for f in found]) if found else [] for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)],
                    ["p", "q", "score"],
                )

        chosen = pairs.select((F.col("leaf_a") == F.col("leaf_b")).alias("same"), "members_a", "members_b")
        found = chosen.mapInArrow(run, "p long, q long, score double")
        if best_only:
            found = found.groupBy("p").agg(F.max_by("q", F.struct("score", "q")).alias("q"))
        return found.select(F.greatest("p", "q").alias("x"), F.least("p", "q").alias("y")).distinct()


class _Leaf:
    """Points of a leaf as arrays."""

    def __init__(self, members: pa.ListScalar):
        values = members.values
        self.id, self.component, self.size = (values.field(i).to_numpy() for i in range(3))
        self.vector = values.field(3).flatten().to_numpy().reshape(len(self.id), -1)


def _boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves with their boxes: the largest count of each group."""
    for batch in batches:
        boxes = [_Leaf(members).vector.max(axis=0) for members in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(boxes, pa.list_(pa.int32()))], ["region", "leaf", "members", "low", "high", "box"]
        )


def leaf_pairs(
    a: _Leaf, b: _Leaf, same: bool, percent: int, best_only: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, similarity at most) of points of different components whose bound allows a link:
    each pair once, or with ``best_only`` the best partner of each point of either leaf."""
    bound = np.zeros((len(a.id), len(b.id)))
    for i in range(len(a.id)):
        overlap = np.minimum(b.vector, a.vector[i]).sum(axis=1, dtype=np.int64)
        total = b.size + a.size[i]
        allowed = (b.component != a.component[i]) & (overlap * (100 + percent) >= percent * total)
        bound[i] = np.where(allowed, overlap / (total - np.minimum(overlap, total // 2)), 0)
    if best_only:
        i, j = np.arange(len(a.id)), bound.argmax(axis=1)
        k, m = bound.argmax(axis=0), np.arange(len(b.id))
        p, q = np.concatenate([a.id[i], b.id[m]]), np.concatenate([b.id[j], a.id[k]])
        score = np.concatenate([bound[i, j], bound[k, m]])
        return p[score > 0], q[score > 0], score[score > 0]
    i, j = np.nonzero(np.triu(bound, 1) if same else bound)
    return a.id[i], b.id[j], bound[i, j]


def _linked_to_hub(percent: int):
    """(x, y) of the sets that link with the hub's set, which comes first in its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, first = None, None
        for batch in batches:
            of, hubs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            xs, ys = [], []
            for row, content in enumerate(batch.column(3)):
                shingles = np.frombuffer(content.as_buffer(), U64)
                if of[row] == hubs[row]:
                    hub, first = hubs[row], shingles.copy()
                elif hubs[row] == hub:
                    both = len(np.intersect1d(first, shingles, assume_unique=True))
                    if both * (100 + percent) >= percent * (len(first) + len(shingles)):
                        xs.append(of[row])
                        ys.append(hub)
            kinds = pa.array(xs, pa.int64()), pa.array(ys, pa.int64())
            yield pa.RecordBatch.from_arrays(list(kinds), ["x", "y"])

    return run


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of the texts that have words."""
    for split in bytewords.split(texts, bytewords.NOT_SPACE, lower=True):
        runs = bytewords.run_hash(split.hash, words)
        counts = np.diff(split.first)
        for t in np.flatnonzero(counts).tolist():
            first, n = int(split.first[t]), int(counts[t])
            if n >= words:
                yield split.row0 + t, np.unique(runs[first : first + n - words + 1])
            else:
                yield split.row0 + t, bytewords.run_hash(split.hash[first : first + n], n)


def set_id(shingles: np.ndarray) -> int:
    """A hash of a set: a sum of scrambled members, scrambled with the size."""
    total = mix(mix(shingles ^ U64(0xA0761D6478BD642F)).sum(keepdims=True) + U64(len(shingles)))
    return int(total.view(np.int64)[0])


def point_of(shingles: np.ndarray, dimensions: int) -> np.ndarray:
    groups = (shingles >> U64(32)) * U64(dimensions) >> U64(32)
    return np.bincount(groups.astype(np.int64), minlength=dimensions).astype(np.int32)


def cells_of(shingles: np.ndarray, percent: int, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The n - ceil(n * percent / 100) + 1 rarest shingles of a set, by hash on ties."""
    n = len(shingles)
    size = n - -(-n * percent // 100) + 1
    if not len(frequent):
        return shingles[:size]
    at = np.searchsorted(frequent, shingles)
    at[at == len(frequent)] = 0
    seen = np.where(frequent[at] == shingles, counts[at], 0)
    return shingles[np.argsort(seen, kind="stable")[:size]]
