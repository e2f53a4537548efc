"""Random trees of all members, grown together level by level.

One aggregate a level counts the classes of every (member, node, feature, bin) that can be
split, with the features of each node chosen by digest; the best split of a node is found
where its counts lie, and the driver gets one row a node. Every choice follows from the rows,
the weights and the seed alone, so the trees do not depend on how the rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peerlabel.functions.exact import exact_sum
from peerlabel.functions.voting import hard_vote
from peerlabel.operators.joint import as_array, dense, n_features_of

EDGE_ROWS = 10_000  # rows with the smallest hashes, from which bins are made
DEEPEST = 12
GAIN = 1 + 1e-12  # a split has to be purer than its node by more than rounding


@dataclass(frozen=True)
class TreeVoter:
    """A tree as arrays by node: the right child of a node follows its left one; leaves have none."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    shares: tuple[tuple[float, ...], ...]  # by class, then node
    depth: int
    n_classes: int
    feature_col: str = "features"
    soft: bool = True

    @property
    def hard(self) -> bool:
        return True  # votes are complete and finite by construction

    def vote(self, rows: DataFrame, out_col: str) -> DataFrame:
        node = self._leaf(as_array(rows, self.feature_col))
        placed = rows.withColumn("_leaf", node)
        values = [_table(s, "double")[F.col("_leaf")] for s in self.shares]
        if self.soft:
            vote = F.array(*values)
        else:
            winners = np.argmax(np.array(self.shares), axis=0)
            vote = hard_vote(_table(winners.tolist(), "int")[F.col("_leaf")], self.n_classes)
        return placed.select(*rows.columns, vote.alias(out_col))

    def _leaf(self, values: Column) -> Column:
        if not self.depth:
            return F.lit(0)
        feature, threshold, left = _table(self.feature, "int"), _table(self.threshold, "double"), _table(self.left, "int")

        def down(x: Column) -> Column:
            def step(node: Column, _: Column) -> Column:
                right = (x[feature[node]] > threshold[node]).cast("int")
                return F.when(left[node] < 0, node).otherwise(left[node] + right)

            return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), step)

        # Bound to a name, so that a vector is unpacked once a row.
        return F.element_at(F.transform(F.array(values), down), 1)


def _table(values: Sequence, kind: str) -> Column:
    """A constant array, folded before execution."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


@dataclass(frozen=True)
class TreeMember:
    """A tree of which every node may use ``features_per_node`` features, chosen by digest of
    ``seed``, the member's ``number`` and the node.

    Splits lower the Gini impurity most; of equal ones the lowest feature, then the lowest
    threshold. Thresholds are the values of at most ``max_bins`` bins of each feature. A node is
    a leaf at ``max_depth``, when it is pure or when no split makes it purer.
    """

    number: int
    n_classes: int
    features_per_node: int
    max_depth: int = 8
    max_bins: int = 32
    seed: int = 1
    soft: bool = True
    feature_col: str = "features"

    def __post_init__(self):
        if not 0 < self.max_depth <= DEEPEST:
            raise ValueError(f"max_depth must be in 1..{DEEPEST}")

    def fit(self, rows: DataFrame) -> TreeVoter:
        weights = F.array(F.col("weight").cast("double"))
        return grow([self], rows.select(self.feature_col, "label", weights.alias("weights")))[0]

    @staticmethod
    def fit_jointly(members: Sequence[TreeMember], ks: Sequence[int], rows: DataFrame) -> dict[int, TreeVoter]:
        return dict(zip(ks, grow([members[k] for k in ks], rows), strict=True))

    def features_of(self, node: int, n_features: int) -> list[int]:
        """The features that node ``node`` may use; the root is 1, children of n are 2 n and 2 n + 1."""

        def rank(j: int) -> str:
            return hashlib.md5(f"{j}:{self.seed}:node:{self.number}:{node}".encode()).hexdigest()

        return sorted(sorted(range(n_features), key=rank)[: self.features_per_node])


@dataclass
class _Tree:
    """A tree while it grows; nodes in the order of their making, the root first."""

    feature: list = field(default_factory=lambda: [0])
    bin: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    name: list = field(default_factory=lambda: [1])
    counts: list = field(default_factory=lambda: [None])
    active: list = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, at: int) -> None:
        self.feature[node], self.bin[node], self.left[node] = feature, at, len(self.left)
        for side in (0, 1):
            for column, value in zip((self.feature, self.bin, self.left, self.name, self.counts), (0, 0, -1, 2 * self.name[node] + side, None)):
                column.append(value)


def tree_members_jointly(n_members: int, n_classes: int, features_per_node: int, **options) -> list[TreeMember]:
    """Random trees that are grown together, one aggregate a level."""
    return [TreeMember(k, n_classes, features_per_node, **options) for k in range(n_members)]


def grow(members: Sequence[TreeMember], rows: DataFrame, passes: list | None = None) -> list[TreeVoter]:
    """The trees of ``members`` on ``rows`` with ``weights`` (one for each); appends the number of
    nodes looked at to ``passes`` at each pass."""
    feature_col, n_classes, max_bins = members[0].feature_col, members[0].n_classes, members[0].max_bins
    if any((m.feature_col, m.n_classes, m.max_bins) != (feature_col, n_classes, max_bins) for m in members):
        raise ValueError("members grown jointly must share features, classes and bins")
    n_features = n_features_of(rows, feature_col)
    edges = _edges(rows, feature_col, max_bins)
    binned = _binned(rows, feature_col, edges).persist(StorageLevel.MEMORY_AND_DISK)
    trees = [_Tree() for _ in members]
    try:
        for depth in range(max(m.max_depth for m in members) + 1):
            asked = [(k, i) for k, t in enumerate(trees) for i in t.active]
            if not asked:
                break
            if passes is not None:
                passes.append(len(asked))
            for t in trees:
                t.active = []
            found = _level(binned, trees, members, asked, n_features, n_classes, depth)
            if depth == 0 and len(found) < len(members):
                raise ValueError("no training rows")
            for row in found:
                tree, member = trees[row.k], members[row.k]
                tree.counts[row.node] = total = list(row.total)
                pure = sum(x * x for x in total) / sum(total)
                if depth < member.max_depth and row.score is not None and row.score > pure * GAIN:
                    at = len(tree.left)
                    tree.split(row.node, row.feature, row.bin)
                    tree.active += [at, at + 1]
    finally:
        binned.unpersist()
    return [_voter(m, t, edges) for m, t in zip(members, trees, strict=True)]


def _edges(rows: DataFrame, feature_col: str, max_bins: int) -> list[np.ndarray]:
    """Upper ends of each feature's bins: its values if they are few, else quantiles."""
    x = as_array(rows, feature_col).alias("x")
    sample = rows.select(x).withColumn("h", F.xxhash64("x")).orderBy("h", "x").limit(EDGE_ROWS).select("x").toArrow()
    values = dense(sample["x"].combine_chunks())
    edges = []
    for j in range(values.shape[1]):
        own = np.unique(values[:, j])
        if len(own) > max_bins:
            own = np.unique(np.quantile(values[:, j], np.arange(1, max_bins + 1) / max_bins, method="inverted_cdf"))
        edges.append(own)
    return edges


def _binned(rows: DataFrame, feature_col: str, edges: list[np.ndarray]) -> DataFrame:
    """(bins ARRAY<INT>, label, weights): the number of edges below each value, the last bin at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column(0), len(edges))
            bins = np.stack([np.minimum(np.searchsorted(e, x[:, j]), len(e) - 1) for j, e in enumerate(edges)], axis=1)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * len(edges)
            made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bins.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([made, *batch.columns[1:]], ["bins", "label", "weights"])

    narrowed = rows.select(as_array(rows, feature_col).alias("x"), F.col("label").cast("int").alias("label"), "weights")
    return narrowed.mapInArrow(run, "bins array<int>, label int, weights array<double>")


def _level(binned, trees, members, asked, n_features, n_classes, depth):
    """One row for each node ``asked`` that has rows: k, node, total weights by class, and feature, bin
    and score of its best split (NULL if it has none)."""
    per_member = []
    for k, (tree, member) in enumerate(zip(trees, members, strict=True)):
        nodes = [i for of, i in asked if of == k]
        if not nodes:
            continue
        chosen = [member.features_of(tree.name[i], n_features) for i in nodes]
        place = {i: p for p, i in enumerate(nodes)}
        at = _table([place.get(i, -1) for i in range(len(tree.left))], "int")
        features = _table([j for of in chosen for j in of], "int")
        node = _node_of(F.col("bins"), tree, depth)
        width = len(chosen[0])
        weight = F.col("weights")[k]
        own = F.struct(F.lit(k).alias("k"), node.alias("node"), weight.alias("w"), at[node].alias("at"))
        listed = F.transform(
            F.array(own),
            lambda o: F.struct(
                o["k"].alias("k"), o["node"].alias("node"), o["w"].alias("w"),
                F.when((o["w"] > 0) & (o["at"] >= 0), F.slice(features, o["at"] * width + 1, F.lit(width))).alias("features"),
            ),
        )
        per_member.append(listed)
    long = binned.select("bins", "label", F.inline(F.concat(*per_member))).filter(F.col("features").isNotNull())
    long = long.select("k", "node", "label", "w", "bins", F.explode("features").alias("feature"))
    counted = long.groupBy("k", "node", "feature", F.col("bins")[F.col("feature")].alias("bin"), "label").agg(exact_sum(F.col("w")).alias("w"))
    sides = [f"n{c}" for c in range(n_classes)]
    by_bin = counted.groupBy("k", "node", "feature", "bin").agg(
        *[F.sum(F.when(F.col("label") == c, F.col("w")).otherwise(0.0)).alias(n) for c, n in enumerate(sides)]
    )
    upto = W.partitionBy("k", "node", "feature").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("k", "node", "feature")
    summed = by_bin.withColumns({f"l{n}": F.sum(n).over(upto) for n in sides} | {f"t{n}": F.sum(n).over(whole) for n in sides})
    summed = summed.withColumns({f"r{n}": F.col(f"t{n}") - F.col(f"l{n}") for n in sides})

    def purity(side: str) -> Column:
        parts = [F.col(f"{side}{n}") for n in sides]
        return F.try_divide(_plus([p * p for p in parts]), _plus(parts))

    scored = summed.withColumn("score", purity("l") + purity("r"))  # NULL at the last bin: nothing is right of it
    best = scored.groupBy("k", "node").agg(
        F.min(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), "feature", "bin"))).alias("best"),
        F.first(F.array(*[f"t{n}" for n in sides])).alias("total"),
    )
    return best.select("k", "node", "total", "best.feature", "best.bin", (-F.col("best.s")).alias("score")).collect()


def _plus(columns: list[Column]) -> Column:
    total = columns[0]
    for column in columns[1:]:
        total = total + column
    return total


def _node_of(bins: Column, tree: _Tree, depth: int) -> Column:
    if not depth:
        return F.lit(0)
    feature, at, left = _table(tree.feature, "int"), _table(tree.bin, "int"), _table(tree.left, "int")

    def step(node: Column, _: Column) -> Column:
        return F.when(left[node] < 0, node).otherwise(left[node] + (bins[feature[node]] > at[node]).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def _voter(member: TreeMember, tree: _Tree, edges: list[np.ndarray]) -> TreeVoter:
    for node, left in enumerate(tree.left):  # children of a node have rows, as its split left some on either side
        assert tree.counts[node] is not None, (node, left)
    counts = np.array(tree.counts)
    shares = counts / counts.sum(axis=1, keepdims=True)
    depth = max(name.bit_length() for name in tree.name) - 1
    threshold = [float(edges[f][b]) for f, b in zip(tree.feature, tree.bin, strict=True)]
    return TreeVoter(
        tuple(tree.feature), tuple(threshold), tuple(tree.left), tuple(map(tuple, shares.T.tolist())),
        depth, member.n_classes, member.feature_col, member.soft,
    )
