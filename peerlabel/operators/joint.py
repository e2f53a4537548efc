"""Training all members of a kind in the same passes over the data.

A pass reads the rows once, whichever number of members is still running: logistic members
get their loss and gradient from it, each at its own point, and all are moved on the driver by
a quasi-Newton step of their own. What returns from a pass is K blocks of C x m numbers from
each of a few groups of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


GROUPS = 64  # of tasks whose sums are added before they go to the driver
MEMORY = 10  # steps that the quasi-Newton direction remembers
ROWS_AT_ONCE = 4096
SUFFICIENT, CURVATURE = 1e-4, 0.9


# -- sums over all rows -------------------------------------------------------


def summed(rows: DataFrame, feature_col: str, n_members: int, make: Callable, width: int) -> np.ndarray:
    """The sum of ``make(features, label, weights)`` over batches of rows, ``width`` numbers.

    ``rows`` has the features, ``label`` and ``weights ARRAY<DOUBLE>``, one for each member.
    Sums of tasks are added in groups of tasks before the driver gets ``GROUPS`` of them at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                x, y, w = (c.slice(at, ROWS_AT_ONCE) for c in batch.columns)
                total += make(dense(x), y.to_numpy(zero_copy_only=False), dense(w, n_members))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for part in batch.column("total"):
                total += np.frombuffer(part.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    narrowed = rows.select(as_array(rows, feature_col).alias("x"), "label", "weights")
    parts = narrowed.mapInArrow(run, "total binary")
    task = F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("task")
    grouped = parts.select("total", task).repartition("task").mapInArrow(add, "total binary")
    found = [np.frombuffer(row.total) for row in grouped.collect()]
    return np.sum(found, axis=0) if found else np.zeros(width)


def as_array(rows: DataFrame, feature_col: str) -> Column:
    vector = isinstance(rows.schema[feature_col].dataType, VectorUDT)
    return vector_to_array(F.col(feature_col)) if vector else F.col(feature_col).cast("array<double>")


def dense(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    if not len(column):
        return np.zeros((0, width or 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def n_features_of(rows: DataFrame, feature_col: str) -> int:
    first = rows.select(F.size(as_array(rows, feature_col)).alias("m")).head()
    if first is None:
        raise ValueError("no training rows")
    return first.m


# -- logistic members ---------------------------------------------------------


@dataclass(frozen=True)
class LinearVoter:
    """A linear classifier: ``coefficients`` (classes x features) and ``intercepts``."""

    coefficients: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]
    n_classes: int
    feature_col: str = "features"
    soft: bool = False

    @property
    def hard(self) -> bool:
        return not self.soft

    def vote(self, rows: DataFrame, out_col: str) -> DataFrame:
        return rows.withColumn(out_col, linear_votes(rows, [self]))


def linear_votes(rows: DataFrame, voters: Sequence[LinearVoter]) -> Column:
    """The votes of several linear members, one after the other, as one array of doubles.

    Their coefficients are stacked to one matrix, which is applied once to a batch of rows.
    """
    sizes = [v.n_classes for v in voters]
    matrix = np.concatenate([np.array(v.coefficients) for v in voters])
    shift = np.concatenate([np.array(v.intercepts) for v in voters])
    soft = [v.soft for v in voters]

    @F.arrow_udf("array<double>")
    def score(features: pa.Array) -> pa.Array:
        margins = dense(features, matrix.shape[1]) @ matrix.T + shift
        at = 0
        for size, shares in zip(sizes, soft, strict=True):
            own = margins[:, at : at + size]
            margins[:, at : at + size] = _softmax(own) if shares else own.argmax(axis=1)[:, None] == np.arange(size)
            at += size
        offsets = np.arange(len(features) + 1, dtype=np.int32) * margins.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(margins.ravel()))

    return score(as_array(rows, voters[0].feature_col))


def _softmax(margins: np.ndarray) -> np.ndarray:
    powers = np.exp(margins - margins.max(axis=1, keepdims=True, initial=-np.inf))
    return powers / powers.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class LinearMember:
    """A multinomial logistic regression that is trained together with others.

    The loss is the weighted mean of the log loss plus ``reg_param`` / 2 times the squared
    coefficients of features scaled to unit deviation in the member's own bag; intercepts are free.
    """

    n_classes: int
    feature_col: str = "features"
    reg_param: float = 0.0
    fit_intercept: bool = False
    max_iter: int = 100
    tol: float = 1e-6
    soft: bool = False

    def fit(self, rows: DataFrame) -> LinearVoter:
        weights = F.array(F.col("weight").cast("double"))
        return fit_linear([self], rows.select(self.feature_col, "label", weights.alias("weights")))[0]

    @staticmethod
    def fit_jointly(members: Sequence[LinearMember], ks: Sequence[int], rows: DataFrame) -> dict[int, LinearVoter]:
        """Train ``members[k]`` for ``ks`` on rows with ``weights``, one for each of ``ks``."""
        voters = fit_linear([members[k] for k in ks], rows)
        return dict(zip(ks, voters, strict=True))


@dataclass
class _Search:
    """One member's way to its minimum: the point it is at, and the one it asks for next."""

    point: np.ndarray
    tol: float
    most: int
    value: float = np.inf
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    asked: np.ndarray | None = None
    low: float = 0.0
    high: float = np.inf
    step: float = 1.0
    tries: int = 0
    iterations: int = 0
    done: bool = False
    past: list = field(default_factory=list)

    def __post_init__(self):
        self.asked = self.point

    def tell(self, value: float, gradient: np.ndarray) -> None:
        """Loss and gradient at ``asked``; chooses the next point, or ends."""
        if self.gradient is None:
            self._accept(self.asked, value, gradient)
            return
        slope = self.direction @ self.gradient
        self.tries += 1
        if not np.isfinite(value) or value > self.value + SUFFICIENT * self.step * slope:
            self.high = self.step
        elif self.direction @ gradient < CURVATURE * slope:
            self.low = self.step
        else:
            return self._accept(self.asked, value, gradient)
        if self.tries >= 30:
            if value < self.value:
                return self._accept(self.asked, value, gradient)
            self.done = True  # no point on the line is better: rounding has the last word
            return None
        self.step = (self.low + self.high) / 2 if np.isfinite(self.high) else 2 * self.step
        self.asked = self.point + self.step * self.direction

    def _accept(self, point: np.ndarray, value: float, gradient: np.ndarray) -> None:
        fell = self.value - value
        if self.gradient is not None:
            s, y = point - self.point, gradient - self.gradient
            if s @ y > 1e-10 * np.sqrt((s @ s) * (y @ y)):
                self.past = [*self.past, (s, y)][-MEMORY:]
            self.iterations += 1
        scale = max(abs(value), abs(self.value) if np.isfinite(self.value) else 0.0, 1e-12)
        settled = np.isfinite(fell) and fell <= self.tol * scale
        self.point, self.value, self.gradient = point, value, gradient
        small = np.linalg.norm(gradient) <= self.tol * max(np.linalg.norm(point), 1.0) * 1e-2
        if settled or small or self.iterations >= self.most:
            self.done = True
            return
        self.direction = -self._curved(gradient)
        if self.direction @ gradient >= 0:
            self.direction, self.past = -gradient, []
        self.low, self.high, self.tries = 0.0, np.inf, 0
        self.step = 1.0 if self.past else min(1.0, 1.0 / max(np.linalg.norm(gradient), 1e-12))
        self.asked = self.point + self.step * self.direction

    def _curved(self, gradient: np.ndarray) -> np.ndarray:
        """The gradient times the inverse curvature that the last steps showed."""
        g, kept = gradient.copy(), []
        for s, y in reversed(self.past):
            a = (s @ g) / (s @ y)
            g -= a * y
            kept.append((a, s, y))
        if self.past:
            s, y = self.past[-1]
            g *= (s @ y) / (y @ y)
        for a, s, y in reversed(kept):
            g += (a - (y @ g) / (s @ y)) * s
        return g


def fit_linear(members: Sequence[LinearMember], rows: DataFrame, passes: list | None = None) -> list[LinearVoter]:
    """Train all ``members`` on ``rows`` with ``weights`` (one for each); appends the number of
    members to ``passes`` at each pass over the rows. Rows are read often: cache them."""
    feature_col, n_classes = members[0].feature_col, members[0].n_classes
    if any((m.feature_col, m.n_classes) != (feature_col, n_classes) for m in members):
        raise ValueError("members trained jointly must share features and classes")
    k, m = len(members), n_features_of(rows, feature_col)

    def moments(x, y, w):
        return np.concatenate([w.sum(axis=0), (w**2).sum(axis=0), (w.T @ x).ravel(), (w.T @ x**2).ravel()])

    told = summed(rows, feature_col, k, moments, 2 * k + 2 * k * m)
    sums, squares = told[:k], told[k : 2 * k]
    if (sums <= 0).any():
        raise ValueError("no training rows")
    mean, second = told[2 * k :].reshape(2, k, m) / sums[:, None]
    spread = sums - squares / sums  # of a variance without bias
    variance = np.maximum(second - mean**2, 0.0) * sums[:, None] / np.where(spread > 0, spread, 1.0)[:, None]
    deviation = np.sqrt(np.where(spread[:, None] > 0, variance, 0.0))
    scale = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)

    size = n_classes * (m + 1)
    searches = [_Search(np.zeros(size), x.tol, x.max_iter) for x in members]
    reg = np.array([x.reg_param for x in members])
    free = np.array([x.fit_intercept for x in members])
    while running := [i for i, s in enumerate(searches) if not s.done]:
        if passes is not None:
            passes.append(len(running))
        points = np.stack([searches[i].asked for i in running]).reshape(len(running), n_classes, m + 1)
        matrix = points[:, :, :m] * scale[running][:, None, :]
        values = summed(rows, feature_col, k, _losses(matrix, points[:, :, m] * free[running][:, None], running), len(running) * (1 + size))
        values = values.reshape(len(running), 1 + size)
        for row, i in enumerate(running):
            gradient = values[row, 1:].reshape(n_classes, m + 1) / sums[i]
            gradient[:, :m] = gradient[:, :m] * scale[i] + reg[i] * points[row, :, :m]
            gradient[:, m] *= free[i]
            loss = values[row, 0] / sums[i] + reg[i] / 2 * (points[row, :, :m] ** 2).sum()
            searches[i].tell(loss, gradient.ravel())
    return [_voter(x, s.point.reshape(n_classes, m + 1), scale[i]) for i, (x, s) in enumerate(zip(members, searches, strict=True))]


def _losses(matrix: np.ndarray, shift: np.ndarray, running: list[int]) -> Callable:
    """Loss and gradient of the running members at their points, over a batch."""
    k, n_classes, m = matrix.shape

    def make(x, y, w):
        weights = w[:, running]
        margins = (x @ matrix.reshape(-1, m).T).reshape(len(x), k, n_classes) + shift
        margins -= margins.max(axis=2, keepdims=True, initial=-np.inf)
        powers = np.exp(margins)
        totals = powers.sum(axis=2)
        own = np.take_along_axis(margins, y.astype(int)[:, None, None].repeat(k, axis=1), axis=2)[:, :, 0]
        losses = (weights * (np.log(totals) - own)).sum(axis=0)
        pull = powers / totals[:, :, None]
        pull[np.arange(len(x)), :, y.astype(int)] -= 1.0
        pull *= weights[:, :, None]
        slopes = (pull.reshape(len(x), -1).T @ x).reshape(k, n_classes, m)
        gradient = np.concatenate([slopes, pull.sum(axis=0)[:, :, None]], axis=2)
        return np.concatenate([losses[:, None], gradient.reshape(k, -1)], axis=1).ravel()

    return make


def _voter(member: LinearMember, point: np.ndarray, scale: np.ndarray) -> LinearVoter:
    """The solution in the features' own units. Of the many that score alike (with every class moved
    by the same), that with mean zero over the classes: intercepts always, coefficients if
    nothing holds them."""
    coefficients, intercepts = point[:, :-1] * scale, point[:, -1] if member.fit_intercept else np.zeros(len(point))
    intercepts = intercepts - intercepts.mean()
    if member.reg_param == 0:
        coefficients = coefficients - coefficients.mean(axis=0)
    return LinearVoter(
        tuple(tuple(map(float, row)) for row in coefficients), tuple(map(float, intercepts)), member.n_classes, member.feature_col, member.soft
    )


def linear_members(n_members: int, n_classes: int, **options) -> list[LinearMember]:
    """Logistic regressions that are trained together and scored in one step."""
    return [LinearMember(n_classes, **options) for _ in range(n_members)]
