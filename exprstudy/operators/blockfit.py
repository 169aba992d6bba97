"""Linear models of many experiments in one optimiser.

A problem is one penalised linear model: a held-out fold, the preprocessing of the
genes it may use, a loss and its penalties.  Every problem runs its own L-BFGS (or
its orthant-wise form, where there is an L1 penalty) as a generator on the driver
that asks for a loss and gradient at one point.  The points of all running problems
are answered by one ``treeAggregate`` over the rows, so an iteration of folds x
budgets x models reads the matrix once.  Rows of a problem's own fold add nothing
to it.

Rows are logged once and written as blocks of a bounded size; what is cached is
that table, whatever the number of problems.  Scaling and imputing are folded into
the coefficients, so no problem has a copy of the rows.

Objectives (weights balanced over the training rows, n their number):

* ``logistic``: mean weighted log loss, softmax over classes or one column for two
  classes, plus ``((1 - r) / 2 |W|^2 + r |W|_1) / (C n)``; intercepts are free.
* ``squared_hinge``: per class against the rest, mean squared hinge plus
  ``|w, b|^2 / (2 C n)``; rows of the class have its weight, the rest one.
"""

from __future__ import annotations

from collections.abc import Generator, Sequence
from dataclasses import dataclass

import math

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprstudy.functions.transforms import log2p1
from exprstudy.session import durable

BLOCK_BYTES = 2 << 20
PARTITION_BYTES = 64 << 20
LEAST_BYTES = 4 << 20  # cells that are worth a task of their own
DRIVER_BYTES = 64 << 20  # sums of all tasks that the driver adds up without a round between
MEMORY = 10  # curvature pairs of a problem
TOLERANCE = 1e-6


@dataclass(frozen=True)
class Problem:
    """One model to fit; ``genes`` with their ``median``, ``center`` and ``scale`` are in gene order."""

    fold: int
    genes: np.ndarray
    median: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    class_counts: Sequence[int]
    loss: str = "logistic"
    C: float = 1.0
    l1_ratio: float = 0.0
    max_iter: int = 2_000

    @property
    def columns(self) -> int:
        return 1 if len(self.class_counts) == 2 else len(self.class_counts)

    @property
    def size(self) -> int:
        return self.columns * (len(self.genes) + 1)

    def class_weights(self) -> np.ndarray:
        counts = np.asarray(self.class_counts, float)
        present = counts > 0
        return np.where(present, counts.sum() / (max(1, present.sum()) * np.maximum(counts, 1)), 0.0)

    def penalties(self) -> tuple[np.ndarray, np.ndarray]:
        """L2 and L1 strengths per parameter; the last one of every column is its intercept."""
        strength = np.full((self.columns, len(self.genes) + 1), 1.0 / (self.C * sum(self.class_counts)))
        if self.loss == "logistic":
            strength[:, -1] = 0.0
        return ((1 - self.l1_ratio) * strength).ravel(), (self.l1_ratio * strength).ravel()


@dataclass(frozen=True)
class Fitted:
    """``weights`` (columns x genes) and ``intercepts`` on scaled features, and how the optimiser ended."""

    weights: np.ndarray
    intercepts: np.ndarray
    iterations: int
    gradient: float
    converged: bool


def write_blocks(rows: DataFrame, negative_policy: str) -> DataFrame:
    """Labelled rows (``fold``, ``label``, ``features``) on the log scale, as dense blocks of bounded size."""
    logged = F.transform("features", lambda v: F.coalesce(log2p1(v, negative_policy).cast("double"), F.lit(float("nan"))))
    flat = rows.select(F.col("fold").cast("int"), F.col("label").cast("int"), logged.alias("x"))

    def pack(batches):
        for batch in batches:
            x = batch.column("x")
            offsets = x.offsets.to_numpy()
            width = offsets[1] - offsets[0] if len(x) else 0
            if len(x) and (np.diff(offsets) != width).any():
                raise ValueError("matrix rows differ in width")
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)
            step = max(1, BLOCK_BYTES // max(8, 8 * int(width)))
            for start in range(0, len(x), step):
                part = slice(start, start + step)
                n = len(values[part])
                names = [batch.column(c).to_numpy()[part].astype("<i4").tobytes() for c in ("fold", "label")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int32()), *[pa.array([b], pa.binary()) for b in names],
                     pa.array([np.ascontiguousarray(values[part], "<f8").tobytes()], pa.binary())],
                    names=["n", "folds", "labels", "x"],
                )

    return durable(flat.mapInArrow(pack, "n int, folds binary, labels binary, x binary"), "blocks")


def _load(row):
    folds, labels = (np.frombuffer(b, "<i4") for b in (row.folds, row.labels))
    x = np.frombuffer(row.x, "<f8").reshape(row.n, -1)
    missing = np.isnan(x)
    return folds, labels, np.where(missing, 0.0, x), missing if missing.any() else None


def load_blocks(blocks: DataFrame) -> RDD:
    """The blocks as arrays, cached and dealt evenly.

    All cores take part in a step, but small tables get few partitions, so that it is a short job.
    """
    total = blocks.agg(F.sum(F.length("x"))).first()[0] or 0
    busy = min(blocks.sparkSession.sparkContext.defaultParallelism, math.ceil(total / LEAST_BYTES))
    rows = blocks.repartition(max(1, busy, math.ceil(total / PARTITION_BYTES))).rdd
    return rows.map(_load).persist(StorageLevel.MEMORY_AND_DISK)


def _residuals(problem: Problem, labels: np.ndarray, seen: np.ndarray, logits: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted loss of the training rows and its derivative by the logits."""
    weights = problem.class_weights()
    own = weights[labels] * seen
    classes = len(weights)
    if problem.loss == "squared_hinge":
        positive = labels[:, None] == (np.arange(classes) if problem.columns > 1 else 1)
        sign = np.where(positive, 1.0, -1.0)
        # two classes keep the weights of both; several weigh the class against unweighted others
        cost = own[:, None] if problem.columns == 1 else np.where(positive, own[:, None], seen[:, None] * 1.0)
        gap = np.maximum(0.0, 1.0 - sign * logits)
        return float((cost * gap * gap).sum()), -2.0 * cost * sign * gap
    if problem.columns == 1:
        z, y = logits[:, 0], labels.astype(float)
        loss = np.logaddexp(0.0, z) - y * z
        chance = np.exp(-np.logaddexp(0.0, -z))
        return float(own @ loss), (own * (chance - y))[:, None]
    top = logits.max(1, keepdims=True)
    raised = np.exp(logits - top)
    total = raised.sum(1, keepdims=True)
    loss = np.log(total[:, 0]) + top[:, 0] - logits[np.arange(len(labels)), labels]
    chance = raised / total
    chance[np.arange(len(labels)), labels] -= 1.0
    return float(own @ loss), own[:, None] * chance


def block_gradient(problem: Problem, point: np.ndarray, block) -> np.ndarray:
    """Loss, then gradient, of one block's rows outside the problem's fold (a sum, without penalties)."""
    folds, labels, x, missing = block
    table = point.reshape(problem.columns, -1)
    raw = table[:, :-1] / problem.scale
    shift = table[:, -1] - raw @ problem.center
    whole = len(problem.genes) == x.shape[1]
    picked = x if whole else x[:, problem.genes]
    logits = picked @ raw.T + shift
    holes = None
    if missing is not None:
        holes = (missing if whole else missing[:, problem.genes]).astype(float)
        logits += holes @ (raw * problem.median).T
    loss, residual = _residuals(problem, labels, folds != problem.fold, logits)
    gradient = residual.T @ picked
    if holes is not None:
        gradient += (residual.T @ holes) * problem.median
    total = residual.sum(0)
    scaled = (gradient - total[:, None] * problem.center) / problem.scale
    return np.concatenate([[loss], np.hstack([scaled, total[:, None]]).ravel()])


def pseudo_gradient(point: np.ndarray, gradient: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """The steepest one-sided derivative of the penalised loss; zero exactly at its minimum."""
    right, left = gradient + l1, gradient - l1
    at_zero = np.where(right < 0, right, np.where(left > 0, left, 0.0))
    return np.where(point > 0, right, np.where(point < 0, left, at_zero))


def _direction(steepest: np.ndarray, pairs: list) -> np.ndarray:
    q, kept = steepest.copy(), []
    for s, y, rho in reversed(pairs):
        a = rho * (s @ q)
        q -= a * y
        kept.append(a)
    if pairs:
        s, y, _ = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y, rho), a in zip(pairs, reversed(kept)):
        q += s * (a - rho * (y @ q))
    return -q


def minimiser(size: int, l1: np.ndarray, max_iter: int, tolerance: float) -> Generator:
    """Yields points, is sent (smooth value, gradient), returns (point, iterations, residual, converged)."""
    point = np.zeros(size)
    value, gradient = yield point
    pairs: list = []
    orthants = bool((l1 > 0).any())
    steps = 0
    while True:
        steepest = pseudo_gradient(point, gradient, l1)
        residual = float(np.abs(steepest).max(initial=0.0))
        if residual <= tolerance or steps >= max_iter:
            return point, steps, residual, residual <= tolerance
        way = _direction(steepest, pairs)
        if orthants:
            way = np.where((l1 > 0) & (way * steepest >= 0), 0.0, way)
        if way @ steepest >= 0:
            way, pairs = -steepest, []
        side = np.where(point != 0, np.sign(point), -np.sign(steepest))
        height = value + l1 @ np.abs(point)
        step = 1.0 if pairs else min(1.0, 1.0 / np.abs(steepest).sum())
        for _ in range(40):
            tried = point + step * way
            if orthants:
                tried = np.where((l1 > 0) & (np.sign(tried) != side), 0.0, tried)
            new_value, new_gradient = yield tried
            drop = 1e-4 * (steepest @ (tried - point))
            if new_value + l1 @ np.abs(tried) <= height + drop + 1e-14 * max(1.0, abs(height)):
                break
            step /= 2
        else:
            if not pairs:
                return point, steps, residual, False
            pairs = []
            continue
        s, y = tried - point, new_gradient - gradient
        if s @ y > 1e-14 * (y @ y):
            pairs = [*pairs[-(MEMORY - 1):], (s, y, 1.0 / (s @ y))]
        point, value, gradient = tried, new_value, new_gradient
        steps += 1


def fit_all(blocks: DataFrame, problems: Sequence[Problem], tolerance: float = TOLERANCE) -> list[Fitted]:
    """Fit all problems together; one aggregate over the cached blocks answers every running problem.

    A problem ends when no one-sided derivative of its mean loss with penalties exceeds
    ``tolerance``, or after its ``max_iter``.  Parameters and sums are as large as the
    models, which bounds what is broadcast and what comes back.
    """
    context = blocks.sparkSession.sparkContext
    data = load_blocks(blocks)
    fixed = context.broadcast(list(problems))
    penalties = [p.penalties() for p in problems]
    runs = [minimiser(p.size, l1, p.max_iter, tolerance) for p, (_, l1) in zip(problems, penalties)]
    points = {i: next(run) for i, run in enumerate(runs)}
    ended: dict[int, tuple] = {}
    try:
        while points:
            asked = context.broadcast(points)
            width = sum(1 + problems[i].size for i in points)

            def add(total, block, asked=asked):
                parts = [block_gradient(fixed.value[i], point, block) for i, point in asked.value.items()]
                sums = np.concatenate(parts)
                return sums if total is None else total + sums

            depth = 1 if 8 * width * data.getNumPartitions() <= DRIVER_BYTES else 2
            answer = data.treeAggregate(None, add, lambda a, b: b if a is None else a if b is None else a + b, depth)
            answer = np.zeros(width) if answer is None else answer
            asked.destroy()
            following, at = {}, 0
            for i, point in points.items():
                problem, n = problems[i], max(1, sum(problems[i].class_counts))
                sums = answer[at : at + 1 + problem.size] / n
                at += 1 + problem.size
                l2 = penalties[i][0]
                try:
                    following[i] = runs[i].send((sums[0] + 0.5 * l2 @ (point * point), sums[1:] + l2 * point))
                except StopIteration as end:
                    ended[i] = end.value
            points = following
    finally:
        data.unpersist()
        fixed.destroy()
    found = []
    for i, problem in enumerate(problems):
        point, steps, residual, converged = ended[i]
        table = point.reshape(problem.columns, -1)
        found.append(Fitted(table[:, :-1], table[:, -1], steps, residual, converged))
    return found
