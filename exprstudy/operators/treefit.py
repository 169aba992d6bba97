"""Softmax gradient boosting for the models of all folds at once.

Trees grow level by level on sums of first and second derivatives of the weighted log
loss.  Experiments whose rows fit in a task (``WHOLE_BYTES``) are one task each, which runs
all rounds on bins held feature by feature: the sums of a level are found from the rows of
the smaller child of each split, those of its sibling are what the parent has besides.
For larger ones a level is a job, and one pass over the rows serves the level of all
classes and all experiments:

* every task adds the derivatives of its rows up by (node, feature, bin) for one
  (experiment, class, block of features) at a time, so it holds one such table;
* the tables are shuffled by that key and added up one after the other; the best split
  of each node in a feature block is found where the sums lie;
* the driver receives one split for each (experiment, class, node, feature block) and
  keeps the best, ties to the smaller feature, then the smaller cut.

Rows are written once as blocks of bin numbers (a byte a cell for up to 256 bins); cuts
are quantiles of the training rows of each experiment, found by Spark's own aggregate.
Rows of a tree are drawn by a hash of the row key and features by the seed, so a lost
task finds the same again.  Margins travel with the cached blocks and are rebuilt from
the written blocks and the trees every ``REBASE`` rounds, which bounds the lineage.

For a node with sums ``G`` and ``H``, ``t(G)`` being ``G`` moved towards zero by
``reg_alpha``: its value is ``-learning_rate * t(G) / (H + reg_lambda)``, its score
``t(G)^2 / (H + reg_lambda)``, and the gain of a split is what the scores of both sides
exceed the score of the node by.  A split needs ``min_child_weight`` on both sides and a
gain above ``gamma``.  Two classes take one tree a round, more take one for each class.

With ``exact`` every value of a feature is a cut.  Bins then bound the search: the derivatives
of a bin limit the gain of any cut inside it, and where that limit reaches the best gain between
bins, the rows of the bin are dealt out by bin, sorted and tried one value after the other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import math

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprstudy.constants import BOOSTED_DEFAULTS, DEFAULT_SEED
from exprstudy.session import durable

BLOCK_BYTES = 4 << 20
PARTITION_BYTES = 32 << 20
WRITTEN_ROWS = 1_024  # rows of a written block; a task that reads several of an experiment joins them
FEATURE_BLOCK = 64
REBASE = 25  # rounds between two rebuilds of the margins
TIE = 1e-9
SKETCH = 10  # accuracy of a quantile, in parts of a bin
SEARCH_ROWS = 1 << 20  # cells that a task sorts in the search of bins
WHOLE_BYTES = 320 << 20  # of arrays for the rows and sums of an experiment, up to which one task grows all its trees
KEPT_BYTES = 31 << 20
TABLE_ROUNDS = 25  # rounds of trees in a batch of the table
CUT_CELLS = 1 << 17  # cuts tried at a time
SUM_CELLS = 1 << 15  # cells added up at a time
TREES_SCHEMA = "eval_fold int, round int, tree int, features array<int>, cuts array<double>, scores array<double>, gains array<double>"


@dataclass(frozen=True)
class Settings:
    n_estimators: int = BOOSTED_DEFAULTS["n_estimators"]
    max_depth: int = BOOSTED_DEFAULTS["max_depth"]
    learning_rate: float = BOOSTED_DEFAULTS["learning_rate"]
    subsample: float = BOOSTED_DEFAULTS["subsample"]
    colsample_bytree: float = BOOSTED_DEFAULTS["colsample_bytree"]
    min_child_weight: float = BOOSTED_DEFAULTS["min_child_weight"]
    reg_alpha: float = BOOSTED_DEFAULTS["reg_alpha"]
    reg_lambda: float = BOOSTED_DEFAULTS["reg_lambda"]
    gamma: float = BOOSTED_DEFAULTS["gamma"]
    max_bin: int = BOOSTED_DEFAULTS["max_bin"]
    seed: int = DEFAULT_SEED
    exact: bool = False

    def __post_init__(self):
        if self.n_estimators < 1 or self.max_depth < 1 or self.max_bin < 2:
            raise ValueError("trees need a round, a level and two bins at least")
        if not (0 < self.subsample <= 1 and 0 < self.colsample_bytree <= 1):
            raise ValueError("row and feature shares of a tree lie in (0, 1]")
        if min(self.min_child_weight, self.reg_alpha, self.reg_lambda, self.gamma) < 0:
            raise ValueError("penalties of trees must not be negative")

    @property
    def nodes(self) -> int:
        return 2 ** (self.max_depth + 1) - 1


@dataclass
class Tree:
    """Nodes in heap order; ``features`` is -1 for leaves, and a row with a bin (``exact``: a value) up to ``bins`` goes left."""

    features: np.ndarray
    bins: np.ndarray
    scores: np.ndarray
    gains: np.ndarray

    @classmethod
    def empty(cls, nodes: int, exact: bool = False) -> Tree:
        return cls(np.full(nodes, -1, np.int32), np.zeros(nodes, float if exact else np.int32), np.zeros(nodes), np.zeros(nodes))


@dataclass
class Block:
    """Training rows of one experiment with their margins so far; ``values`` only for exact cuts."""

    experiment: int
    keys: np.ndarray
    labels: np.ndarray
    bins: np.ndarray
    margins: np.ndarray = field(default=None)
    values: np.ndarray = field(default=None)

    @property
    def cells(self) -> np.ndarray:
        """What the cuts of trees are compared with."""
        return self.bins if self.values is None else self.values


def find_cuts(design: DataFrame, max_bin: int) -> dict[int, list[np.ndarray]]:
    """Ascending cuts of each experiment and feature from its training rows; as large as a model."""
    shares = [i / max_bin for i in range(1, max_bin)]
    cells = design.where("fold <> eval_fold").select("eval_fold", F.posexplode("x").alias("position", "v"))
    found = cells.groupBy("eval_fold", "position").agg(
        F.array_distinct(F.percentile_approx("v", shares, SKETCH * max_bin)).alias("cuts")
    )
    cuts: dict[int, dict] = {}
    for row in found.collect():
        cuts.setdefault(row["eval_fold"], {})[row["position"]] = np.asarray(row["cuts"], float)
    return {e: [by_place[i] for i in range(len(by_place))] for e, by_place in cuts.items()}


def bin_rows(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin ``b`` holds values above cut ``b - 1`` and up to cut ``b``."""
    kind = np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16
    found = np.empty(x.shape, kind)
    for i, cut in enumerate(cuts):
        found[:, i] = np.searchsorted(cut, x[:, i], side="left")
    return found


def write_bins(design: DataFrame, cuts: dict[int, list[np.ndarray]], exact: bool = False) -> DataFrame:
    """Training rows (``eval_fold``, ``fold``, ``cache_index``, ``label``, ``x``) as blocks of bin numbers, ``exact`` with their values."""
    shared = design.sparkSession.sparkContext.broadcast(cuts)
    names = ["eval_fold", "n", "wide", "keys", "labels", "bins", "cells"]

    def emit(experiment, parts):
        keys, labels, bins, x = (np.concatenate(c) for c in zip(*parts))
        columns = [pa.array([experiment], pa.int32()), pa.array([len(keys)], pa.int32()), pa.array([bins.dtype.itemsize], pa.int32())]
        stored = [keys.astype("<i8"), labels.astype("<i4"), np.ascontiguousarray(bins), x.astype("<f8")]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array([s.tobytes()], pa.binary()) for s in stored]], names=names)

    def pack(batches: Iterator[pa.RecordBatch]):
        held: dict[int, list] = {}
        size: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            experiments, keys, labels = (batch.column(c).to_numpy() for c in ("eval_fold", "cache_index", "label"))
            lists = batch.column("x")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for e in np.unique(experiments).tolist():
                own = np.flatnonzero(experiments == e)
                width = len(shared.value[e])
                step = min(WRITTEN_ROWS, max(1, BLOCK_BYTES // max(1, 8 * width)))
                for at in range(0, len(own), step):
                    part = own[at : at + step]
                    x = flat[offsets[part][:, None] + np.arange(width)]
                    bins = bin_rows(x, shared.value[e])
                    kept = x if exact else x[:, :0]
                    held.setdefault(e, []).append((keys[part], labels[part], bins, kept))
                    size[e] = size.get(e, 0) + bins.nbytes + kept.nbytes
                    if size[e] >= BLOCK_BYTES or sum(len(p[0]) for p in held[e]) >= WRITTEN_ROWS:
                        yield emit(e, held.pop(e))
                        size[e] = 0
        for e, parts in held.items():
            yield emit(e, parts)

    rows = design.where("fold <> eval_fold").select("eval_fold", F.col("cache_index").cast("bigint"), F.col("label").cast("int"), "x")
    return durable(rows.mapInArrow(pack, "eval_fold int, n int, wide int, keys binary, labels binary, bins binary, cells binary"), "bins")


def _load(row) -> Block:
    kind = np.uint8 if row.wide == 1 else np.uint16
    values = np.frombuffer(row.cells, "<f8").reshape(row.n, -1) if row.cells else None
    return Block(row.eval_fold, np.frombuffer(row.keys, "<i8"), np.frombuffer(row.labels, "<i4"), np.frombuffer(row.bins, kind).reshape(row.n, -1), values=values)


def _joined(parts: list[Block]) -> Block:
    whole = {name: np.concatenate([getattr(b, name) for b in parts]) for name in ("keys", "labels", "bins")}
    return Block(parts[0].experiment, **whole, values=None if parts[0].values is None else np.concatenate([b.values for b in parts]))


def load_bins(blocks: DataFrame, experiments: int) -> RDD:
    """Blocks as arrays, those of an experiment side by side, in partitions for every core at least."""
    total = blocks.agg(F.sum(F.length("bins") + F.length("cells"))).first()[0] or 0
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    wanted = max(experiments, cores, math.ceil(total / PARTITION_BYTES))

    def load_all(rows):
        held: dict[int, list[Block]] = {}
        for row in rows:
            own = held.setdefault(row.eval_fold, [])
            own.append(_load(row))
            if sum(b.cells.nbytes for b in own) >= BLOCK_BYTES:
                yield _joined(held.pop(row.eval_fold))
        yield from map(_joined, held.values())

    spread = blocks.withColumn("spread", F.xxhash64("keys"))
    return spread.repartitionByRange(wanted, "eval_fold", "spread").rdd.mapPartitions(load_all)


def drawn(keys: np.ndarray, share: float, *salt: int) -> np.ndarray:
    """Which rows a tree sees: a hash of their key below the share, whatever block they lie in."""
    if share >= 1:
        return np.ones(len(keys), bool)
    start = np.random.SeedSequence([abs(s) for s in salt]).generate_state(1, np.uint64)[0]
    z = keys.astype(np.uint64) + start
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) / 2.0**53 < share


def features_of(settings: Settings, width: int, experiment: int, round_: int, tree: int) -> np.ndarray:
    """The features a tree may split on, ascending."""
    n = max(1, int(settings.colsample_bytree * width))
    rng = np.random.default_rng([settings.seed, experiment, round_, tree])
    return np.sort(rng.choice(width, n, replace=False))


def leaf_of(tree: Tree, cells: np.ndarray) -> np.ndarray:
    """The node each row ends in; rows stop at nodes without a feature."""
    at = np.zeros(len(cells), np.int64)
    rows = np.arange(len(cells))
    while True:
        feature = tree.features[at[rows]]
        rows = rows[feature >= 0]
        if not len(rows):
            return at
        here = at[rows]
        at[rows] = 2 * here + 1 + (cells[rows, tree.features[here]] > tree.bins[here])


def margins_of(rounds: Sequence[Sequence[Tree]], cells: np.ndarray, columns: int) -> np.ndarray:
    total = np.zeros((len(cells), columns))
    for trees in rounds:
        for c, tree in enumerate(trees):
            total[:, c] += tree.scores[leaf_of(tree, cells)]
    return total


def derivatives(labels: np.ndarray, margins: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted log loss for each row and tree of a round.

    With several classes the second is twice the diagonal one, which bounds the whole matrix.
    """
    own = weights[labels][:, None]
    if margins.shape[1] == 1:
        chance = 1.0 / (1.0 + np.exp(-margins))
        return own * (chance - labels[:, None]), np.maximum(own * chance * (1 - chance), 1e-16)
    raised = np.exp(margins - margins.max(1, keepdims=True))
    chance = raised / raised.sum(1, keepdims=True)
    second = np.maximum(2 * own * chance * (1 - chance), 1e-16)
    chance[np.arange(len(labels)), labels] -= 1.0
    return own * chance, second


def _score(g: np.ndarray, h: np.ndarray, settings: Settings) -> np.ndarray:
    moved = np.maximum(np.abs(g) - settings.reg_alpha, 0.0)
    bottom = h + settings.reg_lambda
    return np.divide(moved * moved, bottom, out=np.zeros_like(moved), where=bottom > 0)


def _gains(g, h, whole_g, whole_h, settings: Settings) -> np.ndarray:
    """What a cut with ``g`` and ``h`` to its left gains; minus infinity where it is not allowed."""
    right_h = whole_h - h
    gain = _score(g, h, settings) + _score(whole_g - g, right_h, settings) - _score(whole_g, whole_h, settings)
    least = max(settings.min_child_weight, 1e-12)
    return np.where((h >= least) & (right_h >= least) & (gain > max(settings.gamma, 1e-9)), gain, -np.inf)


def best_splits(sums: np.ndarray, settings: Settings) -> list[tuple]:
    """``(gain, feature, bin, G, H, G left, H left)`` of each node from sums by (node, feature, bin, 2); feature -1 if none."""
    running = sums.cumsum(2)
    g, h = running[..., 0], running[..., 1]
    whole_g, whole_h = g[:, :1, -1:], h[:, :1, -1:]
    gain = _gains(g, h, whole_g, whole_h, settings).reshape(len(sums), -1)
    # sums of another order may differ in their last digits, so gains this close are ties
    top = gain.max(1, keepdims=True)
    at = (gain >= np.where(np.isfinite(top), top - TIE * np.abs(top), top)).argmax(1)
    found = []
    for node, place in enumerate(at.tolist()):
        feature, bin_ = divmod(place, sums.shape[2])
        none = not np.isfinite(gain[node, place])
        found.append(
            (float(gain[node, place]), -1 if none else feature, bin_, float(whole_g[node, 0, 0]), float(whole_h[node, 0, 0]),
             float(g[node, feature, bin_]), float(h[node, feature, bin_]))
        )
    return found


def worth_search(sums: np.ndarray, least_gain: np.ndarray, settings: Settings) -> np.ndarray:
    """Which bins may hold a cut that gains ``least_gain`` of its node, from sums by (node, feature, bin, 3).

    The third sum is that of the positive derivatives: what lies to the left of a cut inside a bin has
    between all negative and all positive ones of the bin, and at least what lies before the bin.
    """
    g, h, up = sums[..., 0], sums[..., 1], sums[..., 2]
    before_g, before_h = g.cumsum(2) - g, h.cumsum(2) - h
    whole_g, whole_h = g[:, :1].sum(2, keepdims=True), h[:, :1].sum(2, keepdims=True)
    after_h = whole_h - before_h - h
    least = max(settings.min_child_weight, 1e-12)
    ends = before_g + up, before_g + g - up
    left = np.maximum(*(_score(end, np.maximum(before_h, least), settings) for end in ends))
    right = np.maximum(*(_score(whole_g - end, np.maximum(after_h, least), settings) for end in ends))
    limit = left + right - _score(whole_g, whole_h, settings)
    slack = 1e-6 * (1 + left + right)
    return (h > 0) & (before_h + h >= least - slack) & (after_h + h >= least - slack) & (limit + slack >= least_gain[:, None, None])


def _value(g: float, h: float, settings: Settings) -> float:
    moved = math.copysign(max(abs(g) - settings.reg_alpha, 0.0), g)
    bottom = h + settings.reg_lambda
    return -settings.learning_rate * moved / bottom if bottom > 0 else 0.0


def _level_rows(blocks: list[Block], growing: dict, open_nodes: dict, chosen: dict, weights: dict, n_bins: int, span: int, settings: Settings, round_: int):
    """The open rows of one partition and the places of their cells among the sums, one (experiment, tree, feature block) at a time."""
    found = [derivatives(b.labels, b.margins, weights[b.experiment]) for b in blocks]
    for (e, c), nodes in open_nodes.items():
        place = np.full(settings.nodes, -1)
        place[nodes] = np.arange(len(nodes))
        own = []
        for block, (g, h) in zip(blocks, found):
            if block.experiment != e:
                continue
            node = place[leaf_of(growing[e, c], block.cells)]
            rows = np.flatnonzero((node >= 0) & drawn(block.keys, settings.subsample, settings.seed, e, round_, c))
            if len(rows):
                own.append((block, rows, node[rows], g[rows, c], h[rows, c]))
        if not own:
            continue
        features = chosen[e, c]
        for start in range(0, len(features), span):
            part = features[start : start + span]
            # one block after the other, since the places take eight bytes a cell
            placed = (
                (((node[:, None] * len(part) + np.arange(len(part))) * n_bins + block.bins[np.ix_(rows, part)]).ravel(), block, rows, g, h)
                for block, rows, node, g, h in own
            )
            yield (e, c, start), part, len(nodes) * len(part) * n_bins, placed


def _level_sums(rows_of_level: Iterator, exact: bool) -> Iterator:
    """Sparse sums of a partition's rows; ``exact`` with those of the positive first derivatives."""
    for key, part, cells, own in rows_of_level:
        sums = np.zeros((3 if exact else 2, cells))
        for flat, _, _, g, h in own:
            for i, of_row in enumerate((g, h, np.maximum(g, 0))[: len(sums)]):
                sums[i] += np.bincount(flat, np.repeat(of_row, len(part)), cells)
        filled = np.flatnonzero(sums[1])
        yield key, (filled.astype(np.int32 if cells < 2**31 else np.int64), sums[:, filled])


def _running_sums(cells: np.ndarray, rows: np.ndarray, place: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, n_bins: int) -> np.ndarray:
    """Sums up to each bin by (derivative, node, feature, bin) over ``rows`` in the nodes at ``place``; ``cells`` has a row a feature."""
    wide = len(cells)
    running = np.empty((2, nodes, wide, n_bins))
    step = min(wide, max(1, SUM_CELLS // max(1, len(rows))))  # few rows take several features at a time
    start = place * (step * n_bins)
    weights = [np.tile(d.take(rows), step) for d in (g, h)]
    for at in range(0, wide, step):
        part = cells[at : at + step].take(rows, axis=1, mode="clip")
        flat = start + part
        if len(part) > 1:
            flat += (np.arange(len(part)) * n_bins)[:, None]
        flat = flat.ravel()
        for d, weight in enumerate(weights):
            counted = np.bincount(flat, weight[: len(flat)], nodes * step * n_bins).reshape(nodes, step, n_bins)
            np.cumsum(counted[:, : len(part)], axis=2, out=running[d, :, at : at + step])
    return running


def _cuts_of(running: np.ndarray, settings: Settings) -> tuple[np.ndarray, ...]:
    """``gain, feature, bin, G, H, G left, H left`` of each node as :func:`best_splits` has them, from sums up to each bin."""
    _, nodes, wide, n_bins = running.shape
    found, best = np.zeros((2, nodes), np.int64), np.zeros((5, nodes))
    least, least_gain = max(settings.min_child_weight, 1e-12), max(settings.gamma, 1e-9)
    step = max(1, CUT_CELLS // (wide * n_bins))

    def squared(g, out=None):
        if not settings.reg_alpha:
            return np.multiply(g, g, out=out)
        moved = np.maximum(np.abs(g) - settings.reg_alpha, 0.0)
        return np.multiply(moved, moved, out=out)

    with np.errstate(divide="ignore", invalid="ignore"):  # where a side is empty, which is no cut
        for start in range(0, nodes, step):
            own = slice(start, start + step)
            g, h = running[:, own]
            whole_g, whole_h = g[:, :1, -1:], h[:, :1, -1:]
            right, bottom = whole_g - g, (whole_h + settings.reg_lambda) - h
            barred = h < least
            barred |= bottom < least + settings.reg_lambda
            squared(right, right)
            right /= bottom
            np.add(h, settings.reg_lambda, out=bottom)
            score = squared(g)
            score /= bottom
            score += right
            score.ravel()[np.flatnonzero(barred)] = -np.inf
            score = score.reshape(len(g), -1)
            top, whole = score.max(1), _score(whole_g, whole_h, settings).ravel()
            # sums of another order may differ in their last digits, so gains this close are ties
            top = np.where(top - whole > least_gain, top - TIE * (top - whole), np.inf)
            at = (score >= top[:, None]).argmax(1)
            node = np.arange(len(at))
            feature, bin_ = np.divmod(at, n_bins)
            found[:, own] = np.where(np.isfinite(top), feature, -1), bin_
            best[:, own] = score[node, at] - whole, whole_g[:, 0, 0], whole_h[:, 0, 0], g[node, feature, bin_], h[node, feature, bin_]
    return best[0], *found, *best[1:]


def _grow_whole(tree: Tree, cells: np.ndarray, g: np.ndarray, h: np.ndarray, seen: np.ndarray, features: np.ndarray, n_bins: int, settings: Settings) -> np.ndarray:
    """Grow ``tree`` on those rows of its experiment that it has ``seen``; returns the node that each row ends in."""
    chosen = cells[features]
    n, flat = chosen.shape[1], chosen.reshape(-1)
    rows, place = np.arange(n), np.zeros(n, np.int64)  # rows of open nodes, and which node of the level that is
    ends, nodes = place.copy(), place[:1].copy()
    own = np.flatnonzero(seen)
    running = _running_sums(chosen, own, place.take(own), g, h, 1, n_bins)
    tree.scores[0] = _value(float(running[0, 0, 0, -1]), float(running[1, 0, 0, -1]), settings)
    least = 2 * max(settings.min_child_weight, 1e-12) * (1 - 1e-9)  # a node below has no cut that is allowed

    def kept(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in ``which`` of the nodes, numbered by their order there; the others have ended."""
        number = np.full(len(nodes), -1)
        number[which] = np.arange(len(which))
        at = number.take(place)
        if len(which) == len(nodes):
            return rows, at
        left = np.flatnonzero(at < 0)
        ends[rows.take(left)] = nodes.take(place.take(left))
        stay = np.flatnonzero(at >= 0)
        return rows.take(stay), at.take(stay)

    for depth in range(settings.max_depth):
        gain, feature, cut, whole_g, whole_h, left_g, left_h = _cuts_of(running, settings)
        split = np.flatnonzero(feature >= 0)
        if len(split) < len(nodes):
            rows, place = kept(split)
            nodes = nodes[split]
        if not len(split):
            return ends
        tree.features[nodes], tree.bins[nodes], tree.gains[nodes] = features[feature[split]], cut[split], gain[split]
        child_g, child_h = (np.stack([left, whole - left], 1)[split] for left, whole in ((left_g, whole_g), (left_h, whole_h)))
        for side in (0, 1):
            tree.scores[2 * nodes + 1 + side] = [_value(a, b, settings) for a, b in zip(child_g[:, side].tolist(), child_h[:, side].tolist())]
        right = flat.take((feature[split] * n).take(place) + rows) > cut[split].take(place)
        place *= 2
        place += right
        nodes = (2 * nodes[:, None] + np.array([1, 2])).ravel()
        opened = child_h >= least
        if depth + 1 == settings.max_depth or not opened.any():
            break
        sizes = np.bincount(place, minlength=len(nodes)).reshape(-1, 2)
        smaller = (sizes[:, 1] < sizes[:, 0]).astype(np.int64)
        needed = np.flatnonzero(opened.any(1))  # splits with an open child, whose smaller children are counted
        following = np.append(2 * needed + smaller[needed], 2 * needed + 1 - smaller[needed])
        rows, place = kept(following)
        nodes = nodes[following]
        own = np.flatnonzero((place < len(needed)) & seen.take(rows))
        counted = _running_sums(chosen, rows.take(own), place.take(own), g, h, len(needed), n_bins)
        below = np.empty((2, len(following), *running.shape[2:]))
        below[:, : len(needed)] = counted
        parents = split[needed]
        np.subtract(running if len(parents) == running.shape[1] else running[:, parents], counted, out=below[:, len(needed) :])
        running = below
        stay = np.flatnonzero(opened.ravel()[following])
        if len(stay) < len(following):
            rows, place = kept(stay)
            nodes, running = nodes[stay], running[:, stay]
    ends[rows] = nodes.take(place)
    return ends


def whole_rounds(block: Block, weights: np.ndarray, n_bins: int, columns: int, settings: Settings) -> tuple[np.ndarray, ...]:
    """All trees of an experiment from all its rows: the parts of :class:`Tree` by (round, tree, node)."""
    order = np.argsort(block.keys, kind="stable")  # sums don't depend on how blocks arrive
    keys, labels, cells = block.keys[order], block.labels[order], np.ascontiguousarray(block.bins[order].T)
    np.empty(KEPT_BYTES, np.uint8)  # once one this large was freed, the C library keeps smaller ones for the next instead of giving pages back
    margins = np.zeros((len(keys), columns))
    shape = settings.n_estimators, columns, settings.nodes
    found = np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape), np.zeros(shape)
    for round_ in range(settings.n_estimators):
        g, h = (np.ascontiguousarray(d.T) for d in derivatives(labels, margins, weights))
        for c in range(columns):
            tree = Tree(*(part[round_, c] for part in found))
            seen = drawn(keys, settings.subsample, settings.seed, block.experiment, round_, c)
            features = features_of(settings, len(cells), block.experiment, round_, c)
            margins[:, c] += tree.scores[_grow_whole(tree, cells, g[c], h[c], seen, features, n_bins, settings)]
    return found


def _whole_bytes(rows: int, width: int, n_bins: int, columns: int, settings: Settings) -> int:
    """About what the arrays of :func:`whole_rounds` take: bins twice, margins, derivatives and places, sums of two levels."""
    chosen = max(1, int(settings.colsample_bytree * width))
    sums = 16 * 3 * 2 ** (settings.max_depth - 1) * chosen * n_bins
    return rows * (2 * width * (1 if n_bins <= 256 else 2) + 48 * columns + 80) + sums


def _grow_experiments(blocks: DataFrame, weights: dict, cuts: dict[int, list[np.ndarray]], n_bins: int, columns: int, settings: Settings) -> DataFrame:
    """The trees as rows, an experiment for each task; they go to the table from there and not over the driver."""
    spark = blocks.sparkSession
    number = {e: i for i, e in enumerate(sorted(cuts))}
    shared = spark.sparkContext.broadcast(cuts)

    def grow(part):
        held: dict[int, list[Block]] = {}
        for e, row in part:
            held.setdefault(e, []).append(_load(row))
        for e in list(held):
            found = whole_rounds(_joined(held.pop(e)), weights[e], n_bins, columns, settings)
            for start in range(0, settings.n_estimators, TABLE_ROUNDS):
                rounds = [[Tree(*(part[r, c] for part in found)) for c in range(columns)] for r in range(start, min(start + TABLE_ROUNDS, settings.n_estimators))]
                batch = _tree_rows(e, start, rounds, shared.value[e])
                with pa.BufferOutputStream() as stream:
                    with pa.ipc.new_stream(stream, batch.schema) as writer:
                        writer.write_batch(batch)
                yield (bytearray(stream.getvalue()),)

    def unpack(batches):
        for batch in batches:
            for stream in batch.column(0):
                yield from pa.ipc.open_stream(stream.as_buffer())

    dealt = blocks.rdd.map(lambda row: (row.eval_fold, row)).partitionBy(len(number), lambda e: number[e]).mapPartitions(grow)
    return spark.createDataFrame(dealt, "rows binary", verifySchema=False).mapInArrow(unpack, TREES_SCHEMA)


def grow_all(blocks: DataFrame, class_counts: dict[int, Sequence[int]], cuts: dict[int, list[np.ndarray]], settings: Settings) -> DataFrame:
    """The trees of every experiment as rows (``TREES_SCHEMA``)."""
    columns, weights, widths, n_bins = _shape_of(class_counts, cuts)
    if settings.exact or max(_whole_bytes(sum(class_counts[e]), widths[e], n_bins, columns, settings) for e in cuts) > WHOLE_BYTES:
        return table_of(blocks.sparkSession, fit_all(blocks, class_counts, cuts, settings), cuts)
    return _grow_experiments(blocks, weights, cuts, n_bins, columns, settings)


def _shape_of(class_counts: dict[int, Sequence[int]], cuts: dict[int, list[np.ndarray]]) -> tuple[int, dict, dict, int]:
    """Trees of a round, weights of the classes and number of features by experiment, and bins of a feature."""
    classes = len(next(iter(class_counts.values())))
    counts = {e: np.asarray(n, float) for e, n in class_counts.items()}
    weights = {e: np.where(n > 0, n.sum() / (max(1, (n > 0).sum()) * np.maximum(n, 1)), 0.0) for e, n in counts.items()}
    n_bins = 1 + max((len(cut) for c in cuts.values() for cut in c), default=0)
    return 1 if classes == 2 else classes, weights, {e: len(c) for e, c in cuts.items()}, n_bins


def fit_all(
    blocks: DataFrame, class_counts: dict[int, Sequence[int]], cuts: dict[int, list[np.ndarray]], settings: Settings
) -> dict[int, list[list[Tree]]]:
    """The rounds of trees of every experiment, grown level by level."""
    context = blocks.sparkSession.sparkContext
    columns, weights, widths, n_bins = _shape_of(class_counts, cuts)
    rows_a_bin = max(map(sum, class_counts.values()), default=0) / settings.max_bin
    written = load_bins(blocks, len(cuts))
    rounds: dict[int, list[list[Tree]]] = {e: [] for e in cuts}

    def advance(data: RDD, new: dict[int, list[list[Tree]]], fresh: bool) -> RDD:
        shared = context.broadcast(new)

        def move(block: Block) -> Block:
            more = margins_of(shared.value[block.experiment], block.cells, columns)
            margins = more if fresh else block.margins + more
            return replace(block, margins=margins)

        return data.map(move).persist(StorageLevel.MEMORY_AND_DISK)

    state = advance(written, rounds, True)
    stale = None
    try:
        for round_ in range(settings.n_estimators):
            growing = {(e, c): Tree.empty(settings.nodes, settings.exact) for e in cuts for c in range(columns)}
            chosen = {(e, c): features_of(settings, widths[e], e, round_, c) for e, c in growing}
            open_nodes = {key: [0] for key in growing}
            for depth in range(settings.max_depth):
                if not open_nodes:
                    break
                found = _level(context, state, growing, open_nodes, chosen, weights, n_bins, settings, round_, rows_a_bin)
                if stale is not None:
                    stale.unpersist()
                    stale = None
                open_nodes = _grow(growing, open_nodes, chosen, found, settings, depth)
            for e in cuts:
                rounds[e].append([growing[e, c] for c in range(columns)])
            stale = state
            if (round_ + 1) % REBASE:
                state = advance(state, {e: r[-1:] for e, r in rounds.items()}, False)
            else:
                state = advance(written, {e: list(r) for e, r in rounds.items()}, True)
    finally:
        state.unpersist()
        if stale is not None:
            stale.unpersist()
    return rounds


def _level(context, state, growing, open_nodes, chosen, weights, n_bins, settings, round_, rows_a_bin) -> dict:
    """Best splits of the open nodes by (experiment, tree) and feature block."""
    span = FEATURE_BLOCK
    keys = [(e, c, s) for e, c in open_nodes for s in range(0, len(chosen[e, c]), span)]
    shared = context.broadcast((growing, open_nodes, chosen, weights))
    number = {key: i for i, key in enumerate(keys)}
    parts = max(1, min(len(keys), state.getNumPartitions()))

    def rows_of(part):
        return _level_rows(list(part), *shared.value, n_bins, span, settings, round_)

    def add_up(part):
        yield from _level_sums(rows_of(part), settings.exact)

    def total(part):
        totals: dict = {}
        for (e, c, start), (filled, values) in part:
            if (e, c, start) not in totals:
                nodes, features = len(shared.value[1][e, c]), len(shared.value[2][e, c][start : start + span])
                totals[e, c, start] = np.zeros((nodes * features * n_bins, len(values))), (nodes, features, n_bins, len(values))
            totals[e, c, start][0][filled] += values.T
        for key, (sums, shape) in totals.items():
            yield key, sums.reshape(shape)

    totals = state.mapPartitions(add_up).partitionBy(parts, lambda key: number[key]).mapPartitions(total)
    if settings.exact:
        totals = totals.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = dict(totals.map(lambda kv: (kv[0], best_splits(kv[1][..., :2], settings))).collect())
        if settings.exact:
            found = _search_bins(context, state, rows_of, totals, found, number, rows_a_bin, settings)
    finally:
        totals.unpersist()
        shared.destroy()
    return found


def _search_bins(context, state: RDD, rows_of, totals: RDD, found: dict, number: dict, rows_a_bin: float, settings: Settings) -> dict:
    """The best splits over every value, as ``found`` has them over the ends of bins; a feature counts from the tree's first.

    The driver receives a bit for each bin, then a split for each task and node.
    """
    least: dict = {}
    for (e, c, _), splits in found.items():
        gains = [gain if feature >= 0 else max(settings.gamma, 1e-9) for gain, feature, *_ in splits]
        least[e, c] = np.maximum(least.get((e, c), 0.0), gains)
    keys = {i: key for key, i in number.items()}

    def mark(item):
        key, sums = item
        return key, np.packbits(worth_search(sums, least[key[:2]], settings)), sums.shape

    marks = {key: (bits, shape) for key, bits, shape in totals.map(mark).collect()}
    n_marked = sum(int(np.unpackbits(bits, count=math.prod(shape[:3])).sum()) for bits, shape in marks.values())
    parts = max(1, state.getNumPartitions(), math.ceil(n_marked * rows_a_bin / SEARCH_ROWS))
    shared = context.broadcast(marks)

    def dealt(key, flat, columns):
        """The columns of marked cells by the task that searches their bins."""
        to = (flat * 7919 + number[key]) % parts
        order = np.argsort(to, kind="stable")
        ends = np.searchsorted(to[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(ends)).tolist():
            own = order[ends[p] : ends[p + 1]]
            yield p, (number[key], flat[own], columns[:, own])

    def ends_of(item):
        key, sums = item
        bits, shape = shared.value[key]
        flat = np.flatnonzero(np.unpackbits(bits, count=math.prod(shape[:3])))
        before = (sums.cumsum(2) - sums).reshape(-1, 3)[flat, :2]
        whole = sums[:, 0, :, :2].sum(1)[flat // (shape[1] * shape[2])]
        yield from dealt(key, flat, np.hstack([before, whole]).T)

    def cells_of(part):
        for key, features, cells, own in rows_of(part):
            wanted = np.unpackbits(shared.value[key][0], count=cells).astype(bool)
            picked = []
            for flat, block, rows, g, h in own:
                at = np.flatnonzero(wanted[flat])
                row, column = np.divmod(at, len(features))
                picked.append((flat[at], np.stack([block.values[rows[row], features[column]], g[row], h[row]])))
            flat, columns = np.concatenate([f for f, _ in picked]), np.hstack([c for _, c in picked])
            if not len(flat):
                continue
            order = np.lexsort((columns[0], flat))
            flat, columns = flat[order], columns[:, order]
            new = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (columns[0, 1:] != columns[0, :-1])))
            yield from dealt(key, flat[new], np.vstack([columns[0, new], np.add.reduceat(columns[1:], new, axis=1)]))

    def search(part):
        held: dict = {}
        for _, (i, flat, columns) in part:
            held.setdefault(i, {}).setdefault(len(columns), []).append((flat, columns))
        for i, by_kind in held.items():
            bins, ends = (np.concatenate(c, -1) for c in zip(*by_kind[4]))
            flat, columns = (np.concatenate(c, -1) for c in zip(*by_kind[3]))
            order = np.lexsort((columns[0], flat))
            flat, (value, g, h) = flat[order], columns[:, order]
            at = np.argsort(bins)
            place = at[np.searchsorted(bins[at], flat)]
            first = np.searchsorted(flat, flat, side="left")
            left = [ends[k, place] + s - np.append(0.0, s)[first] for k, s in enumerate((g.cumsum(), h.cumsum()))]
            gain = _gains(*left, ends[2, place], ends[3, place], settings)
            gain[:-1][(flat[1:] == flat[:-1]) & (value[1:] == value[:-1])] = -np.inf  # a cut lies after the last of equal values
            (e, c, start), (_, wide, n_bins, _) = keys[i], shared.value[keys[i]][1]
            node, feature = flat // (wide * n_bins), flat // n_bins % wide
            for n in np.unique(node[np.isfinite(gain)]).tolist():
                own = np.flatnonzero(node == n)
                top = gain[own].max()
                close = own[gain[own] >= top - TIE * abs(top)]
                b = close[np.lexsort((value[close], feature[close]))[0]]
                yield (e, c, n), (float(gain[b]), start + int(feature[b]), float(value[b]), *(float(v) for v in (*ends[2:, place[b]], left[0][b], left[1][b])))

    dealt_cells = context.union([totals.flatMap(ends_of), state.mapPartitions(cells_of)])
    searched = dealt_cells.partitionBy(parts, lambda p: p).mapPartitions(search).collect()
    shared.destroy()
    best = {(e, c, 0): [(-math.inf, -1, 0.0, *split[3:5], 0.0, 0.0) for split in splits] for (e, c, start), splits in found.items() if start == 0}
    for (e, c, n), split in sorted(searched, key=lambda kv: (kv[0], kv[1][1], kv[1][2])):
        if best[e, c, 0][n][1] < 0 or split[0] > best[e, c, 0][n][0] + TIE * abs(best[e, c, 0][n][0]):
            best[e, c, 0][n] = split
    return best


def _grow(growing, open_nodes, chosen, found, settings, depth) -> dict:
    """Split the open nodes where that gains; returns the nodes of the next level."""
    following = {}
    for (e, c), nodes in open_nodes.items():
        tree = growing[e, c]
        parts = [(start, found[e, c, start]) for start in range(0, len(chosen[e, c]), FEATURE_BLOCK) if (e, c, start) in found]
        for place, node in enumerate(nodes):
            best = None
            for start, splits in parts:
                gain, feature, bin_, g, h, left_g, left_h = splits[place]
                if node == 0:
                    tree.scores[0] = _value(g, h, settings)
                if feature >= 0 and (best is None or gain > best[0] + TIE * abs(best[0])):
                    best = gain, int(chosen[e, c][start + feature]), bin_, g, h, left_g, left_h
            if best is None:
                continue
            gain, feature, bin_, g, h, left_g, left_h = best
            tree.features[node], tree.bins[node], tree.gains[node] = feature, bin_, gain
            left = 2 * node + 1
            tree.scores[left] = _value(left_g, left_h, settings)
            tree.scores[left + 1] = _value(g - left_g, h - left_h, settings)
            if depth + 1 < settings.max_depth:
                following.setdefault((e, c), []).extend([left, left + 1])
    return following


def _tree_rows(experiment: int, first: int, rounds: Sequence[Sequence[Tree]], cuts: Sequence[np.ndarray]) -> pa.RecordBatch:
    """Trees of an experiment from round ``first`` on, cuts as values of the features, so that scoring needs no bins."""
    limits = np.zeros((len(cuts), max(1, max(map(len, cuts), default=0))))
    for i, cut in enumerate(cuts):
        limits[i, : len(cut)] = cut
    numbers, sizes, nodes = [], [], []
    for r, trees in enumerate(rounds):
        for c, tree in enumerate(trees):
            used = int(np.flatnonzero(tree.features >= 0).max(initial=-1))
            last = 1 if used < 0 else 2 * used + 3
            features, bins = tree.features[:last], tree.bins[:last]
            values = bins if bins.dtype.kind == "f" else limits[features, bins]
            numbers.append((experiment, first + r, c))
            sizes.append(last)
            nodes.append((features, np.where(features < 0, 0.0, values), tree.scores[:last], tree.gains[:last]))
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    columns = [pa.array(column, pa.int32()) for column in zip(*numbers)]
    columns += [pa.ListArray.from_arrays(ends, np.concatenate(parts)) for parts in zip(*nodes)]
    return pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in TREES_SCHEMA.split(", ")])


def table_of(spark, rounds: dict[int, list[list[Tree]]], cuts: dict[int, list[np.ndarray]]) -> DataFrame:
    """The trees as rows; as Arrow, since each number in a list of rows would be an object."""
    return spark.createDataFrame(pa.Table.from_batches([_tree_rows(e, 0, trees, cuts[e]) for e, trees in rounds.items()]), TREES_SCHEMA)


def _as_shares(total: np.ndarray, times: np.ndarray) -> np.ndarray:
    mean = total / np.maximum(times, 1)
    return mean / mean.sum() if mean.sum() > 0 else mean


def importances(rounds: Sequence[Sequence[Tree]], width: int) -> np.ndarray:
    """Mean gain of the splits on each feature, as shares of their sum."""
    total, times = np.zeros(width), np.zeros(width)
    for trees in rounds:
        for tree in trees:
            used = tree.features >= 0
            np.add.at(total, tree.features[used], tree.gains[used])
            np.add.at(times, tree.features[used], 1)
    return _as_shares(total, times)


def table_importances(trees: DataFrame, widths: dict[int, int]) -> dict[int, np.ndarray]:
    """:func:`importances` of every experiment from the table of its trees; a row for each feature reaches the driver."""
    splits = trees.select("eval_fold", F.explode(F.arrays_zip("features", "gains")).alias("node")).where("node.features >= 0")
    sums = splits.groupBy("eval_fold", "node.features").agg(F.sum("node.gains").alias("total"), F.count(F.lit(1)).alias("times"))
    found = {e: np.zeros((2, width)) for e, width in widths.items()}
    for row in sums.collect():
        found[row["eval_fold"]][:, row["features"]] = row["total"], row["times"]
    return {e: _as_shares(*both) for e, both in found.items()}


def score(design: DataFrame, trees: DataFrame, columns: int) -> DataFrame:
    """``design`` (with ``eval_fold`` and ``x``) and the summed leaf values as ``margins``.

    The trees are the model; they are broadcast to the tasks like the weights of a linear one,
    an experiment at a time.
    """
    spark = design.sparkSession
    shared = {}
    for (e,) in trees.select("eval_fold").distinct().collect():
        own = trees.where(F.col("eval_fold") == e).orderBy("round", "tree").select("tree", "features", "cuts", "scores")
        held = []
        for batch in own.toArrow().to_batches():
            lists = [(batch.column(name).offsets.to_numpy(), batch.column(name).values.to_numpy()) for name in ("features", "cuts", "scores")]
            for i, column in enumerate(batch.column("tree").to_pylist()):
                held.append((column, *(values[offsets[i] : offsets[i + 1]] for offsets, values in lists)))
        shared[e] = spark.sparkContext.broadcast(held)
    names = design.columns

    def add(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            experiments = batch.column("eval_fold").to_numpy()
            lists = batch.column("x")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            total = np.zeros((batch.num_rows, columns))
            for e in np.unique(experiments).tolist():
                own = np.flatnonzero(experiments == e)
                for column, features, cuts, scores in shared[e].value if e in shared else ():
                    at, rows = np.zeros(len(own), np.int64), np.arange(len(own))
                    while True:
                        rows = rows[features[at[rows]] >= 0]
                        if not len(rows):
                            break
                        here = at[rows]
                        at[rows] = 2 * here + 1 + (flat[offsets[own[rows]] + features[here]] > cuts[here])
                    total[own, column] += scores[at]
            margins = pa.ListArray.from_arrays(np.arange(0, total.size + 1, columns, dtype=np.int32), total.ravel())
            kept = [batch.column(name) for name in names if name != "x"]
            yield pa.RecordBatch.from_arrays([*kept, margins], names=[*[n for n in names if n != "x"], "margins"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in design.schema.fields if f.name != "x"]
    return design.mapInArrow(add, ", ".join([*fields, "margins array<double>"]))
