"""Boosted trees for MLlib's classifier, grown on packed blocks of rows.

The method, its parameters and the fitted model are those of MLlib's ``GBTClassifier``: trees on the residuals of the
logistic loss, best split of the variance among at most ``maxBins`` bins a feature, level by level. What differs is the cost of
a level. MLlib adds every slot of every row to the statistics, here only a row's entries other than zero are added: what the rows
at zero amount to is the node's total less the others. Blocks stay where Spark put their rows; a level is one job that sums
small tables of statistics. So many rows as a level passes sooner than a job is scheduled make one block, whose fit is one job.
"""

from __future__ import annotations

import json
import math
import operator
import pickle
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, put, remove

EPSILON = 2.220446049250313e-16
# Distinct values of a feature that one partition reports; of more, so many of equal rank distance.
SKETCH_POINTS = 1_000
# Statistics that the partitions send for one job together; the nodes of a level go in several jobs beyond it.
BYTES_PER_JOB = 2**27
# A fit of no more rows runs as one task: a level of it takes about 50 ms for a million rows, as long as a job takes that does nothing.
ROWS_PER_TASK = 1_000_000
# Margins are carried from round to round; after so many they are computed anew from all trees, so that lineage stays short.
ROUNDS_PER_LINEAGE = 50


# -- rows to blocks ---------------------------------------------------------------

@dataclass
class Bins:
    """Global bins: those of feature f are ``off[f]`` to ``off[f + 1]``; bin b ends at ``upper[b]``, the last of a feature at infinity."""

    off: np.ndarray
    upper: np.ndarray
    feature: np.ndarray = field(init=False)
    zero: np.ndarray = field(init=False)
    cuts: np.ndarray = field(init=False)

    def __post_init__(self):
        d = len(self.off) - 1
        self.feature = np.repeat(np.arange(d, dtype=np.int32), np.diff(self.off))
        self.cuts = np.isfinite(self.upper)
        self.zero = self.off[:-1] + np.add.reduceat((self.upper < 0).astype(int), self.off[:-1])

    def place(self, f: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The bin of each value; one that equals a bin's end belongs to it."""
        out = np.empty(len(f), np.int64)
        order = np.argsort(f, kind="stable")
        found, start = np.unique(f[order], return_index=True)
        for k, a, b in zip(found, start, [*start[1:], len(f)]):
            at = order[a:b]
            out[at] = self.off[k] + np.searchsorted(self.upper[self.off[k]:self.off[k + 1] - 1], v[at])
        return out


@dataclass
class Block:
    """Rows of one partition: labels as -1 and 1, and the bins of a row's entries but those in the bin of zero, as many lines as a row has at most.

    A row of fewer has the number of all bins in the lines that are left.
    """

    part: int
    y: np.ndarray
    lines: np.ndarray

    @staticmethod
    def of(part: int, y: np.ndarray, row: np.ndarray, bin: np.ndarray, bins: Bins) -> Block:
        of_row = np.bincount(row, minlength=len(y))
        none = len(bins.upper)
        lines = np.full((int(of_row.max(initial=0)), len(y)), none, np.uint16 if none < 2**16 else np.uint32)
        lines[np.arange(len(row)) - np.repeat(np.cumsum(of_row) - of_row, of_row), row] = bin
        return Block(part, 2 * y - 1, lines)

    @staticmethod
    def joined(part: int, blocks: list[Block], bins: Bins) -> Block:
        most = max(len(b.lines) for b in blocks)
        wide = [np.pad(b.lines, ((0, most - len(b.lines)), (0, 0)), constant_values=len(bins.upper)) for b in blocks]
        return Block(part, np.concatenate([b.y for b in blocks]), np.concatenate(wide, axis=1))


def entries(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, and (row, feature, value) of all entries other than zero; vectors may be sparse or dense."""
    ys, rows, features, values, n = [], [], [], [], 0
    for batch in batches:
        x, m = batch.column(0), batch.num_rows
        lens = x.field("values").value_lengths().to_numpy(zero_copy_only=False)
        v = x.field("values").flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(m), lens)
        f = np.arange(len(v)) - np.repeat(np.cumsum(lens) - lens, lens)
        sparse = x.field("type").to_numpy(zero_copy_only=False)[row] == 0
        f[sparse] = x.field("indices").flatten().to_numpy(zero_copy_only=False)
        kept = v != 0
        ys.append(batch.column(1).to_numpy(zero_copy_only=False))
        rows.append((row[kept] + n).astype(np.int32))
        features.append(f[kept].astype(np.int32))
        values.append(v[kept])
        n += m
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return join(ys, np.float64), join(rows, np.int32), join(features, np.int32), join(values, np.float64)


def _points(y: np.ndarray, f: np.ndarray, v: np.ndarray) -> tuple[int, list]:
    """Rows, and how often each value of each feature occurs in the partition; of many values, so many that are evenly spaced by rank."""
    if not np.isin(y, (0.0, 1.0)).all():
        raise ValueError("labels must be 0 or 1")
    f, v = f[~np.isnan(v)], v[~np.isnan(v)]
    order = np.lexsort((v, f))
    f, v = f[order], v[order]
    first = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (v[1:] != v[:-1])][:len(f)])
    f, v, w = f[first], v[first], np.diff(np.r_[first, len(f)])
    found, start = np.unique(f, return_index=True)
    parts = []
    for k, a, b in zip(found, start, [*start[1:], len(f)]):
        points, total = v[a:b], np.cumsum(w[a:b])
        if b - a > SKETCH_POINTS:
            at = np.unique(np.searchsorted(total, np.linspace(0, total[-1], SKETCH_POINTS + 1)[1:]))
            points, total = points[at], total[at]
        parts.append((int(k), points, np.diff(np.r_[0, total])))
    return len(y), parts


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    y, _, f, v = entries(batches)
    yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(_points(y, f, v))]})


def _upper(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Ends of at most ``most`` bins: between all neighbours if these are few, else nearest to equal shares of the rows."""
    between = (values[:-1] + values[1:]) / 2
    if len(values) <= most:
        return between
    upto = np.cumsum(weights)
    aims = upto[-1] * np.arange(1, most) / most
    at = np.clip(np.searchsorted(upto, aims), 0, len(between) - 1)
    before = np.maximum(at - 1, 0)
    return between[np.unique(np.where(aims - upto[before] < upto[at] - aims, before, at))]


def find_bins(rows: DataFrame, d: int, most: int) -> tuple[Bins, int]:
    """Bins of all features from the values of all rows, and the number of rows."""
    return _bins([pickle.loads(r["part"]) for r in rows.mapInArrow(_sketch, "part binary").collect()], d, most)


def _bins(points: list[tuple[int, list]], d: int, most: int) -> tuple[Bins, int]:
    n, parts = 0, {}
    for m, found in points:
        n += m
        for k, v, w in found:
            parts.setdefault(k, []).append((v, w))
    off, upper = [0], []
    for k in range(d):
        held = parts.get(k, [])
        v, w = (np.concatenate([p[i] for p in held] or [np.empty(0)]) for i in (0, 1))
        if n > w.sum():
            v, w = np.append(v, 0.0), np.append(w, n - w.sum())
        v, at = np.unique(v, return_inverse=True)
        ends = _upper(v, np.bincount(at, w), min(most, max(n, 1)))
        upper += [ends, [np.inf]]
        off.append(off[-1] + len(ends) + 1)
    return Bins(np.array(off), np.concatenate(upper)), n


def _block(part: int, y: np.ndarray, row: np.ndarray, f: np.ndarray, v: np.ndarray, bins: Bins) -> Block:
    b = bins.place(f, v)
    kept = b != bins.zero[f]
    return Block.of(part, y, row[kept], b[kept], bins)


def _packed(bins: Bins) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"block": [pickle.dumps(_block(TaskContext.get().partitionId(), *entries(batches), bins))]})

    return pack


# -- trees ------------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes in order of levels; a node's right child follows its left one. ``feature`` of a leaf is -1, ``cut`` the last bin on the left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    stats: np.ndarray  # rows, sum and sum of squares of the residuals

    @staticmethod
    def root() -> Tree:
        return Tree(np.array([-1]), np.array([-1]), np.array([-1]), np.array([-1.0]), np.zeros((1, 3)))

    @property
    def prediction(self) -> np.ndarray:
        return self.stats[:, 1] / np.maximum(self.stats[:, 0], 1)

    @property
    def impurity(self) -> np.ndarray:
        n = np.maximum(self.stats[:, 0], 1)
        return (self.stats[:, 2] - self.stats[:, 1] ** 2 / n) / n

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, children: np.ndarray) -> np.ndarray:
        """Split nodes; ``children`` has rows and sum of the left and the right one of each. Returns the ids of all children."""
        first = len(self.feature)
        self.feature[nodes], self.cut[nodes], self.gain[nodes] = feature, cut, gain
        self.left[nodes] = first + 2 * np.arange(len(nodes))
        new = 2 * len(nodes)
        self.feature, self.cut, self.left = (np.append(a, np.full(new, -1)) for a in (self.feature, self.cut, self.left))
        of = children.reshape(new, 2)  # squares are gathered for nodes that are tried; no score or importance needs those of a last leaf
        self.gain, self.stats = np.append(self.gain, np.full(new, -1.0)), np.concatenate([self.stats, np.c_[of, of[:, 1] ** 2 / of[:, 0]]])
        return np.arange(first, first + new)


def _step(block: Block, bins: Bins, tree: Tree, node: np.ndarray) -> np.ndarray:
    """From each row's node to its child; a row in a leaf stays.

    Rows at zero go right where the bin of zero lies beyond the cut. An entry takes its row to the other side if it lies on that side
    of the cut, among the bins of the node's feature.
    """
    zero_right = bins.zero[tree.feature] > tree.cut
    low = np.where(zero_right, bins.off[tree.feature], tree.cut + 1)
    width = np.where(zero_right, tree.cut + 1, bins.off[tree.feature + 1]) - low
    inner, kind = tree.feature >= 0, block.lines.dtype
    low, width = (np.where(inner, x, 0).astype(kind)[node] for x in (low, width))
    other = np.zeros(len(node), bool)
    for line in block.lines:
        other |= line - low < width  # unsigned: what lies below is far beyond
    child = np.stack([np.where(inner, tree.left + zero_right, np.arange(len(inner))), np.where(inner, tree.left + ~zero_right, np.arange(len(inner)))], 1)
    return child.ravel()[2 * node + other]


def _walk(block: Block, bins: Bins, tree: Tree) -> np.ndarray:
    """The last node of each row."""
    node = np.zeros(len(block.y), np.int64)
    while (tree.feature[node] >= 0).any():
        node = _step(block, bins, tree, node)
    return node


def _residual(y: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """What the next tree is fitted to: the labels at first, then the negative gradient of 2 log(1 + exp(-2 y margin))."""
    return y if margin is None else 4 * y / (1 + np.exp(np.minimum(2 * y * margin, 700)))


def _bag(block: Block, seed: int, m: int, rate: float) -> np.ndarray | None:
    """Which rows a round sees; drawn from the seed, the round and the partition."""
    return None if rate >= 1 else np.random.default_rng([seed % 2**63, m, block.part]).random(len(block.y)) < rate


def _sums(block: Block, bins: Bins, node: np.ndarray, residual: np.ndarray, bag: np.ndarray | None, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of ``nodes``: rows and sum of the residuals by bin, without the rows at zero; and rows, sum and sum of squares in all."""
    a, g = len(nodes), len(bins.upper) + 1
    slots = np.full(max(int(node.max(initial=0)), int(nodes.max())) + 1, a)
    slots[nodes] = np.arange(a)
    slot = slots[node]
    if bag is not None:
        slot[~bag] = a
    by_bin, base = np.zeros((2, (a + 1) * g)), slot * g
    for line in block.lines:
        key = base + line
        by_bin[0] += np.bincount(key, minlength=(a + 1) * g)
        by_bin[1] += np.bincount(key, residual, (a + 1) * g)
    total = np.stack([np.bincount(slot, w, a + 1)[:a] for w in (None, residual, residual * residual)], axis=1)
    return by_bin.reshape(2, a + 1, g)[:, :a, :-1].transpose(1, 2, 0), total


@dataclass(frozen=True)
class Settings:
    rounds: int
    depth: int
    leaf: int
    rate: float
    subsample: float
    columns: int
    min_gain: float
    seed: int


def _best(by_bin: np.ndarray, total: np.ndarray, bins: Bins, p: Settings, allowed: np.ndarray | None):
    """Of each node: gain, bin of the best cut, rows and sum of both sides. The first of equal cuts wins, by feature and bin."""
    starts, by_bin, total = bins.off[:-1], by_bin.copy(), total[:, :2]
    by_bin[:, bins.zero] += total[:, None] - np.add.reduceat(by_bin, starts, axis=1)
    left = np.cumsum(by_bin, axis=1)
    left -= (left[:, starts] - by_bin[:, starts])[:, bins.feature]
    right = total[:, None] - left
    n, nl, nr = total[:, None, 0], left[..., 0], right[..., 0]
    ok = bins.cuts & (nl >= max(p.leaf, 1)) & (nr >= max(p.leaf, 1))
    if allowed is not None:
        ok &= allowed[:, bins.feature]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, (left[..., 1] ** 2 / nl + right[..., 1] ** 2 / nr - total[:, None, 1] ** 2 / n) / n, -np.inf)
    best, each = gain.argmax(axis=1), np.arange(len(total))
    return gain[each, best], best, np.stack([left[each, best], right[each, best]], axis=1)


def boost(p: Settings, bins: Bins, parts: int, sums: Callable, close: Callable) -> list[Tree]:
    """All rounds. ``sums(m, tree, nodes)`` gives the statistics of nodes over all rows, ``close(m, tree)`` adds a tree to the margins."""
    trees, d = [], len(bins.off) - 1
    at_once = max(1, BYTES_PER_JOB // (16 * (len(bins.upper) + 1) * max(parts, 4)))
    for m in range(p.rounds):
        tree, open_nodes = Tree.root(), np.array([0])
        for level in range(max(p.depth, 1)):
            rng = np.random.default_rng([p.seed % 2**63, m, 2**31 + level])
            made = []
            for a in range(0, len(open_nodes), at_once):
                nodes = open_nodes[a:a + at_once]
                by_bin, tree.stats[nodes] = sums(m, tree, nodes)
                allowed = None if p.columns >= d else rng.random((len(nodes), d)).argsort(axis=1).argsort(axis=1) < p.columns
                gain, cut, children = _best(by_bin, tree.stats[nodes], bins, p, allowed)
                good = (gain > 0) & (gain >= p.min_gain) & (tree.impurity[nodes] >= EPSILON) & (level < p.depth)
                made.append((nodes[good], cut[good], gain[good], children[good]))
            nodes, cut, gain, children = (np.concatenate(x) for x in zip(*made))
            if not len(nodes):
                break
            new = tree.split(nodes, bins.feature[cut], cut, gain, children)
            open_nodes = new[tree.stats[new, 0] >= 2 * max(p.leaf, 1)]
            if not len(open_nodes):
                break
        trees.append(tree)
        close(m, tree)
    return trees


def _weight(p: Settings, m: int) -> float:
    return p.rate if m else 1.0


def _add(block: Block, bins: Bins, margin: np.ndarray | None, tree: Tree, weight: float) -> np.ndarray:
    return (0.0 if margin is None else margin) + weight * tree.prediction[_walk(block, bins, tree)]


def boost_block(block: Block, bins: Bins, p: Settings) -> list[Tree]:
    """All rounds over the rows of one partition; each row's node is kept from level to level."""
    held = {"margin": None, "node": None, "of": None}

    def sums(m: int, tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if held["of"] != (m, len(tree.feature)):
            fresh = held["of"] is None or held["of"][0] != m
            if fresh:
                held.update(residual=_residual(block.y, held["margin"]), bag=_bag(block, p.seed, m, p.subsample))
            held["node"] = np.zeros(len(block.y), np.int64) if fresh else _step(block, bins, tree, held["node"])
            held["of"] = (m, len(tree.feature))
        return _sums(block, bins, held["node"], held["residual"], held["bag"], nodes)

    def close(m: int, tree: Tree) -> None:
        held["margin"] = _add(block, bins, held["margin"], tree, _weight(p, m))

    return boost(p, bins, 1, sums, close)


def boost_blocks(blocks: RDD, bins: Bins, p: Settings) -> list[Tree]:
    """All rounds over a persisted (block, margin) a partition: a job a level, whose sums are added in the partitions' order."""
    sc, trees, sent = blocks.context, [], []
    known = sc.broadcast(bins)
    state = {"now": blocks, "old": None}

    def sums(m: int, tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def of(held):
            block, margin = held
            node = _walk(block, known.value, tree)
            return _sums(block, known.value, node, _residual(block.y, margin), _bag(block, p.seed, m, p.subsample), nodes)

        found = state["now"].map(of).collect()
        if state["old"] is not None:  # the margins of this round are there now
            state["old"].unpersist()
            state["old"] = None
        by_bin, total = zip(*found)
        return sum(by_bin[1:], by_bin[0]), sum(total[1:], total[0])

    def close(m: int, tree: Tree) -> None:
        trees.append(tree)
        if m + 1 == p.rounds:
            return
        whole = (m + 1) % ROUNDS_PER_LINEAGE == 0
        new = sc.broadcast([(t, _weight(p, i)) for i, t in enumerate(trees)] if whole else [(tree, _weight(p, m))])
        sent.append(new)

        def add(held):
            block, margin = held
            for t, weight in new.value:
                margin = _add(block, known.value, margin, t, weight)
            return block, margin

        before = state["now"]
        state["now"] = (blocks if whole else before).map(add, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        state["old"] = None if before is blocks else before

    try:
        return boost(p, bins, blocks.getNumPartitions(), sums, close)
    finally:
        for held in (state["now"], state["old"]):
            if held is not None and held is not blocks:
                held.unpersist()
        for b in (known, *sent):
            b.unpersist()


# -- the estimator ----------------------------------------------------------------

def _columns(strategy: str, d: int) -> int:
    """Features that a node may be split by, as MLlib reads the strategy of a single tree."""
    named = {"auto": d, "all": d, "sqrt": math.ceil(math.sqrt(d)), "log2": max(1, math.ceil(math.log2(d))), "onethird": math.ceil(d / 3)}
    if strategy in named:
        return named[strategy]
    return min(d, int(strategy)) if strategy.isdigit() and int(strategy) > 1 else math.ceil(float(strategy) * d)


class BoostedTrees(GBTClassifier):
    """MLlib's boosted trees, fitted on packed blocks. The fitted model is MLlib's own: it scores, saves and loads as such."""

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        if self.isDefined(self.weightCol) or self.isDefined(self.validationIndicatorCol):
            return super()._fit(dataset)
        spark, features = dataset.sparkSession, self.getFeaturesCol()
        rows = dataset.select(F.col(features).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        d = dataset.schema[features].metadata.get("ml_attr", {}).get("num_attrs")
        if d is None:
            first = rows.first()
            if first is None:
                raise ValueError("no rows to fit")
            d = first["x"].size
        p = Settings(self.getMaxIter(), self.getMaxDepth(), self.getMinInstancesPerNode(), self.getStepSize(), self.getSubsamplingRate(),
                     _columns(self.getFeatureSubsetStrategy(), d), self.getMinInfoGain(), self.getSeed())
        bins, trees = self._grown(rows, d, p)
        return self._as_model(spark, trees, bins, p, d)

    def _grown(self, rows: DataFrame, d: int, p: Settings) -> tuple[Bins, list[Tree]]:
        most = self.getMaxBins()

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y, row, f, v = entries(batches)
            bins, n = _bins([_points(y, f, v)], d, most)
            trees = boost_block(_block(0, y, row, f, v, bins), bins, p) if n else []
            yield pa.RecordBatch.from_pydict({"fit": [pickle.dumps((bins, trees))]})

        if rows.rdd.getNumPartitions() == 1:
            bins, trees = pickle.loads(rows.mapInArrow(alone, "fit binary").first()["fit"])
            if not trees:
                raise ValueError("no rows to fit")
            return bins, trees
        bins, n = find_bins(rows, d, most)
        if not n:
            raise ValueError("no rows to fit")
        packed = rows.mapInArrow(_packed(bins), "block binary")
        if n <= ROWS_PER_TASK:
            def whole(held):
                blocks = sorted((pickle.loads(r["block"]) for r in held), key=operator.attrgetter("part"))
                return [boost_block(Block.joined(0, blocks, bins), bins, p)]

            return bins, packed.repartition(1).rdd.mapPartitions(whole).collect()[0]
        blocks = packed.rdd.map(lambda r: (pickle.loads(r["block"]), None)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return bins, boost_blocks(blocks, bins, p)
        finally:
            blocks.unpersist()

    def _as_model(self, spark: SparkSession, trees: list[Tree], bins: Bins, p: Settings, d: int) -> GBTClassificationModel:
        """The trees in the form that MLlib saves, read by MLlib."""
        path = fresh_path(spark, "trees")
        about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
        of = lambda held: {k.name: v for k, v in held.items()}
        whole = {"class": "org.apache.spark.ml.classification.GBTClassificationModel", "uid": self.uid, **about,
                 "paramMap": of(self._paramMap), "defaultParamMap": of(self._defaultParamMap), "numFeatures": d, "numTrees": len(trees)}
        one = {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", **about,
               "paramMap": {"featuresCol": self.getFeaturesCol(), "maxDepth": p.depth}, "defaultParamMap": {}}
        try:
            put(spark, f"{path}/metadata/part-00000", json.dumps(whole).encode())
            each = {"_1": pa.array(range(len(trees)), pa.int32()), "_2": [json.dumps({**one, "uid": f"{self.uid}_{i}"}) for i in range(len(trees))],
                    "_3": [_weight(p, i) for i in range(len(trees))]}
            for name, rows in (("treesMetadata", pa.table(each)), ("data", _nodes(trees, bins))):
                out = pa.BufferOutputStream()
                pq.write_table(rows, out)
                put(spark, f"{path}/{name}/part-00000.parquet", out.getvalue().to_pybytes())
            return GBTClassificationModel.load(path)
        finally:
            remove(spark, path)


def _nodes(trees: list[Tree], bins: Bins) -> pa.Table:
    """A row a node, as MLlib saves them."""
    join = lambda values: np.concatenate(values)
    sizes = [len(t.feature) for t in trees]
    feature, cut, left, stats = (join([getattr(t, a) for t in trees]) for a in ("feature", "cut", "left", "stats"))
    inner, n = feature >= 0, len(feature)
    i32 = lambda a: pa.array(a, pa.int32())
    split = pa.StructArray.from_arrays([
        i32(feature), pa.ListArray.from_arrays(i32(np.r_[0, np.cumsum(inner)]), pa.array(bins.upper[cut[inner]], pa.float64())),
        i32(np.full(n, -1))], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    node = pa.StructArray.from_arrays([
        i32(join([np.arange(s) for s in sizes])), pa.array(join([t.prediction for t in trees])), pa.array(join([t.impurity for t in trees])),
        pa.ListArray.from_arrays(i32(3 * np.arange(n + 1)), pa.array(stats.ravel())), pa.array(stats[:, 0].astype(np.int64)),
        pa.array(join([t.gain for t in trees])), i32(left), i32(np.where(inner, left + 1, -1)), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.table({"treeID": i32(np.repeat(np.arange(len(trees)), sizes)), "nodeData": node})
