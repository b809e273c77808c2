"""Boosted regression trees over binned panels.

The model is the one that Spark's ``GBTRegressor`` fits with squared error, all rows and all features in every tree: the
first tree fits the label and counts in full, each later one fits twice the residual and counts ``step_size``; a node is
divided where the variance falls most, the first such place in the order of features and bins.

A tree of depth 6 needs six passes over all rows. The panel is binned once and lies in blocks of rows, a byte per feature
and the residual as a double, dealt over the tasks and persisted. A pass counts and adds up the residuals per node, feature
and bin, block by block, and ``treeReduce`` merges the tasks' histograms. Of the two children of a node a pass reads the one
with fewer rows; the other is the parent's histogram less that one. The driver holds the histograms of one level
(at most 32 nodes) and the trees, whatever the number of rows. Every ``CHECKPOINT_TREES`` trees the blocks go to the
checkpoint folder, so a lost executor redoes a few trees at most.

A row may stand for many that are alike in all bins (``distinct``): with their mean label and their number as its weight,
every sum that a tree compares is what it was. A pass costs a Spark job, which takes longer than one core needs for the
rows of a small panel: up to ``ALONE_ROWS`` distinct rows, a task reads all blocks and grows all trees over them, by the same
functions. In small nodes many places divide the rows alike, and rounding, so the order of the rows, decided between them;
over distinct rows the first place within ``TIES`` of the best is taken, in whatever order the rows lie.

Nulls: a missing feature counts as larger than every split point, in training and in scoring. A null label is an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallboard.session import cut_lineage

#: Most rows of a task; up to that there is a task per core, as starting a task costs as much as reading 100 000s of rows.
TASK_ROWS = 1 << 23
BLOCK_ROWS = 1 << 13
#: Up to so many tasks' histograms (0.4 MB each) are added up without a shuffle.
DIRECT_TASKS = 32
CHECKPOINT_TREES = 10
#: Share of the best gain within which splits of distinct rows count as equal.
TIES = 1e-9
#: Most distinct rows over which one task grows all trees: 25 bytes each, held in the task, and about as long as the passes' jobs would take.
ALONE_ROWS = 1 << 20
BLOCKS = "bins binary, target binary"
#: A block of rows: (feature, row) bins and residuals; a third array has the weights, without it every row counts once.
Block = tuple[np.ndarray, ...]


@dataclass
class Tree:
    """A full binary tree: node k of level d has place 2^d - 1 + k, its children are 2k and 2k + 1. Rows whose bin of
    ``feature`` is above ``cut`` go right; where a node is not divided, all go left. ``leaf`` has the values below the last level."""
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    @property
    def depth(self) -> int:
        return len(self.leaf).bit_length() - 1


def bins_of(columns: list[np.ndarray], splits: list[np.ndarray]) -> np.ndarray:
    """(feature, row) number of the bin of each value: split points below it. NaN lies in the last bin."""
    return np.stack([np.searchsorted(s, c).astype(np.uint8) for s, c in zip(splits, columns)])


def route(bins: np.ndarray, tree: Tree, depth: int, above: np.ndarray | None = None) -> np.ndarray:
    """The node of level ``depth`` that each row falls to, from the root or from the nodes of the level ``above``."""
    rows = bins.shape[1]
    at, flat, offset = np.arange(rows), bins.ravel(), tree.feature * rows
    node = np.zeros(rows, np.intp) if above is None else above
    for level in range(depth) if above is None else (depth - 1,):
        place = node + ((1 << level) - 1)
        node = node + node
        node += flat.take(offset.take(place) + at) > tree.cut.take(place)
    return node


def histograms(blocks: Iterator[Block], tree: Tree, depth: int, slots: np.ndarray, width: int,
               nodes: list[np.ndarray] | None = None) -> Iterator[np.ndarray]:
    """(weight or sum of weighted residuals, feature, slot, bin) of the rows whose node of level ``depth`` has a slot (not -1).
    ``nodes`` has the nodes of each block's rows where they are known."""
    out = None
    taken = int(slots.max()) + 1
    for k, (bins, target, *weights) in enumerate(blocks):
        weight = weights[0] if weights else None
        if out is None:
            out = np.zeros((2, len(bins), taken * width))
        slot = slots.take(route(bins, tree, depth) if nodes is None else nodes[k])
        if depth:
            rows = np.flatnonzero(slot >= 0)
            bins, target, slot = bins.take(rows, axis=1), target.take(rows), slot.take(rows)
            weight = None if weight is None else weight.take(rows)
        base = slot * width
        total = target if weight is None else target * weight
        for f, own in enumerate(bins):
            place = base + own
            out[0, f] += np.bincount(place, weight, taken * width)
            out[1, f] += np.bincount(place, total, taken * width)
    if out is not None:
        yield out.reshape(2, -1, taken, width)


def best_splits(level: np.ndarray, ties: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, means of both children) per node of a level's histograms: the first place within ``ties`` of the best. Nodes that no split improves get a cut
    beyond all bins and their own mean on the left."""
    count, total = level
    nodes = np.arange(count.shape[1])
    n, s = count[0].sum(1), total[0].sum(1)
    left, left_sum = count.cumsum(2)[..., :-1], total.cumsum(2)[..., :-1]
    right, right_sum = n[None, :, None] - left, s[None, :, None] - left_sum
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left * right * (left_sum / left - right_sum / right) ** 2
    gain = np.where((left > 0) & (right > 0), gain, 0.0).transpose(1, 0, 2).reshape(len(nodes), -1)
    most = gain.max(1)
    feature, cut = np.divmod((gain >= most[:, None] * (1 - ties)).argmax(1), left.shape[2])
    found = most > 0
    feature = np.where(found, feature, 0)

    def mean(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        counts, sums = counts[feature, nodes, cut], sums[feature, nodes, cut]
        return np.divide(sums, counts, out=np.zeros(len(nodes)), where=counts > 0)
    own = np.divide(s, n, out=np.zeros(len(nodes)), where=n > 0)
    means = np.stack([np.where(found, mean(left_sum, left), own), np.where(found, mean(right_sum, right), own)], 1)
    return feature, np.where(found, cut, 255), means


def children(parents: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Slots of the next level's nodes: of each two children the one with fewer rows has its parent's number, the other -1."""
    count = parents[0]
    nodes = np.arange(count.shape[1])
    reached = np.concatenate([count, np.zeros((*count.shape[:2], 256 - count.shape[2]))], 2).cumsum(2)
    left = reached[feature, nodes, cut]
    smaller = (reached[0, :, -1] < 2 * left).astype(int)
    slots = np.full(2 * len(nodes), -1)
    slots[2 * nodes + smaller] = nodes
    return slots


def next_level(parents: np.ndarray, slots: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Histograms of both children of every parent from those that were counted."""
    out = np.empty((*parents.shape[:2], len(slots), parents.shape[3]))
    own = np.flatnonzero(slots >= 0)
    out[:, :, own] = counted
    out[:, :, own ^ 1] = parents - counted
    out[1][out[0] == 0] = 0.0  # what is left of a difference of equal sums
    return out


def grow(count: Callable[[Tree, int, np.ndarray], np.ndarray], max_depth: int, ties: float = 0.0) -> Tree:
    """One tree, a pass a level: ``count`` has the histograms of (the tree so far, the level, its slots)."""
    size = (1 << max_depth) - 1
    tree = Tree(np.zeros(size, np.intp), np.full(size, 255), np.zeros(size + 1))
    slots, level, means = np.zeros(1, np.intp), None, None
    for depth in range(max_depth):
        counted = count(tree, depth, slots)
        level = counted if level is None else next_level(level, slots, counted)
        feature, cut, means = best_splits(level, ties)
        places = slice((1 << depth) - 1, (2 << depth) - 1)
        tree.feature[places], tree.cut[places] = feature, cut
        slots = children(level, feature, cut)
    tree.leaf[:] = means.ravel()
    return tree


def grow_in_jobs(blocks: RDD, max_depth: int, width: int, ties: float = 0.0) -> Tree:
    """One tree over the residuals of ``blocks``, a job a pass."""
    merges = 2 if blocks.getNumPartitions() > DIRECT_TASKS else 1
    return grow(lambda tree, depth, slots: blocks.mapPartitions(lambda it: histograms(it, tree, depth, slots, width)).treeReduce(np.add, merges), max_depth, ties)


def without(blocks: Iterator[Block], tree: Tree, step_size: float, first: bool, leaves: list[np.ndarray] | None = None) -> Iterator[Block]:
    """The blocks with the tree's share taken off: of the first tree's labels twice the residuals are left."""
    for k, (bins, target, *weights) in enumerate(blocks):
        value = tree.leaf.take(route(bins, tree, tree.depth) if leaves is None else leaves[k])
        yield bins, 2.0 * (target - value) if first else target - 2.0 * step_size * value, *weights


def grow_alone(blocks: Iterator[Block], max_iter: int, step_size: float, max_depth: int, width: int) -> Iterator[Tree]:
    """All trees over the blocks, held in this process with the nodes that their rows have come to."""
    held = [*blocks]

    def down(tree: Tree, depth: int, nodes: list[np.ndarray]) -> None:
        nodes[:] = [route(block[0], tree, depth, above) for block, above in zip(held, nodes or [None] * len(held), strict=True)]

    for k in range(max_iter):
        nodes: list[np.ndarray] = []

        def count(tree: Tree, depth: int, slots: np.ndarray, nodes: list[np.ndarray] = nodes) -> np.ndarray:
            down(tree, depth, nodes)
            return next(histograms(iter(held), tree, depth, slots, width, nodes))
        tree = grow(count, max_depth, TIES)
        yield tree
        down(tree, max_depth, nodes)
        held = [*without(iter(held), tree, step_size, not k, nodes)]


@dataclass
class BoostedTrees:
    """A fitted model; ``transform`` adds ``prediction``."""
    inputs: list[str]
    splits: list[np.ndarray]
    step_size: float
    trees: list[Tree] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        model = df.sparkSession.sparkContext.broadcast((self.splits, self.step_size, self.trees))

        @F.pandas_udf("double")
        def score(rows: pd.DataFrame) -> pd.Series:
            splits, step_size, trees = model.value
            out = np.zeros(len(rows))
            for at in range(0, len(rows), BLOCK_ROWS):
                part = rows.iloc[at:at + BLOCK_ROWS]
                bins = bins_of([part[c].to_numpy(float) for c in part.columns], splits)
                for k, tree in enumerate(trees):
                    out[at:at + BLOCK_ROWS] += (step_size if k else 1.0) * tree.leaf.take(route(bins, tree, tree.depth))
            return pd.Series(out)
        return df.withColumn("prediction", score(F.struct(*[F.col(c).cast("double").alias(c) for c in self.inputs])))

    def place(self, columns: list[str]) -> Column:
        """The bins of these inputs (seven at most) as one number, a byte each: alike in it, rows are alike to the model."""
        splits = [self.splits[self.inputs.index(c)] for c in columns]

        @F.pandas_udf("long")
        def number(rows: pd.DataFrame) -> pd.Series:
            bins = bins_of([rows[c].to_numpy(float) for c in rows.columns], splits)
            return pd.Series(sum(b.astype(np.int64) << 8 * k for k, b in enumerate(bins)), dtype="int64")
        return number(F.struct(*[F.col(c).cast("double").alias(c) for c in columns]))

    def values_at(self, place: str, columns: list[str]) -> list[Column]:
        """Values of these inputs that lie in the bins of a ``place``."""
        out = []
        for k, c in enumerate(columns):
            points = self.splits[self.inputs.index(c)].tolist()
            inside = F.array(*[F.lit(v) for v in [*points, points[-1] + 1.0 if points else 0.0]])
            out.append(F.get(inside, F.shiftright(place, 8 * k).bitwiseAND(255).cast("int")).alias(c))
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the model under ``path``, from where ``load`` has it again, number for number."""
        text = json.dumps({"inputs": self.inputs, "splits": [s.tolist() for s in self.splits], "step_size": self.step_size,
                           "trees": [[t.feature.tolist(), t.cut.tolist(), t.leaf.tolist()] for t in self.trees]})
        spark.createDataFrame([(text,)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        kept = json.loads(spark.read.parquet(path).first()["model"])
        trees = [Tree(np.asarray(f, np.intp), np.asarray(c), np.asarray(leaf, float)) for f, c, leaf in kept["trees"]]
        return cls(kept["inputs"], [np.asarray(s, float) for s in kept["splits"]], kept["step_size"], trees)


def words(inputs: list[str]) -> list[str]:
    """The columns that hold a row's bins, eight features to one."""
    return [f"bins_{k}" for k in range(-(-len(inputs) // 8))]


def distinct(rows: DataFrame, inputs: list[str], splits: dict[str, list[float]]) -> DataFrame:
    """A row for all that are alike in all bins: the bins as ``words``, a byte per feature, their mean ``label`` and their
    number as ``weight``. Rows without a label are left out."""
    points, taken = [np.asarray(splits[c], float) for c in inputs], words(inputs)

    def code(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bins = np.zeros((len(part), 8 * len(taken)), np.uint8)
            bins[:, :len(inputs)] = bins_of([part[c].to_numpy(float) for c in inputs], points).T
            yield pd.DataFrame(bins.view(np.int64), columns=taken).assign(label=part["label"].to_numpy(float))

    labelled = rows.where(F.col("label").isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in inputs], "label")
    coded = labelled.mapInPandas(code, ", ".join(f"{w} long" for w in taken) + ", label double")
    return coded.groupBy(*taken).agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))


def binned(rows: DataFrame, inputs: list[str], splits: list[np.ndarray], tasks: int) -> RDD:
    """(bins, label, weight) of every row in blocks of up to ``BLOCK_ROWS``, dealt over ``tasks`` partitions. ``rows`` hold
    the inputs, or else their bins and weights (``distinct``)."""
    features, taken = len(inputs), words(inputs)
    weighted = taken[0] in rows.columns

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            label = part["label"].to_numpy(float)
            if np.isnan(label).any():
                raise ValueError("labels must not be null or NaN")
            if weighted:
                bins = np.ascontiguousarray(part[taken].to_numpy(np.int64)).view(np.uint8)[:, :features].T
            else:
                bins = bins_of([part[c].to_numpy(float) for c in inputs], splits)
            cuts = range(0, len(label), BLOCK_ROWS)
            yield pd.DataFrame({"bins": [bins[:, k:k + BLOCK_ROWS].tobytes() for k in cuts]} | {
                c: [v[k:k + BLOCK_ROWS].tobytes() for k in cuts] for c, v in [("target", label), *([("weight", part["weight"].to_numpy(float))] if weighted else [])]})

    own = [*taken, "label", "weight"] if weighted else [*[F.col(c).cast("double").alias(c) for c in inputs], "label"]
    packed = cut_lineage(rows.select(*own).repartition(tasks).mapInPandas(pack, f"{BLOCKS}, weight binary" if weighted else BLOCKS))
    return packed.rdd.map(lambda r: (np.frombuffer(r[0], np.uint8).reshape(features, -1), *[np.frombuffer(x) for x in r[1:]]))


def fit(rows: DataFrame, inputs: list[str], splits: dict[str, list[float]], count: int, step_size: float,
        max_iter: int, max_depth: int) -> BoostedTrees:
    """``max_iter`` trees over ``rows`` (the inputs and ``label``, or what ``distinct`` makes of them; ``count`` rows) with
    the given split points."""
    context = rows.sparkSession.sparkContext
    points = [np.asarray(splits[c], float) for c in inputs]
    width = max(2, 1 + max(len(p) for p in points))
    model = BoostedTrees(list(inputs), points, step_size)
    cores = context.defaultParallelism
    blocks = binned(rows, inputs, points, cores * max(1, -(-count // (TASK_ROWS * cores))))
    weighted = words(inputs)[0] in rows.columns
    if weighted and count <= ALONE_ROWS:
        model.trees.extend(blocks.coalesce(1).mapPartitions(lambda it: grow_alone(it, max_iter, step_size, max_depth, width)).collect())
        return model
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    before = None
    for k in range(max_iter):
        tree = grow_in_jobs(blocks, max_depth, width, TIES if weighted else 0.0)
        model.trees.append(tree)
        if before is not None:
            before.unpersist()  # its residuals made those of the tree just grown
        before, blocks = blocks, blocks.mapPartitions(lambda it, t=tree, first=not k: without(it, t, step_size, first)).persist(StorageLevel.MEMORY_AND_DISK)
        if (k + 1) % CHECKPOINT_TREES == 0:
            blocks.checkpoint()
    before.unpersist()
    return model
