"""Random forests on rows of equal bins, all trees one level a job.

Columns are cut into quantile bins, and rows that fall into the same bins under one label and
weight become one row with its number. How often a tree draws a row is Poisson with mean 1, so
how often it draws n equal rows is Poisson with mean n: the forest is of the same kind as one
fitted on the rows themselves. The rows lie in blocks, and a tree's draws from a block are
fixed by the seed, the tree and the block, so every level and every retry sees the same ones.
A level's job counts each tree's open nodes in every task, one tree at a time, adds the
tasks' counts up by tree and run of nodes, and gives the driver the best splits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.functions.scoring import PROBABILITIES
from auditlens.operators.boosting import bin_edges, collapsed
from auditlens.session import materialise

BINS = 32
#: Rows of a block, which a tree's draws are made for at once.
BLOCK_ROWS = 65_536
#: Rows that a task of its own is worth.
LEAST_ROWS = 4_096
#: Open nodes of a tree whose counts travel as one row.
NODES = 128
#: Nodes (row by tree) that scoring holds at a time.
AT_ONCE = 500_000


# --- trees ----------------------------------------------------------------------------------


@dataclass
class Stats:
    """Weights by class."""

    weights: list[float]

    def stats(self) -> list[float]:
        return self.weights

    def count(self) -> float:
        return float(sum(self.weights))


@dataclass
class Split:
    feature: int
    value: float

    def featureIndex(self) -> int:
        return self.feature

    def threshold(self) -> float:
        return self.value


@dataclass
class Node:
    """A node under the names that nodes of Spark's trees have, so that readers take both."""

    tree: Tree
    at: int

    def subtreeDepth(self) -> int:
        if self.tree.feature[self.at] < 0:
            return 0
        return 1 + max(self.leftChild().subtreeDepth(), self.rightChild().subtreeDepth())

    def impurityStats(self) -> Stats:
        return Stats(self.tree.stats[self.at])

    def split(self) -> Split:
        return Split(self.tree.feature[self.at], self.tree.threshold[self.at])

    def leftChild(self) -> Node:
        return Node(self.tree, self.tree.left[self.at])

    def rightChild(self) -> Node:
        return Node(self.tree, self.tree.right[self.at])


TREES = (
    "number int, feature array<int>, threshold array<double>, left array<int>, "
    "right array<int>, stats array<array<double>>"
)


@dataclass
class Tree:
    """Nodes in lists, the root first; leaves have the feature -1. A value at a threshold goes left."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    stats: list[list[float]]

    def rootNode(self) -> Node:
        return Node(self, 0)

    def _call_java(self, name: str):
        """As models of Spark are asked."""
        return getattr(self, name)()


@dataclass
class Forest:
    trees: list[Tree]
    _flat: tuple | None = field(default=None, repr=False, compare=False)

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    @property
    def numClasses(self) -> int:
        return len(self.trees[0].stats[0])

    def _nodes(self) -> tuple:
        """All trees' nodes in one numbering, thresholds as places among a column's; once a worker."""
        if self._flat is None:
            feature = np.concatenate([np.array(t.feature, np.int64) for t in self.trees])
            threshold = np.concatenate([np.array(t.threshold, np.float64) for t in self.trees])
            sizes = [len(t.feature) for t in self.trees]
            roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            here = np.arange(len(feature))
            first = np.repeat(roots, sizes)
            sides = [
                np.where(feature < 0, here, first + np.concatenate([getattr(t, side) for t in self.trees]))
                for side in ("left", "right")
            ]
            cuts = {int(f): np.unique(threshold[feature == f]) for f in np.unique(feature[feature >= 0])}
            column, cut = np.zeros(len(feature), np.int64), np.zeros(len(feature), np.int64)
            for i, f in enumerate(cuts):
                own = feature == f
                column[own], cut[own] = i, np.searchsorted(cuts[f], threshold[own])
            stats = np.concatenate([np.array(t.stats, np.float64) for t in self.trees])
            share = stats / stats.sum(axis=1, keepdims=True)
            depth = max(t.rootNode().subtreeDepth() for t in self.trees)
            self._flat = roots, column, cut, sides, share, cuts, depth
        return self._flat

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Row by class: the mean of the trees' class shares. Rows no threshold tells apart are one."""
        roots, column, cut, (left, right), share, cuts, depth = self._nodes()
        if not cuts or not len(x):
            return np.repeat(share[roots].mean(axis=0)[None], len(x), axis=0)
        codes = np.column_stack([np.searchsorted(c, x[:, f]) for f, c in cuts.items()]).astype(np.uint16)
        same = codes.view(np.dtype((np.void, codes.dtype.itemsize * codes.shape[1]))).ravel()
        _, first, where = np.unique(same, return_index=True, return_inverse=True)
        codes = codes[first]
        out = np.empty((len(codes), share.shape[1]))
        step = max(1, AT_ONCE // len(roots))
        for i in range(0, len(codes), step):
            part = codes[i : i + step]
            node = np.repeat(roots[None], len(part), axis=0)
            rows = np.arange(len(part))[:, None]
            for _ in range(depth):
                node = np.where(part[rows, column[node]] <= cut[node], left[node], right[node])
            out[i : i + step] = share[node].mean(axis=1)
        return out[where.ravel()]


@dataclass
class ForestModel:
    """A fitted forest over named columns."""

    model: Forest
    columns: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.model)

        @F.pandas_udf("array<double>")
        def applied(*values: pd.Series) -> pd.Series:
            x = np.column_stack([v.to_numpy(np.float64) for v in values])
            return pd.Series(list(shared.value.shares(x)))

        scored = df.withColumn("_p", applied(*[F.col(f"`{c}`") for c in self.columns]))
        share = [
            F.col("_p")[c] if c < self.model.numClasses else F.lit(0.0)
            for c in range(len(PROBABILITIES))
        ]
        every = F.struct(*[s.alias(p) for s, p in zip(share, PROBABILITIES, strict=True)])
        return scored.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(every)))

    def save(self, path: str) -> None:
        rows = [
            (i, t.feature, t.threshold, t.left, t.right, t.stats)
            for i, t in enumerate(self.model.trees)
        ]
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(rows, TREES).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, columns: list[str]) -> ForestModel:
        rows = spark.read.parquet(path).orderBy("number").collect()
        trees = [Tree(r.feature, r.threshold, r.left, r.right, r.stats) for r in rows]
        return cls(Forest(trees), columns)


# --- blocks ---------------------------------------------------------------------------------

BLOCKS = "block long, codes binary, label binary, weight binary, n binary"


def blocks(table: DataFrame) -> DataFrame:
    """The rows of `collapsed` in blocks, one a row, written down: a block stays as it is."""
    cells = table.select("code", F.inline("cells")).filter("label IS NOT NULL AND weight > 0")
    rows = cells.count()
    if not rows:
        raise ValueError("a forest needs rows that have a label and a weight")
    slots = min(table.sparkSession.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS))
    parts = max(slots, -(-rows // BLOCK_ROWS))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [*batches]
        if not own:
            return
        every = pd.concat(own).sort_values(["code", "label", "weight"])
        first = TaskContext.get().partitionId() << 20
        for i in range(0, len(every), BLOCK_ROWS):
            some = every.iloc[i : i + BLOCK_ROWS]
            yield pd.DataFrame({
                "block": [first + i // BLOCK_ROWS],
                "codes": [b"".join(some["code"])],
                "label": [some["label"].to_numpy(np.uint8).tobytes()],
                "weight": [some["weight"].to_numpy(np.float64).tobytes()],
                "n": [some["n"].to_numpy(np.int64).tobytes()],
            })

    even = cells.select("code", "label", "weight", "n").repartition(parts, "code", "label", "weight")
    return materialise(even.mapInPandas(pack, BLOCKS), "blocks")


@dataclass
class Block:
    number: int
    codes: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, row, columns: int) -> Block:
        return cls(
            int(row.block),
            np.frombuffer(row.codes, np.uint8).reshape(-1, columns),
            np.frombuffer(row.label, np.uint8).astype(np.int64),
            np.frombuffer(row.weight, np.float64),
            np.frombuffer(row.n, np.int64),
        )


# --- growth ---------------------------------------------------------------------------------


@dataclass
class Growing:
    """A tree while it grows; `open` are the nodes that the next level may split, `taken` by open
    node the columns it may split on."""

    number: int
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    stats: list = field(default_factory=lambda: [None])
    open: list[int] = field(default_factory=lambda: [0])
    taken: np.ndarray | None = None

    def split(self, node: int, column: int, cut: int, sides: list[np.ndarray], last: bool) -> None:
        """Children of one class, and those of the last level, stay leaves."""
        self.feature[node], self.cut[node] = column, cut
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for stats in sides:
            child = len(self.feature)
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(child)
            self.right.append(child)
            self.stats.append(stats)
            if not last and np.count_nonzero(stats) > 1:
                self.open.append(child)

    def finished(self, edges: list[list[float]]) -> Tree:
        """The tree in order from the root; two leaves that answer the same are one, as in Spark's."""
        merged = list(self.feature)
        for node in reversed(range(len(merged))):  # children come after their parents
            if merged[node] >= 0:
                a, b = self.left[node], self.right[node]
                if merged[a] < 0 and merged[b] < 0 and np.argmax(self.stats[a]) == np.argmax(self.stats[b]):
                    merged[node] = -1
        kept = [0]
        for node in kept:
            if merged[node] >= 0:
                kept += [self.left[node], self.right[node]]
        place = {node: i for i, node in enumerate(kept)}
        inner = [merged[node] >= 0 for node in kept]
        return Tree(
            [merged[node] for node in kept],
            [edges[merged[n]][self.cut[n]] if i else 0.0 for n, i in zip(kept, inner)],
            [place[self.left[n]] if i else -1 for n, i in zip(kept, inner)],
            [place[self.right[n]] if i else -1 for n, i in zip(kept, inner)],
            [[float(v) for v in self.stats[node]] for node in kept],
        )


def count_nodes(
    tree: Growing, rows: list[Block], seed: int, widest: int, classes: int
) -> np.ndarray:
    """Weights that the tree drew by (open node, taken column, bin, class)."""
    feature, cut, left, right = map(np.array, (tree.feature, tree.cut, tree.left, tree.right))
    slot = np.full(len(feature), -1)
    slot[tree.open] = np.arange(len(tree.open))
    stays = (feature < 0) & (slot < 0)
    nodes, tries = tree.taken.shape
    size = widest * classes
    out = np.zeros(nodes * tries * size)
    for block in rows:
        drawn = np.random.default_rng([seed, tree.number, block.number]).poisson(block.n)
        at = np.flatnonzero(drawn)
        flat, columns = block.codes.ravel(), block.codes.shape[1]
        node = np.zeros(len(at), np.int64)
        going = feature[node] >= 0
        while going.any():
            code = flat[at * columns + feature[node]]
            # an open node, on whatever level, has no column and leads to itself
            node = np.where(going & (code > cut[node]), right[node], left[node])
            live = ~stays[node]
            at, node = at[live], node[live]
            going = feature[node] >= 0
        where = slot[node]
        weight, label, start = drawn[at] * block.weight[at], block.label[at], at * columns
        for j in range(tries):
            code = flat[start + tree.taken[where, j]].astype(np.int64)
            key = ((where * tries + j) * widest + code) * classes + label
            out += np.bincount(key, weight, len(out))
    return out.reshape(nodes, tries, widest, classes)


def best_splits(
    counts: np.ndarray, taken: np.ndarray, sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By node the column of least Gini impurity after the split, or -1; its bin; both sides' weights.

    Of equal gains the first of the node's columns and bins wins.
    """
    left = np.cumsum(counts, axis=2)
    right = np.zeros_like(counts)  # not total less left: nothing must be exactly nothing
    right[:, :, :-1] = np.cumsum(counts[:, :, :0:-1], axis=2)[:, :, ::-1]
    weight = [side.sum(axis=3) for side in (left, right)]
    total = left[:, :1, -1:]
    whole = total.sum(axis=3)
    with np.errstate(divide="ignore", invalid="ignore"):
        after = (left**2).sum(axis=3) / weight[0] + (right**2).sum(axis=3) / weight[1]
        gain = np.round((after - (total**2).sum(axis=3) / whole) / whole, 12)
    good = (weight[0] > 0) & (weight[1] > 0) & (np.arange(counts.shape[2]) < sizes[taken][:, :, None] - 1)
    gain = np.where(good & (gain > 0), gain, -np.inf).reshape(len(counts), -1)
    at = gain.argmax(axis=1)
    node = np.arange(len(counts))
    j, place = at // counts.shape[2], at % counts.shape[2]
    column = np.where(np.isfinite(gain[node, at]), taken[node, j], -1)
    return column, place, left[node, j, place], right[node, j, place]


SUMS = "tree int, run int, first long, sums binary"
SPLITS = "tree int, node int, feature int, cut int, to_left array<double>, to_right array<double>"


def _counting(shared, sizes: np.ndarray, classes: int, seed: int) -> Callable:
    """A task's counts of all trees, in runs of nodes; only the bins that a column has are sent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [Block.of(r, len(sizes)) for batch in batches for r in batch.itertuples()]
        if not rows:
            return
        rows.sort(key=lambda b: b.number)
        widest = int(sizes.max())
        for tree in shared.value:
            counts = count_nodes(tree, rows, seed, widest, classes)
            has = np.arange(widest) < sizes[tree.taken][:, :, None]
            runs = range(0, len(tree.open), NODES)
            yield pd.DataFrame({
                "tree": tree.number,
                "run": [i // NODES for i in runs],
                "first": rows[0].number,
                "sums": [counts[i : i + NODES][has[i : i + NODES]].tobytes() for i in runs],
            })

    return run


def _splitting(shared, sizes: np.ndarray, classes: int) -> Callable:
    """Adds the tasks' counts of a run of nodes up, in one order, and finds its splits."""

    def run(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        tree = next(t for t in shared.value if t.number == key[0])
        nodes = slice(key[1] * NODES, (key[1] + 1) * NODES)
        taken = tree.taken[nodes]
        has = np.arange(int(sizes.max())) < sizes[taken][:, :, None]
        counts = np.zeros((*has.shape, classes))
        for sums in parts.sort_values("first")["sums"]:
            counts[has] += np.frombuffer(sums, np.float64).reshape(-1, classes)
        column, place, left, right = best_splits(counts, taken, sizes)
        return pd.DataFrame({
            "tree": key[0], "node": tree.open[nodes], "feature": column, "cut": place,
            "to_left": list(left), "to_right": list(right),
        })

    return run


def fit(
    df: DataFrame, columns: list[str], trees: int, depth: int, seed: int, bins: int = BINS
) -> ForestModel:
    """A forest of df's columns, label and weight: Gini impurity, and at every node as many
    columns as the square root of their number (a single tree: all)."""
    spark = df.sparkSession
    edges = bin_edges(df, columns, bins)
    sizes = np.array([len(e) + 1 for e in edges])
    table = materialise(collapsed(df.withColumn("fold", F.lit(0)), columns, edges), "collapsed")
    held = blocks(table)
    labels = table.select(F.inline("cells")).filter("weight > 0")
    sums = {
        r.label: r.total
        for r in labels.groupBy("label").agg(F.sum(F.col("weight") * F.col("n")).alias("total")).collect()
        if r.label is not None
    }
    classes = max(sums) + 1
    tries = len(columns) if trees == 1 else math.ceil(math.sqrt(len(columns)))
    rng = np.random.default_rng(seed)
    grown = [Growing(i) for i in range(trees)]
    for tree in grown:
        # what a tree that is never split answers
        tree.stats[0] = np.array([sums.get(c, 0.0) for c in range(classes)])
    for level in range(depth):
        active = [t for t in grown if t.open]
        if not active:
            break
        for tree in active:
            order = rng.random((len(tree.open), len(columns))).argsort(axis=1)
            tree.taken = np.sort(order[:, :tries], axis=1)
        shared = spark.sparkContext.broadcast(active)
        counted = held.mapInPandas(_counting(shared, sizes, classes, seed), SUMS)
        found = counted.groupBy("tree", "run").applyInPandas(_splitting(shared, sizes, classes), SPLITS)
        for tree in active:
            tree.open = []
        for r in sorted(found.collect(), key=lambda r: (r.tree, r.node)):
            if r.feature >= 0:
                sides = [np.array(r.to_left), np.array(r.to_right)]
                if level == 0:
                    grown[r.tree].stats[0] = sides[0] + sides[1]
                grown[r.tree].split(r.node, r.feature, r.cut, sides, level == depth - 1)
        shared.unpersist()
    return ForestModel(Forest([t.finished(edges) for t in grown]), columns)
