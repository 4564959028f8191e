"""Boosted trees on histograms: softmax trees grown by best leaf, and stumps with votes.

Columns are cut into quantile bins once, and rows that fall into the same bins become one row
with its counts by label, fold and weight, so every fold and every arm of a comparison is fitted
on one small table. A fit is one Spark job whose tasks hold a part of that table each and keep
their rows' margins; what they exchange are histograms of gradients by (class, node, bin), summed
over the tasks once a level for all classes. All tasks then make the same splits. The exchange
uses a barrier stage, which Spark runs anew as a whole if one of its tasks is lost.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext, inheritable_thread_target
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.scoring import PROBABILITIES
from auditlens.operators import balance
from auditlens.session import materialise

CLASSES = len(K.CLASS_IDS)
BINS = 64
#: Rows of the collapsed table that a task is given at most. Fewer make a fit slower: an exchange
#: between tasks takes a second, and a round has one for each level.
MOST_ROWS = 1_500_000
#: Joint values that columns counted together have at most.
MOST_JOINT = 1024
#: Joint values that two groups of columns are looked for at most, and rows a joint value that make
#: counting both together pay.
MOST_PAIRED = 4_000_000
LEAST_SHARED = 3


@dataclass(frozen=True)
class Growth:
    """How trees are grown. depth None: by the best leaf alone."""

    rounds: int = 300
    step: float = 0.03
    leaves: int = 15
    depth: int | None = None
    l1: float = 0.1
    l2: float = 1.0
    least_rows: int = 5
    least_hessian: float = 1e-3


# --- bins ---------------------------------------------------------------------------------


def bin_edges(df: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """Per column the ascending thresholds a split may have; a value at one goes left.

    Columns of few values have all of them, others quantiles. Both are bounded by `bins`.
    """
    shares = [i / bins for i in range(1, bins)]
    probe = df.agg(
        *[F.approx_count_distinct(c).alias(f"n_{c}") for c in columns],
        *[F.max(c).alias(f"max_{c}") for c in columns],
    ).first()
    few = [c for c in columns if probe[f"n_{c}"] <= bins]
    known = df.agg(
        *[F.collect_set(c).alias(c) for c in few],
        *[F.percentile_approx(c, shares, 20 * bins).alias(c) for c in columns if c not in few],
    ).first()
    return [sorted({float(v) for v in known[c] or () if v < probe[f"max_{c}"]}) for c in columns]


def collapsed(df: DataFrame, columns: list[str], edges: list[list[float]]) -> DataFrame:
    """code (one byte a column), cells (label, fold, weight, n): rows of equal bins as one.

    df: the columns, label, fold and weight. Rows are collapsed once a batch and then merged.
    """
    cuts = [np.array(e) for e in edges]

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            code = np.empty((len(batch), len(columns)), np.uint8)
            for i, c in enumerate(columns):
                code[:, i] = np.searchsorted(cuts[i], batch[c].to_numpy(np.float64))
            rest = batch[["label", "fold", "weight"]]
            rest = rest.assign(code=[row.tobytes() for row in code])
            yield rest.groupby(["code", "label", "fold", "weight"], as_index=False).size()

    narrow = df.select(
        *[F.col(c).cast("double").alias(c) for c in columns],
        F.col("label").cast("int").alias("label"),
        F.col("fold").cast("int").alias("fold"),
        F.col("weight").cast("double").alias("weight"),
    )
    schema = "code binary, label int, fold int, weight double, size long"
    return (
        narrow.mapInPandas(binned, schema)
        .groupBy("code", "label", "fold", "weight")
        .agg(F.sum("size").alias("n"))
        .groupBy("code")
        .agg(F.array_sort(F.collect_list(F.struct("label", "fold", "weight", "n"))).alias("cells"))
    )


# --- the exchange -------------------------------------------------------------------------


def _summed(alone: bool) -> Callable[[np.ndarray], np.ndarray] | None:
    """Adds up an array over the tasks of a fit, in the order of the tasks; None for one task."""
    if alone:
        return None

    context = BarrierTaskContext.get()

    def add(own: np.ndarray) -> np.ndarray:
        sent = context.allGather(base64.b64encode(own.astype("<f8").tobytes()).decode())
        total = np.zeros(own.size)
        for part in sent:
            total += np.frombuffer(base64.b64decode(part), "<f8")
        return total.reshape(own.shape)

    return add


class Together:
    """Columns that few values of are seen together: rows are counted by the joint value."""

    def __init__(self, rows: int):
        self.columns: list[int] = []
        self.key = np.zeros(rows, np.int64)
        self.values = 1

    def joined(self, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Joint values with one more column, and which of them there are."""
        key = self.key * size + codes
        return key, np.bincount(key, minlength=self.values * size) > 0

    def take(self, column: int, key: np.ndarray, there: np.ndarray) -> None:
        self.columns.append(column)
        self.key = (np.cumsum(there) - 1)[key]
        self.values = int(there.sum())

    def finish(self, codes: np.ndarray, sizes: list[int], first: np.ndarray) -> None:
        """Which bin of each column a joint value has: joint value by bin."""
        self.bins = np.concatenate([first[c] + np.arange(sizes[c]) for c in self.columns])
        one = np.zeros(self.values, np.int64)
        one[self.key] = np.arange(len(self.key))  # a row of each joint value
        of_bin = np.empty(int(sum(sizes)), np.int64)
        of_bin[self.bins] = np.arange(len(self.bins))
        self.has = np.zeros((self.values, len(self.bins)))
        if len(self.key):
            for c in self.columns:
                self.has[np.arange(self.values), of_bin[first[c] + codes[one, c]]] = 1.0


class Pair:
    """Two groups of columns that large nodes are counted by together, and then by each."""

    def __init__(self, one: Together, other: Together):
        both = one.key * other.values + other.key
        there = np.bincount(both, minlength=one.values * other.values) > 0
        self.key = (np.cumsum(there) - 1)[both]
        joint = np.flatnonzero(there)
        self.values = len(joint)
        self.groups = [(one, joint // other.values), (other, joint % other.values)]


class Part:
    """A task's rows, of which no two have the same bins.

    Columns are counted by their joint values, as many columns together as have few of them,
    so that a row is added once a group of columns and not once a column.
    """

    def __init__(self, rows: pd.DataFrame, sizes: list[int], add: Callable):
        codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(-1, len(sizes))
        self.n = rows["n"].to_numpy(np.float64)
        #: Weights of the rows by class: what is there of a label.
        self.of_label = np.array([rows[f"w{c}"].to_numpy(np.float64) for c in range(CLASSES)])
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.bins = int(sum(sizes))
        self.column = np.repeat(np.arange(len(sizes)), sizes)
        # a column with the codes of an earlier one can make no other splits
        differ = np.ones((len(sizes), len(sizes)))
        #: The codes column by column.
        self.across = across = np.ascontiguousarray(codes.T)
        for i in range(len(sizes)):
            for j in range(i):
                differ[i, j] = (across[i] != across[j]).any()
        again = (add(differ) == 0).any(axis=1)
        self.groups: list[Together] = []
        for c in sorted(np.flatnonzero(~again), key=lambda c: sizes[c]):
            for group in [*self.groups, Together(len(self.n))]:
                key, there = group.joined(across[c], sizes[c])
                if not group.columns or there.sum() <= MOST_JOINT:
                    break
            if not group.columns:
                self.groups.append(group)
            group.take(int(c), key, there)
        for group in self.groups:
            group.finish(codes, sizes, self.first)
        #: Groups in twos, the first with the last, that the rows have few joint values of.
        self.pairs: list[Pair] = []
        for i in range(len(self.groups) // 2):
            one, other = self.groups[i], self.groups[-1 - i]
            if one.values * other.values <= MOST_PAIRED:
                pair = Pair(one, other)
                if LEAST_SHARED * pair.values <= len(self.n):
                    self.pairs.append(pair)
        last = np.zeros(self.bins, bool)
        last[self.first + np.array(sizes) - 1] = True
        # a column's last bin has nothing on its right
        self.splits = ~last & ~again[self.column]
        #: The numbers of rows by bin, which every tree's root has.
        self.rows = self.histograms([None], [self.n])

    def histogram(self, slot: np.ndarray, slots: int, values: list[np.ndarray]) -> np.ndarray:
        """Sums of values by (slot, bin); rows in slot -1 are left out."""
        return self.histograms([np.flatnonzero(slot == i) for i in range(slots)], values)

    def histograms(self, nodes: list[np.ndarray | None], values: list[np.ndarray]) -> np.ndarray:
        """Sums of values by (node, bin); a node is its rows' places, None all rows.

        Only the nodes' rows are read. Columns that repeat an earlier one have no sums.
        """
        taken = [values if at is None else [v.take(at) for v in values] for at in nodes]
        found = np.zeros((len(values), len(nodes), self.bins))
        joint = {id(g): np.empty((len(values), len(nodes), g.values)) for g in self.groups}
        for i, at in enumerate(nodes):
            size = len(self.n) if at is None else len(at)
            done = set()
            for pair in self.pairs:
                if size >= LEAST_SHARED * pair.values:
                    key = pair.key if at is None else pair.key.take(at)
                    for j, v in enumerate(taken[i]):
                        sums = np.bincount(key, v, pair.values)
                        for group, of in pair.groups:
                            joint[id(group)][j, i] = np.bincount(of, sums, group.values)
                    done.update(id(group) for group, _ in pair.groups)
            for group in self.groups:
                if id(group) not in done:
                    key = group.key if at is None else group.key.take(at)
                    for j, v in enumerate(taken[i]):
                        joint[id(group)][j, i] = np.bincount(key, v, group.values)
        for group in self.groups:
            sums = joint[id(group)].reshape(-1, group.values) @ group.has
            found[:, :, group.bins] = sums.reshape(len(values), len(nodes), -1)
        return found

    def left(self, sums: np.ndarray) -> np.ndarray:
        """For every bin, the sums of its column's bins up to it."""
        running = np.cumsum(sums, axis=-1)
        before = running[..., self.first] - sums[..., self.first]
        return running - before[..., self.column]


# --- trees --------------------------------------------------------------------------------


class Tree:
    """One class's tree while it grows. Nodes are numbered as they are made.

    A node that was not split has its rows' places, in order; None are all rows.
    """

    def __init__(self):
        self.at: list[np.ndarray | None] = [None]
        self.bin, self.gain, self.left, self.right = [-1], [-np.inf], [-1], [-1]
        self.depth, self.sums = [0], [np.zeros(3)]
        self.histogram: list[np.ndarray | None] = [None]
        self.new = self.counted = [0]

    def chosen(self, leaves: int) -> tuple[list[int], list[int]]:
        """The splits that growing by the best leaf takes, as far as gains are known."""
        at, inner = [0], []
        while at and len(inner) + 1 < leaves:
            node = max(at, key=lambda i: (self.gain[i], -i))
            if self.gain[node] <= 0:
                break
            inner.append(node)
            at.remove(node)
            if self.left[node] >= 0:
                at += [self.left[node], self.right[node]]
        return inner, at

    def expand(self, nodes: list[int], part: Part) -> None:
        made = len(self.bin)
        for node in nodes:
            self.left[node], self.right[node] = len(self.bin), len(self.bin) + 1
            for _ in range(2):
                self.bin.append(-1)
                self.gain.append(-np.inf)
                self.left.append(-1)
                self.right.append(-1)
                self.depth.append(self.depth[node] + 1)
                self.sums.append(np.zeros(3))
                self.histogram.append(None)
                self.at.append(None)
        for node in nodes:
            column = part.column[self.bin[node]]
            rows, codes = self.at[node], part.across[column]
            goes_left = (codes if rows is None else codes.take(rows)) <= (
                self.bin[node] - part.first[column]
            )
            sides = np.flatnonzero(goes_left), np.flatnonzero(~goes_left)
            if rows is not None:
                sides = [rows.take(side) for side in sides]
            self.at[self.left[node]], self.at[self.right[node]] = sides
            self.at[node] = None
        self.new = list(range(made, len(self.bin)))
        self.counted = []
        for node in nodes:
            rows_left = part.left(self.histogram[node][2])[self.bin[node]]
            fewer_left = 2 * rows_left <= self.sums[node][2]
            self.counted.append(self.left[node] if fewer_left else self.right[node])

    def to_count(self) -> list[np.ndarray | None]:
        """Rows of the new nodes that are counted; their siblings are what is left of the parent."""
        return [self.at[node] for node in self.counted]

    def learn(self, found: np.ndarray) -> np.ndarray:
        """Takes the histograms of the counted nodes and gives those of all new ones."""
        for i, node in enumerate(self.counted):
            self.histogram[node] = found[:, i]
        for parent, (left, right) in enumerate(zip(self.left, self.right, strict=True)):
            if left in self.new:
                known, other = (left, right) if self.histogram[right] is None else (right, left)
                self.histogram[other] = self.histogram[parent] - self.histogram[known]
                self.histogram[parent] = None
        return np.stack([self.histogram[node] for node in self.new], axis=1)


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _worth(sums: np.ndarray, growth: Growth) -> np.ndarray:
    return _shrunk(sums[0], growth.l1) ** 2 / (sums[1] + growth.l2 + 1e-15)


def best_splits(
    histograms: np.ndarray, part: Part, growth: Growth, allowed: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per slot the gain of the best split, its bin, and the slot's sums.

    histograms: (gradient, hessian, rows) x slot x bin. Of equal gains the first bin wins.
    """
    total = np.add.reduceat(histograms, part.first, axis=2)[:, :, :1]
    left = part.left(histograms)
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _worth(left, growth) + _worth(right, growth) - _worth(total, growth)
    good = part.splits & allowed
    for side in (left, right):
        good = good & (side[2] >= growth.least_rows) & (side[1] >= growth.least_hessian)
    gain = np.where(good, np.round(gain, 9), -np.inf)
    at = gain.argmax(axis=1)
    return gain[np.arange(len(at)), at], at, total[:, :, 0]


def _grown(
    part: Part,
    add: Callable,
    growth: Growth,
    allowed: np.ndarray,
    g: np.ndarray,
    h: np.ndarray,
    classes: range | list[int],
) -> list[tuple[Tree, list[int], list[int]]]:
    """One tree for each of the classes. Each pass makes the histograms of all their new nodes."""
    trees = [Tree() for _ in classes]
    while any(t.new for t in trees):
        own = [
            np.concatenate([part.histograms([None], [g[c], h[c]]), part.rows])
            if t.new == [0]
            else part.histograms(t.to_count(), [g[c], h[c], part.n])
            for c, t in zip(classes, trees, strict=True)
            if t.new
        ]
        every = add(np.concatenate(own, axis=1))
        at = 0
        for t in trees:
            if not t.new:
                continue
            mine = t.learn(every[:, at : at + len(t.counted)])
            at += len(t.counted)
            gains, bins, sums = best_splits(mine, part, growth, allowed)
            for i, node in enumerate(t.new):
                deep = growth.depth is not None and t.depth[node] >= growth.depth
                t.gain[node] = -np.inf if deep else float(gains[i])
                t.bin[node], t.sums[node] = int(bins[i]), sums[:, i]
            inner, _ = t.chosen(growth.leaves)
            t.new = []
            if more := [i for i in inner if t.left[i] < 0]:
                t.expand(more, part)
    return [(t, *t.chosen(growth.leaves)) for t in trees]


TREES = (
    "number int, class int, feature array<int>, threshold array<double>, left array<int>, "
    "right array<int>, value array<double>, cover array<double>"
)
TREE_COLUMNS = [f.split()[0] for f in TREES.split(", ")]


def _tree_row(
    number: int, c: int, tree: Tree, inner: list[int], values: dict, part: Part, edges: list
) -> tuple:
    """The nodes that stay, renumbered; leaves have the feature -1."""
    kept = sorted([*inner, *values])
    place = {node: i for i, node in enumerate(kept)}
    out = ([], [], [], [], [], [])
    for node in kept:
        if node in values:
            row = (-1, 0.0, -1, -1, values[node])
        else:
            column = int(part.column[tree.bin[node]])
            threshold = edges[column][tree.bin[node] - int(part.first[column])]
            row = (column, threshold, place[tree.left[node]], place[tree.right[node]], 0.0)
        for to, value in zip(out, (*row, float(tree.sums[node][2])), strict=True):
            to.append(value)
    return (number, c, *out)


class Cores:
    """The cores of a task: what classes or rows do by themselves is done side by side.

    Numpy's loops leave the interpreter to other threads.
    """

    def __init__(self, cores: int):
        self.cores = cores
        self.pool = ThreadPool(cores) if cores > 1 else None

    def __enter__(self) -> Cores:
        return self

    def __exit__(self, *_) -> None:
        if self.pool:
            self.pool.terminate()

    def map(self, work: Callable, items: list) -> list:
        if self.pool is None:
            return [work(item) for item in items]
        return self.pool.map(work, items, chunksize=1)

    def over(self, rows: int) -> list[slice]:
        """The rows in as many runs as there are cores."""
        cuts = [rows * i // self.cores for i in range(self.cores + 1)]
        return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def softmax(margins: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Of the classes by row."""
    e = np.subtract(margins, margins.max(axis=0), out=out)
    np.exp(e, out=e)
    e /= e.sum(axis=0)
    return e


def grow_softmax(
    rows: pd.DataFrame,
    edges: list[list[float]],
    growth: Growth,
    allowed: list[int],
    add: Callable | None = None,
    cores: int = 1,
) -> list[tuple]:
    """The trees of all rounds. Tree 0 of a class is its share of the weights, as a margin.

    add sums an array over the tasks of a fit, where there are several. A task that has all rows
    grows the classes' trees side by side on its cores; the trees are the same on any number.
    """
    with Cores(cores) as own:
        return _grow_softmax(rows, edges, growth, allowed, add, own)


def _grow_softmax(
    rows: pd.DataFrame,
    edges: list[list[float]],
    growth: Growth,
    allowed: list[int],
    exchange: Callable | None,
    cores: Cores,
) -> list[tuple]:
    add = exchange or (lambda own: own)
    part = Part(rows, [len(e) + 1 for e in edges], add)
    own = part.of_label
    w = own.sum(axis=0)
    share = add(own.sum(axis=1))
    start = np.log(np.maximum(share / max(share.sum(), 1e-300), 1e-15))
    margins = np.repeat(start[:, None], len(w), axis=1)
    can = np.isin(part.column, allowed)
    out = [(0, c, [-1], [0.0], [-1], [-1], [float(start[c])], [1.0]) for c in range(CLASSES)]
    p, g, h = (np.empty_like(margins) for _ in range(3))  # once, not once a round

    def gradients(at: slice) -> None:
        softmax(margins[:, at], p[:, at])
        np.multiply(w[at], p[:, at], out=h[:, at])
        np.subtract(h[:, at], own[:, at], out=g[:, at])
        np.subtract(1, p[:, at], out=p[:, at])
        h[:, at] *= p[:, at]
        h[:, at] *= CLASSES / (CLASSES - 1)

    def grown(number: int, c: int, tree: Tree, inner: list[int], leaves: list[int]) -> list[tuple]:
        """The class's tree as a row, after its margins have taken the steps of its leaves."""
        if not inner:
            return []
        sums = np.array([tree.sums[i] for i in leaves])
        steps = -_shrunk(sums[:, 0], growth.l1) / (sums[:, 1] + growth.l2 + 1e-15) * growth.step
        values = dict(zip(leaves, steps.tolist(), strict=True))
        for leaf, value in values.items():
            reached = [leaf]
            while reached:  # what was split ahead of time and not taken
                node = reached.pop()
                if tree.left[node] >= 0:
                    reached += [tree.left[node], tree.right[node]]
                else:
                    margins[c, tree.at[node]] += value
        return [_tree_row(number, c, tree, inner, values, part, edges)]

    runs = cores.over(len(w))
    for number in range(1, growth.rounds + 1):
        cores.map(gradients, runs)

        def of(classes: list[int], number: int = number) -> list[tuple]:
            found = _grown(part, add, growth, can, g, h, classes)
            return [row for c, t in zip(classes, found) for row in grown(number, c, *t)]

        # several tasks exchange the sums of all classes at once, and so keep in step
        shares = [list(range(CLASSES))] if exchange else [[c] for c in range(CLASSES)]
        for rows_of in cores.map(of, shares):
            out += rows_of
    return out


STUMPS = "n int, feature int, threshold double, left int, right int, alpha double"


def grow_stumps(
    rows: pd.DataFrame,
    edges: list[list[float]],
    rounds: int,
    add: Callable | None = None,
) -> list[tuple]:
    """SAMME: a round takes the stump of least weighted Gini impurity and re-weights its hits."""
    add = add or (lambda own: own)
    part = Part(rows, [len(e) + 1 for e in edges], add)
    w = part.of_label.copy()
    classes = int((add(rows[[f"n{c}" for c in range(CLASSES)]].to_numpy(np.float64).sum(axis=0)) > 0).sum())
    out: list[tuple] = []
    for number in range(rounds):
        sums = add(part.histograms([None], list(w))[:, 0])
        total = np.add.reduceat(sums, part.first, axis=1)[:, :1]
        left = part.left(sums)
        right = total - left
        weight = [s.sum(axis=0) for s in (left, right)]
        least = 1e-12 * float(total.sum())
        good = part.splits & (weight[0] > least) & (weight[1] > least)
        if not good.any():
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            pure = (left**2).sum(axis=0) / weight[0] + (right**2).sum(axis=0) / weight[1]
        at = int(np.where(good, np.round(pure / total.sum(), 12), -np.inf).argmax())
        sides = int(left[:, at].argmax()), int(right[:, at].argmax())
        all_of_it = float(total.sum())
        missed = all_of_it - float(left[:, at].max() + right[:, at].max())
        error = max(missed / all_of_it, 1e-10)
        if error >= 1.0 - 1.0 / classes:
            break
        alpha = math.log((1.0 - error) / error) + math.log(classes - 1.0)
        column = int(part.column[at])
        place = at - int(part.first[column])
        out.append((number, column, edges[column][place], *sides, alpha))
        if missed <= 1e-10 * all_of_it:
            break
        # Hits go down instead of misses up: the weights stay at most what they were.
        on_left = part.across[column] <= place
        w[sides[0], on_left] *= math.exp(-alpha)
        w[sides[1], ~on_left] *= math.exp(-alpha)
    return out


# --- fits as jobs -------------------------------------------------------------------------


@dataclass(frozen=True)
class Spec:
    """One model: the fold it does not see, its class weights, the columns it may split on."""

    skip: int | None = None
    class_weights: dict[int, float] | None = None
    columns: tuple[int, ...] | None = None


def minted_for(folds: Column) -> Column:
    """What stands in `fold` for a row that only some folds' models see; folds are bits."""
    return -folds - 1


def _is_seen(fold: Column, skip: int) -> Column:
    """Whether the model that skips a fold sees a row of this one."""
    minted = (-fold - 1).bitwiseAND(F.lit(1 << skip)) != 0
    return F.coalesce(F.when(fold < 0, minted).otherwise(fold != skip), F.lit(True))


def _rows_of(table: DataFrame, spec: Spec) -> DataFrame:
    """What a model sees: code, n, and by label the rows n0.. and their weights w0.. ."""
    seen = F.col("cells")
    if spec.skip is not None:
        seen = F.filter(seen, lambda cell: _is_seen(cell["fold"], spec.skip))

    def of(c: int) -> tuple[Column, Column]:
        factor = 1.0 if spec.class_weights is None else spec.class_weights.get(c, 1.0)
        mine = F.filter("seen", lambda cell: cell["label"] == c)
        n = F.aggregate(mine, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
        step = lambda acc, x: acc + x["weight"] * F.lit(factor) * x["n"]
        return n.alias(f"n{c}"), F.aggregate(mine, F.lit(0.0), step).alias(f"w{c}")

    rows = table.withColumn("seen", seen).filter(F.size("seen") > 0)
    n = sum((F.col(f"n{c}") for c in K.CLASS_IDS), F.lit(0))
    return rows.select("code", *[v for c in K.CLASS_IDS for v in of(c)]).withColumn("n", n)


def _task(
    alone: bool, allowed: list[int], work: Callable, names: list[str], cores: int
) -> Callable:
    """Collects a task's rows and runs the fit; the first task hands the model back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [*batches]
        empty = ["code", "n", *[f"{x}{c}" for x in "nw" for c in range(CLASSES)]]
        rows = pd.concat(parts) if parts else pd.DataFrame({c: [] for c in empty})
        # the same order whatever way the rows came
        rows = rows.sort_values("code").reset_index(drop=True)
        model = work(rows, allowed, _summed(alone), cores)
        if alone or BarrierTaskContext.get().partitionId() == 0:
            yield pd.DataFrame(model, columns=names)

    return run


def task_cores(spark: SparkSession, models: int) -> tuple[int, ResourceProfile | None]:
    """Cores for the task of each of so many models, and the profile that asks Spark for them.

    Where it is not known how many cores an executor has, or Spark has no task profiles, a
    task has the one core of any other. In local mode the cores left over are this process's.
    """
    context = spark.sparkContext
    share = min(CLASSES, context.defaultParallelism // max(1, models))
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        return max(1, share), None
    conf = context.getConf()
    cluster = re.fullmatch(r"local-cluster\[\s*\d+\s*,\s*(\d+)\s*,.*", context.master)
    known = cluster or context.master.startswith(("spark://", "yarn", "k8s://"))
    of_executor = conf.get("spark.executor.cores", cluster.group(1) if cluster else "1")
    if not known or conf.get("spark.task.cpus", "1") != "1":
        return 1, None
    cores = min(share, int(of_executor))
    while cores > 1 and context.defaultParallelism // int(of_executor) * (int(of_executor) // cores) < models:
        cores -= 1
    if cores < 2:
        return 1, None
    return cores, ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build


def fit_all(
    fits: list[tuple[DataFrame, Spec, Callable]], schema: str, columns: int, models: int = 1
) -> list[list]:
    """The rows of every model: (table, spec, work); tables as `collapsed` makes them, on disk.

    Models are jobs side by side, and their tasks share the cores, with the other fits too that
    the caller runs at the same time: models is their number, if it is more than these.
    Where a task would hold more than MOST_ROWS rows, a model has several tasks, which hold a
    part each.
    """
    tables = {id(table): table for table, *_ in fits}
    tasks = {i: max(1, -(-table.count() // MOST_ROWS)) for i, table in tables.items()}
    spark = fits[0][0].sparkSession
    slots = spark.sparkContext.defaultParallelism
    names = [f.split()[0] for f in schema.split(", ")]
    alone = max(tasks.values()) == 1
    cores, profile = task_cores(spark, max(models, len(fits))) if alone else (1, None)

    def fit(one: tuple[DataFrame, Spec, Callable]) -> list:
        table, spec, work = one
        rows, parts = _rows_of(table, spec), tasks[id(table)]
        held = rows.coalesce(1) if parts == 1 else rows.repartition(parts, F.xxhash64("code"))
        allowed = list(range(columns) if spec.columns is None else spec.columns)
        task = _task(parts == 1, allowed, work, names, cores)
        job = held.mapInPandas(task, schema, barrier=parts > 1, profile=profile)
        return job.collect()

    with ThreadPool(max(1, min(len(fits), slots // max(tasks.values())))) as pool:
        return pool.map(inheritable_thread_target(spark)(fit), fits, chunksize=1)


# --- models -------------------------------------------------------------------------------

#: Masks of leaves; trees of more leaves are walked node by node.
MASKS = (np.uint16, np.uint32, np.uint64)
#: Leaf masks that are worked out at a time.
AT_ONCE = 200_000


def _lowest(masks: np.ndarray) -> np.ndarray:
    """The place of the lowest bit that is set: the exponent of that power of two."""
    least = masks & (~masks + masks.dtype.type(1))
    if masks.dtype == np.uint64:
        return (least.astype(np.float64).view(np.int64) >> 52) - 1023
    return (least.astype(np.float32).view(np.int32) >> 23) - 127


class Masks:
    """Trees whose leaves are bits, from the left.

    A value right of a node's threshold takes the bits of the node's left side away. What a
    column's value takes away in all trees is one row of that column's table, and the lowest
    bit left over by all columns is the leaf. Columns of few thresholds have one table for
    their joint values.
    """

    def __init__(self, trees: list[tuple], kind: type | None):
        trees = sorted(trees, key=lambda tree: (tree[1], tree[0]))
        self.trees, self.kind = trees, kind
        self.of_class = np.array([tree[1] for tree in trees])
        if kind is None:
            return
        cuts: dict[int, set] = {}
        for tree in trees:
            for f, t in zip(tree[2], tree[3], strict=True):
                if f >= 0:
                    cuts.setdefault(f, set()).add(t)
        self.cuts = {f: np.array(sorted(ts)) for f, ts in sorted(cuts.items())}
        everything = np.iinfo(kind).max
        left = {
            f: np.full((len(ts) + 1, len(trees)), everything, kind) for f, ts in self.cuts.items()
        }
        self.width = 8 * np.dtype(kind).itemsize
        self.value = np.zeros((len(trees), self.width))
        for i, (_, _, feature, threshold, to_left, to_right, value, _) in enumerate(trees):
            under: dict[int, int] = {}
            waiting, leaves = [(0, False)], 0
            while waiting:
                node, done = waiting.pop()
                if feature[node] < 0:
                    self.value[i, leaves] = value[node]
                    under[node] = 1 << leaves
                    leaves += 1
                elif not done:
                    waiting += [(node, True), (to_right[node], False), (to_left[node], False)]
                else:
                    under[node] = under[to_left[node]] | under[to_right[node]]
                    f = feature[node]
                    after = int(np.searchsorted(self.cuts[f], threshold[node])) + 1
                    left[f][after:, i] &= kind(everything ^ under[to_left[node]])
        #: Columns that are looked up together, and what their joint values leave.
        self.groups: list[tuple[list[int], np.ndarray]] = []
        for f in sorted(left, key=lambda f: len(left[f])):
            if self.groups and len(self.groups[-1][1]) * len(left[f]) <= MOST_JOINT:
                columns, before = self.groups.pop()
                joint = (before[:, None] & left[f]).reshape(-1, len(trees))
                self.groups.append(([*columns, f], joint))
            else:
                self.groups.append(([f], left[f]))
        starts = np.flatnonzero(np.diff(self.of_class, prepend=-1)).tolist()
        #: Where each class's trees are.
        self.spans = [
            (int(self.of_class[a]), a, b)
            for a, b in zip(starts, [*starts[1:], len(trees)], strict=True)
        ]
        self.at = np.arange(len(trees)) * self.width

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Class by row: what these trees add. Rows that no threshold tells apart are one."""
        if self.kind is None:
            distinct, where = np.unique(x, axis=0, return_inverse=True)
            found = self._walked(distinct, np.zeros((CLASSES, len(distinct))))
            return found[:, where.ravel()]
        keys = []
        for columns, _ in self.groups:
            key = np.zeros(len(x), np.int64)
            for f in columns:
                key = key * (len(self.cuts[f]) + 1) + np.searchsorted(self.cuts[f], x[:, f])
            keys.append(key)
        same = np.zeros(len(x), np.int64)
        reach = 1
        for key, (_, table) in zip(keys, self.groups, strict=True):
            if reach * len(table) >= 2**62:
                same = np.unique(same, return_inverse=True)[1].ravel()
                reach = len(x) + 1
            same = same * len(table) + key
            reach *= len(table)
        _, first, where = np.unique(same, return_index=True, return_inverse=True)
        keys = [key[first] for key in keys]
        out = np.zeros((CLASSES, len(first)))
        step = max(1, AT_ONCE // max(1, len(self.trees)))
        for i in range(0, len(first), step):
            rows = slice(i, min(i + step, len(first)))
            masks = np.full((rows.stop - i, len(self.trees)), np.iinfo(self.kind).max, self.kind)
            for key, (_, table) in zip(keys, self.groups, strict=True):
                masks &= table.take(key[rows], axis=0)
            values = self.value.ravel().take(_lowest(masks) + self.at)
            for c, a, b in self.spans:
                out[c, rows] = values[:, a:b].sum(axis=1)
        return out[:, where.ravel()]

    def _walked(self, x: np.ndarray, out: np.ndarray) -> np.ndarray:
        every = np.arange(len(x))
        for _, c, feature, threshold, left, right, value, _ in self.trees:
            feature, threshold, left, right = map(np.asarray, (feature, threshold, left, right))
            node = np.zeros(len(x), np.int64)
            rows = every if feature[0] >= 0 else every[:0]
            while len(rows):
                at = node[rows]
                f = feature[at]
                at = np.where(x[rows, f] <= threshold[at], left[at], right[at])
                node[rows] = at
                rows = rows[feature[at] >= 0]
            out[c] += np.asarray(value)[node]
        return out


@dataclass
class SoftmaxTrees:
    """Boosted trees of all classes; `trees` are rows of TREES."""

    trees: list[tuple] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    _masks: list | None = field(default=None, repr=False, compare=False)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Class by row."""
        return sum((trees.margins(x) for trees in self._tables()), np.zeros((CLASSES, len(x))))

    def _tables(self) -> list[Masks]:
        """The trees by how many leaves they have, made once a worker."""
        if self._masks is None:
            widths: dict[type, list[tuple]] = {}
            for tree in self.trees:
                leaves = sum(f < 0 for f in tree[2])
                kind = next((k for k in MASKS if leaves <= 8 * np.dtype(k).itemsize), None)
                widths.setdefault(kind, []).append(tree)
            self._masks = [Masks(trees, kind) for kind, trees in widths.items()]
        return self._masks

    def _applied(self, df: DataFrame, name: str, work: Callable) -> DataFrame:
        """work(margins) of every row, as an array by class."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def applied(*values: pd.Series) -> pd.Series:
            x = np.column_stack([v.to_numpy(np.float64) for v in values])
            return pd.Series(list(work(shared.value.margins(x)).T))

        return df.withColumn(name, applied(*[F.col(f"`{c}`") for c in self.columns]))

    def with_margins(self, df: DataFrame) -> DataFrame:
        """Adds `margins`, what the trees of every class add up to."""
        return self._applied(df, "margins", lambda margins: margins)

    def score(self, df: DataFrame) -> DataFrame:
        scored = self._applied(df, "_p", softmax)
        share = F.struct(*[F.col("_p")[c].alias(p) for c, p in enumerate(PROBABILITIES)])
        return scored.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(share)))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(self.trees, TREES).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, columns: list[str]) -> SoftmaxTrees:
        rows = spark.read.parquet(path).orderBy("number", "class").collect()
        return cls([tuple(r) for r in rows], columns)


def _softmax_work(edges: list[list[float]], growth: Growth) -> Callable:
    return lambda rows, allowed, add, cores: grow_softmax(rows, edges, growth, allowed, add, cores)


def _prepared(df: DataFrame, columns: list[str], bins: int) -> tuple[DataFrame, list[list[float]]]:
    edges = bin_edges(df, columns, bins)
    return materialise(collapsed(df, columns, edges), "collapsed"), edges


def fit_boosted(
    df: DataFrame, columns: list[str], bins: int = BINS, models: int = 1, **growth
) -> SoftmaxTrees:
    """The boosted model of df's columns, label and weight; models as in fit_all."""
    table, edges = _prepared(df.withColumn("fold", F.lit(0)), columns, bins)
    work = _softmax_work(edges, Growth(**growth))
    (trees,) = fit_all([(table, Spec(), work)], TREES, len(columns), models)
    return SoftmaxTrees([tuple(t) for t in trees], columns)


def fit_stumps(df: DataFrame, columns: list[str], rounds: int, bins: int = BINS) -> list[tuple]:
    """The stumps of SAMME as rows of STUMPS."""
    table, edges = _prepared(df.withColumn("fold", F.lit(0)), columns, bins)
    work = lambda rows, _, add, __: grow_stumps(rows, edges, rounds, add)
    (stumps,) = fit_all([(table, Spec(), work)], STUMPS, len(columns))
    return [tuple(s) for s in stumps]


def damped(counts: dict[int, int], alpha: float) -> dict[int, float]:
    """(N / (K * n_c)) ** alpha per class, divided by the smallest."""
    n, k = sum(counts.values()), len(counts)
    raw = {c: (n / (k * m)) ** max(alpha, 0.0) for c, m in counts.items()}
    return {c: v / min(raw.values()) for c, v in raw.items()}


def fit_folds(
    rows: DataFrame,
    folds: int,
    columns: list[str],
    arms: dict[str, dict],
    bins: int = BINS,
    models: int = 1,
) -> dict[tuple[str, int], SoftmaxTrees]:
    """A model for every arm and fold, all side by side: rows have label and fold.

    An arm is a dict of alpha (of the class weights), columns it may use, growth, and target
    where the thin classes of its training parts are topped up to one. Arms of one target share
    a table, the minted rows of all its folds in it. Bins are quantiles of all rows of a table,
    without labels.
    """
    known = rows.filter(F.col("label").isNotNull() & F.col("fold").isNotNull())
    counts: list[dict[int, int]] = [{} for _ in range(folds)]
    for r in known.groupBy("label", "fold").count().collect():
        for i in range(folds):
            if r.fold != i:
                counts[i][r.label] = counts[i].get(r.label, 0) + r["count"]
    targets = list(dict.fromkeys(options.get("target") for options in arms.values()))

    def prepared(target: int | None) -> tuple[DataFrame, list[list[float]]]:
        every = rows.select(*columns, "label", "fold")
        if target is not None:
            missing = [balance.missing(n, target) for n in counts]
            every = balance.top_up_folds(every, missing, columns, minted_for)
        return _prepared(every.withColumn("weight", F.lit(1.0)), columns, bins)

    with ThreadPool(len(targets)) as pool:
        run = inheritable_thread_target(rows.sparkSession)(prepared)
        tables = dict(zip(targets, pool.map(run, targets, chunksize=1), strict=True))
    named, fits = [], []
    for arm, options in arms.items():
        target = options.get("target")
        table, edges = tables[target]
        kept = tuple(columns.index(c) for c in options["columns"])
        work = _softmax_work(edges, options["growth"])
        for i, n in enumerate(counts):
            minted = {} if target is None else balance.missing(n, target)
            seen = {c: m + minted.get(c, 0) for c, m in n.items()}
            named.append((arm, i))
            fits.append((table, Spec(i, damped(seen, options["alpha"]), kept), work))
    fitted = fit_all(fits, TREES, len(columns), models)
    return {
        name: SoftmaxTrees([tuple(t) for t in trees], columns)
        for name, trees in zip(named, fitted, strict=True)
    }
