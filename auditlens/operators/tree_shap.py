"""Exact attributions of tree ensembles, for rows that were filtered before.

A leaf adds its value times a product over the features of its path: 1 or 0
where the row's value is known, the share of training rows that took the branch
where it is not. Which conditions of a leaf a row meets is a pattern of bits; the Shapley
values of a leaf are worked out once per pattern that the rows of a batch show.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.operators.attributions import ranked
from auditlens.session import materialise

#: Patterns of a leaf that are counted in a table; beyond, the ones there are get sorted out.
MOST_PATTERNS = 4_096
#: Rows that are explained at once.
AT_ONCE = 20_000

# A leaf is (features, low, high, share, out): the features of its path, the interval
# the path allows for each, the share of rows that took it, and its value per class.
# Plain tuples can be broadcast without this package on the executors.
Leaf = tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _shapley(share: np.ndarray, met: np.ndarray) -> np.ndarray:
    """pattern x feature: the Shapley values of a product of m conditions.

    The sums over all subsets of one size are the coefficients of a polynomial
    with one factor (share + met * t) per other feature.
    """
    m = len(share)
    weights = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
    sums = np.zeros((len(met), m, m))  # pattern x feature left out x size
    sums[:, :, 0] = 1.0
    for j in range(m):
        grown = sums * share[j]
        grown[:, :, 1:] += sums[:, :, :-1] * met[:, j, None, None]
        grown[:, j] = sums[:, j]
        sums = grown
    return (sums @ weights) * (met - share)


def _class_shares(node) -> np.ndarray:
    stats = np.array(list(node.impurityStats().stats()), dtype=float)
    return stats / stats.sum()


def _walk(node, path: dict, value, weight: float, leaves: list[Leaf], base: list) -> None:
    if node.subtreeDepth() == 0:
        out = weight * np.atleast_1d(value(node))
        cover = float(np.prod([p[2] for p in path.values()])) if path else 1.0
        base.append(out * cover)
        if path:
            share = np.array([p[2] for p in path.values()])
            leaves.append(
                (
                    list(path),
                    np.array([p[0] for p in path.values()]),
                    np.array([p[1] for p in path.values()]),
                    share,
                    out,
                )
            )
        return
    split = node.split()
    feature, threshold = split.featureIndex(), split.threshold()
    count = float(node.impurityStats().count())
    for child, is_left in ((node.leftChild(), True), (node.rightChild(), False)):
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        branch = float(child.impurityStats().count()) / count
        bounds = (low, min(high, threshold)) if is_left else (max(low, threshold), high)
        _walk(child, {**path, feature: (*bounds, share * branch)}, value, weight, leaves, base)


def forest_leaves(model) -> tuple[list[Leaf], np.ndarray]:
    """Leaves of a Spark forest in class shares, and the mean output per class."""
    return _collect(model, _class_shares, [1.0 / model.getNumTrees] * model.getNumTrees)


def boosted_leaves(trees: list[tuple], classes: int) -> tuple[list[Leaf], np.ndarray]:
    """Leaves of boosted trees (rows of boosting.TREES), each in its class's margin.

    The second result is the base value: the margins' mean over the training rows.
    """
    leaves: list[Leaf] = []
    base = np.zeros(classes)
    for _, c, feature, threshold, left, right, value, cover in trees:
        unit = np.eye(classes)[c]
        waiting: list[tuple[int, dict]] = [(0, {})]
        while waiting:
            node, path = waiting.pop()
            if feature[node] < 0:
                share = float(np.prod([p[2] for p in path.values()])) if path else 1.0
                base += value[node] * share * unit
                if path:
                    low, high, shares = (np.array([p[i] for p in path.values()]) for i in range(3))
                    leaves.append((list(path), low, high, shares, value[node] * unit))
                continue
            f, t = feature[node], threshold[node]
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in (
                (left[node], (low, min(high, t))),
                (right[node], (max(low, t), high)),
            ):
                branch = cover[child] / cover[node]
                waiting.append((child, {**path, f: (*bounds, share * branch)}))
    return leaves, base


def _collect(model, value, weights) -> tuple[list[Leaf], np.ndarray]:
    leaves: list[Leaf] = []
    base: list[np.ndarray] = []
    for tree, weight in zip(model.trees, weights):
        _walk(tree._call_java("rootNode"), {}, value, weight, leaves, base)
    return leaves, np.sum(base, axis=0)


def attribute(leaves: list[Leaf], x: np.ndarray, classes: int) -> np.ndarray:
    """row x feature x class."""
    phi = np.zeros((classes, x.shape[1], len(x)))
    across = np.ascontiguousarray(x.T)
    for features, low, high, share, out in leaves:
        m = len(features)
        codes = np.zeros(len(x), np.int64)
        for j, f in enumerate(features):
            codes |= ((across[f] > low[j]) & (across[f] <= high[j])).astype(np.int64) << j
        if 1 << m <= MOST_PATTERNS:
            patterns = np.flatnonzero(np.bincount(codes, minlength=1 << m))
            place = np.zeros(1 << m, np.int64)
            place[patterns] = np.arange(len(patterns))
            which = place.take(codes)
        else:
            patterns, which = np.unique(codes, return_inverse=True)
            which = which.reshape(-1)
        met = (patterns[:, None] >> np.arange(m)) & 1
        values = _shapley(share, met.astype(float))
        for c in np.flatnonzero(out):
            for j, f in enumerate(features):
                phi[c, f] += (values[:, j] * out[c]).take(which)
    return phi.transpose(2, 1, 0)


def attribute_class(leaves: list[Leaf], x: np.ndarray, of_row: np.ndarray) -> np.ndarray:
    """row x feature, each row for its own class; only leaves that have a value there are read."""
    phi = np.zeros(x.shape)
    for c in np.unique(of_row):
        rows = of_row == c
        own = [(*leaf[:4], leaf[4][c : c + 1]) for leaf in leaves if leaf[4][c] != 0]
        phi[rows] = attribute(own, x[rows], 1)[:, :, 0]
    return phi


def in_places(leaves: list[Leaf], columns: int) -> tuple[list[np.ndarray], list[Leaf]]:
    """The thresholds of every column, and the leaves with places among them as bounds.

    A value's place is the number of thresholds below it, so values that no leaf tells apart
    have the same.
    """
    found: list[set] = [set() for _ in range(columns)]
    for features, low, high, *_ in leaves:
        for f, a, b in zip(features, low.tolist(), high.tolist(), strict=True):
            found[f].update((a, b))
    cuts = [np.array(sorted(t for t in ts if np.isfinite(t))) for ts in found]
    placed = []
    for features, low, high, share, out in leaves:
        bounds = [
            np.array([np.searchsorted(cuts[f], t) for f, t in zip(features, ts, strict=True)])
            for ts in (low, high)
        ]
        bounds[0] = np.where(np.isfinite(low), bounds[0], -1)
        placed.append((features, *bounds, share, out))
    return cuts, placed


def with_tree_attributions(
    rows: DataFrame, columns: list[str], leaves: list[Leaf], classes: int, k: int = 5
) -> DataFrame:
    """Adds `top`, the k largest attributions for the row's predicted class.

    rows holds the scaled features and must already be filtered to what needs an
    explanation; Spark cannot push a filter through the Arrow stage. Rows of one class that no
    threshold tells apart are explained once, and get the values by a join. What is sent
    to all tasks are the leaves: under 1 KB each, as many as the trees have.
    """
    spark = rows.sparkSession
    cuts, placed = in_places(leaves, len(columns))
    kind = np.uint8 if max(map(len, cuts), default=0) <= np.iinfo(np.uint8).max else np.uint32
    shared = spark.sparkContext.broadcast(placed)
    names = [f"_phi{i}" for i in range(len(columns))]
    kept = [c for c in rows.columns if c not in columns]

    @F.pandas_udf("binary")
    def places(*values: pd.Series) -> pd.Series:
        code = np.empty((len(values[0]), len(values)), kind)
        for i, v in enumerate(values):
            code[:, i] = np.searchsorted(cuts[i], v.to_numpy(np.float64))
        return pd.Series([row.tobytes() for row in code])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [*batches]  # a leaf costs the same for few rows: a task's are taken together
        every = pd.concat(own) if own else pd.DataFrame({"_code": [], "_class": []})
        for i in range(0, len(every), AT_ONCE):
            pdf = every.iloc[i : i + AT_ONCE].reset_index(drop=True)
            x = np.frombuffer(b"".join(pdf["_code"]), kind).reshape(-1, len(columns))
            of_class = np.minimum(pdf["_class"].to_numpy(), classes - 1)
            picked = attribute_class(shared.value, x, of_class)
            yield pd.concat([pdf, pd.DataFrame(picked, columns=names)], axis=1)

    code = places(*[F.col(f"`{c}`").cast("double") for c in columns])
    known = materialise(
        rows.select(*[F.col(f"`{c}`") for c in kept], code.alias("_place")), "places"
    )
    different = known.select(
        F.col("_place").alias("_code"), F.col("predicted_class").alias("_class")
    ).distinct()
    # one task a core: what a row costs has nothing to do with its bytes
    spread = different.repartition(spark.sparkContext.defaultParallelism, "_code", "_class")
    of_class = spread.schema["_class"].dataType.simpleString()
    schema = ", ".join(["_code binary", f"_class {of_class}", *[f"{n} double" for n in names]])
    explained = spread.mapInPandas(explain, schema)
    same = (F.col("_place") == F.col("_code")) & F.col("predicted_class").eqNullSafe(F.col("_class"))
    top = ranked({c: (i, n) for i, (c, n) in enumerate(zip(columns, names))}, k)
    return known.join(explained, same).withColumn("top", top).select(
        *[F.col(f"`{c}`") for c in kept], "top"
    )
