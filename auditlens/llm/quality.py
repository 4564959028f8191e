"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; each step fits a shallow tree on one feature's
bins to the gradient and adds a part of it to that feature's lookup table. The pairs with the
strongest interaction in what is left are then boosted the same way on two-way tables. A score
is the sigmoid of an intercept and one table entry a feature and pair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.common import each_text, held_out

#: Labelled rows to fit on at most, chosen by a hash of their id. The fit is local.
FIT_ROWS = 20_000
BINS, COARSE, PAIRS = 32, 8, 8
ROUNDS, RATE, DAMPING = 120, 0.15, 1.0
#: Below this many rows a fit has nothing to learn from, and every score is the base rate.
LEAST_ROWS = 2

FEATURES = (
    "chars", "words", "word_mean", "word_deviation", "word_max", "letters", "upper", "digits",
    "spaces", "symbols", "non_ascii", "distinct_words", "top_word", "distinct_lines", "line_mean",
    "sentence_ends", "capital_words", "symbol_kinds", "char_entropy", "vowels", "long_runs",
)


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, 4, np.int64)
    kind[[ord(c) for c in " \t\n\r\v\f"]] = 3
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[128:] = 5
    return kind


KIND = _byte_kinds()
VOWELS = np.array([ord(c) for c in "aeiouAEIOU"])
SYMBOLS = np.flatnonzero(KIND == 4)
RUN = re.compile(r"(\S)\1{3}")


def measure(text: str) -> tuple[float, ...]:
    """What is counted in a text; shares are 0 where there is nothing to divide by."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    lower, upper, digits, spaces, symbols, high = np.bincount(KIND, by_byte, 6)
    size, words, lines = max(len(raw), 1), text.split(), text.split("\n")
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    share = by_byte[by_byte > 0] / size
    counted = Counter(words)
    filled = [line for line in lines if line]
    return (
        np.log1p(len(text)),
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        (lower + upper + high) / size,
        upper / max(lower + upper, 1),
        digits / size,
        spaces / size,
        symbols / size,
        high / size,
        len(counted) / n,
        max(counted.values(), default=0) / n,
        len(set(filled)) / max(len(filled), 1),
        np.log1p(len(text) / max(len(filled), 1)),
        (by_byte[46] + by_byte[33] + by_byte[63]) / n,
        sum(w[0].isupper() for w in words) / n,
        np.count_nonzero(by_byte[SYMBOLS]),
        float(-(share * np.log2(share)).sum()),
        by_byte[VOWELS].sum() / max(lower + upper, 1),
        np.log1p(sum(1 for _ in RUN.finditer(text))),
    )


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, cuts: int = 3) -> np.ndarray:
    """The steps of a tree of at most `cuts` cuts over ordered bins, one value a bin."""
    g, w = np.cumsum(gradient), np.cumsum(weight)
    total = lambda a, b, s: s[b - 1] - (s[a - 1] if a else 0.0)
    gain = lambda x, y: x * x / (y + DAMPING)
    leaves = [(0, len(g))]
    for _ in range(cuts):
        best, at = 1e-9, None
        for leaf, (a, b) in enumerate(leaves):
            if b - a < 2:
                continue
            g0, w0 = total(a, b, g), total(a, b, w)
            left_g = g[a : b - 1] - (g[a - 1] if a else 0.0)
            left_w = w[a : b - 1] - (w[a - 1] if a else 0.0)
            gains = gain(left_g, left_w) + gain(g0 - left_g, w0 - left_w) - gain(g0, w0)
            cut = int(gains.argmax())
            if gains[cut] > best:
                best, at = gains[cut], (leaf, a, a + cut + 1, b)
        if at is None:
            break
        leaf, a, middle, b = at
        leaves[leaf : leaf + 1] = [(a, middle), (middle, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = total(a, b, g) / (total(a, b, w) + DAMPING)
    return out


def pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """A cut on one axis and one on the other in each half: (gain, one value a cell)."""
    best, table = -1.0, np.zeros_like(gradient)
    for flip in (False, True):
        g, w = (gradient.T, weight.T) if flip else (gradient, weight)
        for cut in range(1, len(g)):
            out, gain = np.zeros_like(g), 0.0
            for half in (slice(0, cut), slice(cut, None)):
                row = shallow_tree(g[half].sum(axis=0), w[half].sum(axis=0), cuts=1)
                out[half] = row
                gain += float((row * g[half].sum(axis=0)).sum())
            if gain > best:
                best, table = gain, (out.T if flip else out).copy()
    return best, table


@dataclass
class AdditiveModel:
    """Lookup tables by feature and by pair of features."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edge, x[:, j], "right")]
        rough = {
            j: np.searchsorted(self.coarse[j], x[:, j], "right")
            for j in {k for p in self.pairs for k in p}
        }
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[rough[i], rough[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting on at most FIT_ROWS rows; with no or one class, the base rate only."""
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    features = x.shape[1]
    model = AdditiveModel(float(np.log(rate / (1 - rate))), [], [], [], [], [])
    if len(y) < LEAST_ROWS or len(np.unique(y)) < 2:
        none = [np.zeros(0)] * features
        model.edges, model.coarse, model.tables = none, none, [np.zeros(1)] * features
        return model
    model.edges = [_edges(x[:, j], BINS) for j in range(features)]
    model.coarse = [_edges(x[:, j], COARSE) for j in range(features)]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            size = len(model.tables[j])
            g, w = residual()
            step = RATE * shallow_tree(np.bincount(b, g, size), np.bincount(b, w, size))
            model.tables[j] += step
            total += step[b]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    shape = lambda i, j: (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)

    def cells(i: int, j: int, values: np.ndarray) -> np.ndarray:
        a, b = shape(i, j)
        return np.bincount(rough[i] * b + rough[j], values, a * b).reshape(a, b)

    g, w = residual()
    gains = {
        (i, j): pair_tree(cells(i, j, g), cells(i, j, w))[0]
        for i, j in combinations(range(features), 2)
        if min(shape(i, j)) > 1
    }
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pair_tables = [np.zeros(shape(*p)) for p in model.pairs]
    for _ in range(ROUNDS // 4):
        for k, (i, j) in enumerate(model.pairs):
            g, w = residual()
            step = RATE * pair_tree(cells(i, j, g), cells(i, j, w))[1]
            model.pair_tables[k] += step
            total += step[rough[i], rough[j]]
    return model


def _measurer() -> Callable:
    return lambda texts: ((list(map(float, measure(t))),) for t in texts)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `features`: struct<x: array<double>> in the order of FEATURES.

    Null and empty texts give zeros, texts of any length are read whole. A column `features`
    of the input is replaced.
    """
    return docs.withColumn("features", each_text(_measurer, "x array<double>")(F.col(text)))


def train(rows: DataFrame, label: str, id_col: str, most: int = FIT_ROWS) -> AdditiveModel:
    """Fits on rows with features and a label of 0 or 1; other labels are left out.

    Of more than `most` rows about that many are taken by a hash of their id and features, so
    only these go to the driver, and of them at most `most`. Rows that are equal throughout are
    counted before they are drawn, and as many of them are taken as are their share.
    """
    place = F.pmod(F.xxhash64(F.col(id_col), F.col("features.x")), F.lit(1 << 30))
    usable = (
        rows.filter(F.col(label).isin(0, 1))
        .select(F.col("features.x").alias("x"), F.col(label).alias("y"), place.alias("place"))
        .groupBy("place", "y", "x")
        .agg(F.count("*").alias("n"))
    )
    groups = usable.count()
    if groups > most:
        usable = usable.filter(F.col("place") < int((1 << 30) * most / groups))
    sample = usable.toPandas().sort_values(["place", "y"], kind="stable")[:most]
    share = max(1.0, sample["n"].sum() / most)
    times = np.maximum(1, (sample["n"].to_numpy(float) / share).astype(int))
    x = np.array(sample["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(np.repeat(x, times, axis=0), np.repeat(sample["y"].to_numpy(float), times))


def score(rows: DataFrame, model: AdditiveModel, *keep: str) -> DataFrame:
    """The kept columns and a score from 0 to 1 of every measured row."""

    @F.pandas_udf("double")
    def scorer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array(batch.tolist(), float).reshape(-1, len(FEATURES))
            yield pd.Series(model.scores(x))

    return rows.select(*keep, scorer(F.col("features.x")).alias("score"))


def quality_report(docs: DataFrame, labels: DataFrame, written: Callable) -> DataFrame:
    """Learns from the labelled rows that are not held out, and scores every row.

    written() stores the measured table, so that the texts are read once. A document with
    several labels is learned from once a label.
    """
    rows = written(measured(docs.select("doc_id", "text")).drop("text"))
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality"))
    learnable = rows.filter(~held_out("doc_id")).join(known, F.col("doc_id") == F.col("_id"))
    model = train(learnable, "_quality", "doc_id")
    return score(rows, model, "doc_id").select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
