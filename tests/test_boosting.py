"""Histogram boosting against plain versions that look at every row for every split."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.operators import balance as BA
from auditlens.operators import boosting as B
from auditlens.operators import models as MO
from auditlens.operators import tree_shap as TS

COLUMNS = list("abcd")


def table(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack(
        [rng.integers(0, 2, n), rng.integers(0, 7, n), rng.normal(size=n).round(1), rng.random(n).round(1)]
    ).astype(float)
    y = (x[:, 0] + (x[:, 2] > 0.3) + 2 * (x[:, 1] > 4) * (x[:, 3] > 0.5)).astype(int)
    flip = rng.random(n) < 0.1
    y[flip] = rng.integers(0, 5, flip.sum())
    return x, y, rng.choice([0.5, 1.0, 2.0], n)


def plain_softmax(x, y, w, growth):
    """(margins, leaves of every tree) by recursion over rows, the best leaf first."""
    onehot = (y == np.arange(5)[:, None]).astype(float)
    share = (onehot * w).sum(axis=1) / w.sum()
    margins = np.repeat(np.log(np.maximum(share, 1e-15))[:, None], len(x), axis=1)
    shrunk = lambda g: np.sign(g) * max(abs(g) - growth.l1, 0)
    worth = lambda g, h: shrunk(g) ** 2 / (h + growth.l2 + 1e-15)
    sizes = []

    def best(rows, g, h, depth):
        found = (-np.inf, None)
        if growth.depth is not None and depth >= growth.depth:
            return found
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[:-1]:
                left, right = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                if min(len(left), len(right)) < growth.least_rows:
                    continue
                if min(h[left].sum(), h[right].sum()) < growth.least_hessian:
                    continue
                gain = sum(worth(g[r].sum(), h[r].sum()) for r in (left, right))
                gain = round(gain - worth(g[rows].sum(), h[rows].sum()), 9)
                if gain > found[0]:
                    found = (gain, (left, right))
        return found

    for _ in range(growth.rounds):
        p = B.softmax(margins)
        new = margins.copy()
        for c in range(5):
            g, h = w * (p[c] - onehot[c]), w * p[c] * (1 - p[c]) * 1.25
            everything = np.arange(len(x))
            leaves = [(everything, 0, *best(everything, g, h, 0))]
            while len(leaves) < growth.leaves:
                at = max(range(len(leaves)), key=lambda i: leaves[i][2])
                if leaves[at][2] <= 0:
                    break
                _, depth, _, sides = leaves.pop(at)
                leaves += [(s, depth + 1, *best(s, g, h, depth + 1)) for s in sides]
            if len(leaves) > 1:
                for rows, *_ in leaves:
                    new[c, rows] -= growth.step * shrunk(g[rows].sum()) / (h[rows].sum() + growth.l2 + 1e-15)
            sizes.append(len(leaves))
        margins = new
    return margins, sizes


@pytest.mark.parametrize(
    "growth",
    [
        B.Growth(rounds=4, step=0.3, leaves=6),
        B.Growth(rounds=3, step=0.3, leaves=64, depth=3, l1=0.0, least_rows=1, least_hessian=1.0),
    ],
)
def test_trees_equal_the_plain_version(spark, growth):
    x, y, w = table()
    df = spark.createDataFrame(
        pd.DataFrame(x, columns=COLUMNS).assign(label=y, weight=w)
    ).repartition(3)
    model = B.fit_boosted(df, COLUMNS, **growth.__dict__)
    margins, sizes = plain_softmax(x, y, w, growth)
    assert model.margins(x) == pytest.approx(margins, abs=1e-7)
    grown = [sum(f < 0 for f in t[2]) for t in model.trees if t[0] > 0]
    assert grown == [s for s in sizes if s > 1]


def test_several_tasks_grow_the_same_trees(spark, monkeypatch):
    x, y, w = table(900, 3)
    df = spark.createDataFrame(pd.DataFrame(x, columns=COLUMNS).assign(label=y, weight=w))
    growth = {"rounds": 5, "step": 0.2}
    alone = B.fit_boosted(df, COLUMNS, **growth)
    stumps = B.fit_stumps(df, COLUMNS, 5)
    monkeypatch.setattr(B, "MOST_ROWS", 300)
    shared = B.fit_boosted(df, COLUMNS, **growth)
    assert shared.margins(x) == pytest.approx(alone.margins(x), abs=1e-9)
    assert [s[1:3] for s in B.fit_stumps(df, COLUMNS, 5)] == [s[1:3] for s in stumps]


def test_folds_equal_separate_fits(spark):
    x, y, _ = table(400, 5)
    frame = pd.DataFrame(x, columns=COLUMNS).assign(label=y, fold=np.arange(400) % 3)
    growth = B.Growth(rounds=3, step=0.3)
    arms = {
        "all": {"alpha": 1.0, "columns": COLUMNS, "growth": growth},
        "less": {"alpha": 0.0, "columns": ["a", "c"], "growth": growth},
    }
    models = B.fit_folds(spark.createDataFrame(frame), 3, COLUMNS, arms)
    assert set(models) == {(a, i) for a in arms for i in range(3)}
    for (arm, i), model in models.items():
        seen = frame[frame.fold != i]
        counts = seen.label.value_counts().to_dict()
        weights = B.damped(counts, arms[arm]["alpha"])
        xs = seen[COLUMNS].to_numpy()
        if arm == "less":
            xs = xs * [1, 0, 1, 0]
        want, _ = plain_softmax(xs, seen.label.to_numpy(), seen.label.map(weights).to_numpy(), growth)
        assert model.margins(seen[COLUMNS].to_numpy()) == pytest.approx(want, abs=1e-7)


def plain_stumps(x, y, w, rounds):
    out = []
    classes = len(np.unique(y))
    w = w.copy()
    for _ in range(rounds):
        best = (-np.inf, None)
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= t
                sums = [np.bincount(y[s], w[s], 5) for s in (left, ~left)]
                pure = round(sum((s**2).sum() / s.sum() for s in sums) / w.sum(), 12)
                if pure > best[0]:
                    best = (pure, (f, t, *(int(s.argmax()) for s in sums)))
        f, t, a, b = best[1]
        hit = np.where(x[:, f] <= t, a, b) == y
        error = w[~hit].sum() / w.sum()
        if error >= 1 - 1 / classes:
            break
        alpha = math.log((1 - error) / error) + math.log(classes - 1)
        out.append((f, t, a, b, alpha))
        w = np.where(hit, w * math.exp(-alpha), w)
    return out


def test_stumps_equal_the_plain_version(spark):
    x, y, w = table(300, 7)
    df = spark.createDataFrame(pd.DataFrame(x, columns=COLUMNS).assign(label=y, weight=w))
    found = B.fit_stumps(df, COLUMNS, 12)
    want = plain_stumps(x, y, w, 12)
    assert [s[1:5] for s in found] == [s[:4] for s in want]
    assert [s[5] for s in found] == pytest.approx([s[4] for s in want])


def test_one_class_or_one_value_gives_shares(spark):
    df = spark.createDataFrame([(1.0, 2, 1.0)] * 20, "a double, label int, weight double")
    model = MO.fit_boosted(df, ["a"], rounds=3)
    row = model.score(df).first()
    assert row.p2 == pytest.approx(1.0) and len(model.trees) == 5


def test_saved_trees_come_back(spark, tmp_path):
    x, y, w = table()
    df = spark.createDataFrame(pd.DataFrame(x, columns=COLUMNS).assign(label=y, weight=w))
    model = B.fit_boosted(df, COLUMNS, rounds=2)
    model.save(str(tmp_path / "m"))
    loaded = B.SoftmaxTrees.load(spark, str(tmp_path / "m"), COLUMNS)
    assert (loaded.margins(x) == model.margins(x)).all()


def test_attributions_add_up_to_the_margins(spark):
    x, y, w = table()
    df = spark.createDataFrame(pd.DataFrame(x, columns=COLUMNS).assign(label=y, weight=w))
    model = B.fit_boosted(df, COLUMNS, rounds=4, step=0.2)
    leaves, base = TS.boosted_leaves(model.trees, 5)
    phi = TS.attribute(leaves, x[:30], 5)
    assert phi.sum(axis=1) + base == pytest.approx(model.margins(x[:30]).T, abs=1e-9)


def test_rows_of_equal_bins_are_one_whatever_their_label_and_fold(spark):
    x, y, w = table(400, 9)
    frame = pd.DataFrame(x[:, :2], columns=["a", "b"]).assign(label=y, weight=w, fold=np.arange(400) % 5)
    df = spark.createDataFrame(frame)
    found = B.collapsed(df, ["a", "b"], B.bin_edges(df, ["a", "b"])).toPandas()
    assert len(found) == len(np.unique(x[:, :2], axis=0))
    assert sum(cell["n"] for cells in found.cells for cell in cells) == 400


def test_columns_counted_together_have_the_sums_of_each(monkeypatch):
    monkeypatch.setattr(B, "MOST_JOINT", 12)
    rng = np.random.default_rng(2)
    sizes = [2, 7, 5, 2, 3]
    codes = np.unique(np.column_stack([rng.integers(0, s, 200) for s in sizes]), axis=0).astype(np.uint8)
    codes[:, 3] = codes[:, 0]
    rows = pd.DataFrame({"code": [c.tobytes() for c in codes], "n": 1})
    rows = rows.assign(**{f"{x}{c}": 1 for x in "nw" for c in range(5)})
    part = B.Part(rows, sizes, lambda own: own)
    slot, value = rng.integers(-1, 3, len(codes)), rng.random(len(codes))
    found = part.histogram(slot, 3, [value])[0]
    for c in (0, 1, 2, 4):
        for b in range(sizes[c]):
            want = [value[(slot == s) & (codes[:, c] == b)].sum() for s in range(3)]
            assert found[:, part.first[c] + b] == pytest.approx(want)
    assert not part.splits[part.column == 3].any()


@pytest.mark.parametrize("growth", [{"leaves": 15}, {"leaves": 31}, {"leaves": 64}, {"leaves": 80}])
def test_masks_reach_the_leaves_that_walking_does(growth):
    rng = np.random.default_rng(4)
    sizes = [40, 40, 3]
    codes = np.unique(np.column_stack([rng.integers(0, s, 900) for s in sizes]), axis=0).astype(np.uint8)
    label = rng.integers(0, 5, len(codes))
    rows = pd.DataFrame({"code": [c.tobytes() for c in codes], "n": 1})
    rows = rows.assign(**{f"{x}{c}": (label == c) * 1.0 for x in "nw" for c in range(5)})
    edges = [list(np.arange(s - 1) + 0.5) for s in sizes]
    options = B.Growth(rounds=3, step=0.3, l1=0.0, least_rows=1, least_hessian=0.0, **growth)
    model = B.SoftmaxTrees(B.grow_softmax(rows, edges, options, [0, 1, 2]), list("abc"))
    x = np.vstack([codes.astype(float), [[np.nan, 0.5, 1.0], [0.5, np.inf, -np.inf]]])
    assert model.margins(x) == pytest.approx(B.Masks(model.trees, None).margins(x), abs=1e-12)


def test_a_node_is_counted_from_its_own_rows():
    """A tree's nodes hold their rows' places; a split deals them out in order, and no other is read."""
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 4, (60, 3)).astype(np.uint8), axis=0)
    rows = pd.DataFrame({"code": [r.tobytes() for r in codes], "n": 1})
    rows = rows.assign(**{f"{x}{c}": 1.0 for x in "nw" for c in range(5)})
    part = B.Part(rows, [4, 4, 4], lambda own: own)
    tree = B.Tree()
    tree.learn(part.histograms([None], [part.n] * 3))
    tree.bin[0], tree.sums[0] = 1, np.full(3, float(len(codes)))
    tree.expand([0], part)
    sides = [np.flatnonzero(codes[:, 0] <= 1), np.flatnonzero(codes[:, 0] > 1)]
    assert [at.tolist() for at in tree.at[1:]] == [at.tolist() for at in sides]
    inside = tree.to_count()
    assert len(inside) == 1 and len(inside[0]) == min(map(len, sides))
    value = np.full(len(codes), np.nan)
    value[inside[0]] = 1.0
    found = part.histograms(inside, [value])[0, 0]
    want = np.concatenate([np.bincount(codes[inside[0], i], minlength=4) for i in range(3)])
    assert found.tolist() == want.tolist()


def small_rows(seed, sizes, n=900):
    rng = np.random.default_rng(seed)
    codes = np.unique(np.column_stack([rng.integers(0, s, n) for s in sizes]), axis=0).astype(np.uint8)
    label = rng.integers(0, 5, len(codes))
    rows = pd.DataFrame({"code": [c.tobytes() for c in codes], "n": 1})
    rows = rows.assign(**{f"{x}{c}": (label == c) * 1.0 for x in "nw" for c in range(5)})
    return codes, rows, [list(np.arange(s - 1) + 0.5) for s in sizes]


def test_classes_grown_side_by_side_are_the_same_trees():
    _, rows, edges = small_rows(11, [30, 30, 2])
    growth = B.Growth(rounds=6, step=0.3)
    alone = B.grow_softmax(rows, edges, growth, [0, 1, 2])
    assert len(alone) > 5
    for cores in (2, 4, 5):
        assert B.grow_softmax(rows, edges, growth, [0, 1, 2], cores=cores) == alone


def test_models_share_the_cores(spark):
    slots = spark.sparkContext.defaultParallelism
    assert B.task_cores(spark, 1) == (min(5, slots), None)
    assert B.task_cores(spark, 2 * slots) == (1, None)


def test_columns_of_few_thresholds_are_looked_up_together():
    codes, rows, edges = small_rows(12, [2, 2, 2, 2, 60])
    growth = B.Growth(rounds=3, step=0.3, l1=0.0, least_rows=1, least_hessian=0.0)
    model = B.SoftmaxTrees(B.grow_softmax(rows, edges, growth, range(5)), list("abcde"))
    tables = model._tables()
    assert all(len(t.groups) < len(t.cuts) for t in tables if len(t.cuts) > 2)
    x = np.vstack([codes.astype(float)] * 2)
    x[: len(codes)] += 0.25  # no threshold tells them apart
    assert model.margins(x) == pytest.approx(B.Masks(model.trees, None).margins(x), abs=1e-12)
    assert (model.margins(x)[:, : len(codes)] == model.margins(x)[:, len(codes) :]).all()


def test_topped_up_folds_share_a_table(spark):
    """Each model sees its training part and what top_up mints for it, from one table."""
    features = list(K.FEATURES)
    rng = np.random.default_rng(13)
    label = np.array([0] * 60 + [1] * 7 + [2] * 23 + [3] * 40)  # no row of class 4
    frame = pd.DataFrame(rng.integers(0, 3, (len(label), len(features))).astype(float), columns=features)
    frame = frame.assign(label=label, fold=np.arange(len(label)) % 3)
    rows, target, thin = spark.createDataFrame(frame), 30, {1, 2, 3} & set(K.AUGMENT_CLASSES)
    counts = [frame[frame.fold != i].label.value_counts().to_dict() for i in range(3)]
    missing = [BA.missing(n, target) for n in counts]
    assert all(set(m) == thin for m in missing) and missing[0] != missing[1]
    every = BA.top_up_folds(rows, missing, features, B.minted_for).withColumn("weight", F.lit(1.0))
    table, _ = B._prepared(every, features, B.BINS)
    for i in range(3):
        seen = B._rows_of(table, B.Spec(i)).toPandas()
        got = {c: seen[f"n{c}"].sum() for c in range(5)}
        assert got == {c: 30 if c in thin else counts[i].get(c, 0) for c in range(5)}
        bit = (-F.col("fold") - 1).bitwiseAND(F.lit(1 << i)) != 0
        mine = every.filter((F.col("fold") < 0) & bit).select("label", *features)
        alone = BA.top_up(rows.filter(F.col("fold") != i), target).filter("minted")
        assert mine.exceptAll(alone.select("label", *features)).isEmpty()
        assert mine.count() == sum(missing[i].values())
    real = B._rows_of(B._prepared(rows.withColumn("weight", F.lit(1.0)), features, B.BINS)[0], B.Spec(0))
    assert real.agg(F.sum("n")).first()[0] == (frame.fold != 0).sum()
    arms = {
        "real": MO.Recipe(fit=MO.fit_boosted, options={"rounds": 2}),
        "hybrid": MO.Recipe(fit=MO.fit_boosted, options={"rounds": 2}, top_up=True, target=target),
    }
    assert all(MO.shares_a_table(recipe, 3) for recipe in arms.values())
    found = MO.cross_validate_arms(rows, 3, arms)
    assert {arm: df.count() for arm, df in found.items()} == dict.fromkeys(arms, len(label))


def test_large_nodes_are_counted_by_pairs_of_groups(monkeypatch):
    monkeypatch.setattr(B, "MOST_JOINT", 4)
    monkeypatch.setattr(B, "LEAST_SHARED", 1)
    codes, rows, _ = small_rows(14, [4, 4, 4, 4], n=4000)
    part = B.Part(rows, [4, 4, 4, 4], lambda own: own)
    assert len(part.groups) == 4 and len(part.pairs) == 2
    value = np.random.default_rng(1).random(len(codes))
    for at in (None, np.arange(0, len(codes), 2), np.arange(5)):
        found = part.histograms([at], [value, part.n])
        here = slice(None) if at is None else at
        for j, v in enumerate((value, part.n)):
            want = np.concatenate([np.bincount(codes[here, i], v[here], 4) for i in range(4)])
            assert found[j, 0] == pytest.approx(want)
