"""Forests on rows of equal bins against plain versions that look at every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlens.operators import forest as FO
from auditlens.operators import models as MO
from auditlens.operators import tree_shap as TS
from auditlens.operators.boosting import bin_edges, collapsed

NAMES = list("abcd")


def frame(spark, rows=3000, seed=3, copies=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 2, rows), rng.integers(0, 3, rows),
                         rng.normal(size=rows).round(2), rng.integers(0, 5, rows)]).astype(float)
    y = np.where(rng.random(rows) < 0.1, 2, (x[:, 0] + (x[:, 2] > 0.3) > 1).astype(int))
    made = [(*map(float, v), int(c), 1.0 + 0.5 * int(c)) for v, c in zip(x, y)]
    schema = ", ".join(f"{c} double" for c in NAMES) + ", label int, weight double"
    df = spark.createDataFrame(made, schema)
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_copy")


def held_blocks(df):
    edges = bin_edges(df, NAMES, FO.BINS)
    table = collapsed(df.withColumn("fold", F.lit(0)), NAMES, edges)
    return edges, [FO.Block.of(r, len(NAMES)) for r in FO.blocks(table).collect()]


def test_equal_rows_are_one_row_of_a_fit(spark):
    """Thirty copies of every row: no more rows to read than of one, and all are counted."""
    _, once = held_blocks(frame(spark))
    _, often = held_blocks(frame(spark, copies=30))
    assert sum(len(b.n) for b in often) == sum(len(b.n) for b in once) < 3000
    assert sum(b.n.sum() for b in often) == 90_000
    assert isinstance(MO.fit_forest(frame(spark), NAMES, trees=2, depth=2), FO.ForestModel)


def test_equal_rows_are_drawn_as_often_as_each_by_itself():
    block = FO.Block(1, np.zeros((50, 1), np.uint8), np.zeros(50, int), np.ones(50), np.full(50, 40))
    drawn = []
    for number in range(400):
        tree = FO.Growing(number, taken=np.zeros((1, 1), int))
        again = [FO.count_nodes(tree, [block], 42, 1, 1).sum() for _ in range(2)]
        assert again[0] == again[1]  # a level and a retry see the same draws
        drawn.append(again[0])
    # the sum of 2,000 draws with mean and variance 1
    assert np.mean(drawn) == pytest.approx(2000, abs=10)
    assert np.var(drawn) == pytest.approx(2000, rel=0.3)


def plain(x, y, w, sizes, depth, classes):
    """(column, bin) splits of least impurity by brute force; a leaf is its weights."""
    stats = np.array([w[y == c].sum() for c in range(classes)])
    best = (0.0, None)
    whole = stats.sum()
    for f in range(x.shape[1]) if depth else ():
        for b in range(sizes[f] - 1):
            left = x[:, f] <= b
            if not left.any() or left.all():
                continue
            sides = [np.array([w[(y == c) & s].sum() for c in range(classes)]) for s in (left, ~left)]
            gain = (sum((s**2).sum() / s.sum() for s in sides) - (stats**2).sum() / whole) / whole
            if round(gain, 12) > best[0]:
                best = (round(gain, 12), (f, b, left))
    if best[1] is None:
        return stats
    f, b, left = best[1]
    sides = [plain(x[s], y[s], w[s], sizes, depth - 1, classes) for s in (left, ~left)]
    if all(isinstance(s, np.ndarray) for s in sides) and sides[0].argmax() == sides[1].argmax():
        return stats
    return (f, b, *sides)


@pytest.mark.parametrize("block_rows, nodes", [(65_536, 128), (100, 2)])
def test_a_tree_makes_the_splits_of_a_plain_one(spark, monkeypatch, block_rows, nodes):
    """One tree, which may use all columns, on many and on few tasks and runs of nodes."""
    monkeypatch.setattr(FO, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(FO, "NODES", nodes)
    df = frame(spark)
    edges = bin_edges(df, NAMES, FO.BINS)
    kept = []
    made = FO.blocks
    monkeypatch.setattr(FO, "blocks", lambda table: kept.append(made(table)) or kept[0])
    (tree,) = FO.fit(df, NAMES, trees=1, depth=5, seed=7).model.trees
    rows = [FO.Block.of(r, len(NAMES)) for r in kept[0].collect()]
    drawn = [np.random.default_rng([7, 0, b.number]).poisson(b.n) for b in rows]
    x, y = np.concatenate([b.codes for b in rows]), np.concatenate([b.label for b in rows])
    w = np.concatenate([d * b.weight for d, b in zip(drawn, rows)])
    there = w > 0

    def same(node, want):
        if isinstance(want, np.ndarray):
            assert node.subtreeDepth() == 0
            assert node.impurityStats().stats() == pytest.approx(want)
            return
        f, b, left, right = want
        assert (node.split().featureIndex(), node.split().threshold()) == (f, edges[f][b])
        same(node.leftChild(), left)
        same(node.rightChild(), right)

    assert tree.rootNode().subtreeDepth() > 2
    same(tree.rootNode(), plain(x[there], y[there], w[there], [len(e) + 1 for e in edges], 5, 3))


def test_scores_are_mean_shares_and_survive_saving(spark, tmp_path):
    df = frame(spark, 800)
    model = MO.fit_forest(df, NAMES, trees=7, depth=4)
    x = np.array(df.select(*NAMES).limit(60).collect())

    def share(node, row):
        while node.subtreeDepth():
            split = node.split()
            left = row[split.featureIndex()] <= split.threshold()
            node = node.leftChild() if left else node.rightChild()
        return np.array(node.impurityStats().stats()) / node.impurityStats().count()

    want = [np.mean([share(t.rootNode(), row) for t in model.model.trees], axis=0) for row in x]
    assert model.model.shares(x) == pytest.approx(np.array(want))
    model.save(str(tmp_path / "forest"))
    again = FO.ForestModel.load(spark, str(tmp_path / "forest"), NAMES)
    assert again.model.shares(x) == pytest.approx(np.array(want))
    scored = again.score(df.limit(60)).select("p0", "p1", "p2", "p3", "p4").collect()
    assert all(sum(r) == pytest.approx(1.0) and r.p3 == r.p4 == 0.0 for r in scored)


def test_as_good_as_a_forest_on_every_row(spark):
    from pyspark.ml.classification import RandomForestClassifier

    df, test = frame(spark, seed=1, copies=3), frame(spark, seed=2)
    own = MO.fit_forest(df, NAMES, trees=30, depth=5)
    spark_model = RandomForestClassifier(weightCol="weight", numTrees=30, maxDepth=5, seed=42)
    other = MO.VectorModel(spark_model.fit(MO._training_frame(df, NAMES)), NAMES)

    def probability_of_label(model):
        p = F.element_at(F.array("p0", "p1", "p2", "p3", "p4"), F.col("label") + 1)
        return model.score(test).agg(F.avg(p)).first()[0]

    assert probability_of_label(own) == pytest.approx(probability_of_label(other), abs=0.03)


def test_every_row_has_its_attributions(spark):
    """Copies, and rows that no threshold tells apart, too."""
    train = frame(spark, 800)
    model = MO.fit_forest(train, NAMES, trees=5, depth=4)
    leaves, base = TS.forest_leaves(model.model)
    rows = frame(spark, 200, seed=9, copies=25).withColumn("predicted_class", F.col("label"))
    rows = rows.withColumn("id", F.monotonically_increasing_id()).localCheckpoint()
    out = TS.with_tree_attributions(rows, NAMES, leaves, len(base), k=4)
    got = {r.id: {t.feature: t.shap_value for t in r.top} for r in out.collect()}
    known = rows.collect()
    assert out.columns == ["label", "weight", "predicted_class", "id", "top"]
    assert len(got) == len(known) == 5000
    phi = TS.attribute_class(leaves, np.array([r[:4] for r in known]), np.array([r.label for r in known]))
    for r, values in zip(known, phi):
        assert [got[r.id][c] for c in NAMES] == pytest.approx(values, abs=6e-5)


def test_places_are_explained_as_their_values(spark):
    leaves, _ = TS.forest_leaves(MO.fit_forest(frame(spark, 800), NAMES, trees=5, depth=4).model)
    cuts, placed = TS.in_places(leaves, len(NAMES))
    x = np.random.default_rng(5).normal(size=(500, 4)).round(1) * 3
    x[:4] = [[c[0] if len(c) else 0.0 for c in cuts], [np.nan] * 4, [9e9] * 4, [-9e9] * 4]
    places = np.column_stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)])
    assert len(np.unique(places, axis=0)) < len(x)
    right = np.nan_to_num(x, nan=9e9)
    assert TS.attribute(placed, places, 3) == pytest.approx(TS.attribute(leaves, right, 3))
