"""Oversampling, boosting, attributions and streams against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.operators import attributions as AT
from auditlens.operators import models as MO
from auditlens.operators import smote as SM
from auditlens.operators import tree_shap as TS
from auditlens.session import materialise


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4)).round(1)
    y = rng.integers(0, 3, 400)
    x[:130], y[:130] = x[0], 1  # a third of all rows is one point
    rows = [(int(c), *map(float, v)) for c, v in zip(y, x)]
    return spark.createDataFrame(rows, "label int, a double, b double, c double, d double")


@pytest.mark.parametrize("block", [20, 1000])
def test_neighbours_are_exact(spark, cloud, block):
    pts = materialise(SM.points(cloud, list("abcd")), "points")
    near = SM.nearest_neighbours(pts, 5, block=block).toPandas()
    table = pts.toPandas()
    for _, group in table.groupby("label"):
        v = np.stack(group.vec)
        dist = ((v[:, None] - v[None]) ** 2).sum(-1)
        np.fill_diagonal(dist, np.inf)
        for i, vid in enumerate(group.vid):
            got = np.sort(near[(near.vid == vid) & (near.label == group.label.iloc[0])].dist)
            assert got == pytest.approx(np.sort(dist[i])[:5])


def test_smote_reaches_the_largest_class_between_neighbours(spark, cloud):
    out = SM.smote(cloud, list("abcd"), block=20).toPandas()
    sizes = out.groupby("label").size()
    assert sizes.nunique() == 1
    real = out[~out.synthetic]
    assert len(real) == 400
    for label, group in out[out.synthetic].groupby("label"):
        base = real[real.label == label][list("abcd")].to_numpy()
        new = group[list("abcd")].to_numpy()
        assert (new >= base.min(axis=0) - 1e-9).all() and (new <= base.max(axis=0) + 1e-9).all()


def test_smote_draws_from_exact_neighbours_over_many_cells(spark):
    """Every synthetic row lies between a point and one of its five nearest, by brute force."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 6))
    y = np.repeat([0, 1], [900, 600])
    names = list("abcdef")
    schema = "label int, " + ", ".join(f"{c} double" for c in names)
    rows = [(int(c), *map(float, v)) for c, v in zip(y, x)]
    out = SM.smote(spark.createDataFrame(rows, schema), names, block=10).toPandas()  # 60 cells
    new, thin = out[out.synthetic][names].to_numpy(), x[y == 1]
    assert len(new) == 300
    dist = ((thin[:, None] - thin[None]) ** 2).sum(-1)
    np.fill_diagonal(dist, np.inf)
    near = np.argsort(dist, axis=1)[:, :5]
    start, way = np.repeat(thin, 5, axis=0), (thin[near] - thin[:, None]).reshape(-1, 6)
    for row in new:
        t = ((row - start) * way).sum(1) / (way**2).sum(1)
        off = ((start + t[:, None] * way - row) ** 2).sum(1)
        assert (off[(t >= 0) & (t <= 1)] < 1e-18).any()


def test_smote_leaves_a_singleton_class_alone(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 3.0)], "label int, a double")
    assert SM.smote(df, ["a"]).filter("synthetic").isEmpty()


def test_samme_learns_and_scores_sum_to_one(spark):
    df = spark.range(300).select(
        (F.col("id") % 3).cast("int").alias("label"),
        (F.col("id") % 3 + F.rand(1) * 0.4).alias("a"),
        F.rand(2).alias("b"),
        F.lit(1.0).alias("weight"),
    ).cache()
    model = MO.fit_samme(df, ["a", "b"], rounds=6)
    scored = MO.with_verdict(model.score(df))
    assert scored.filter("predicted_class = label").count() >= 290
    assert scored.filter("abs(p0 + p1 + p2 + p3 + p4 - 1) > 0.001").isEmpty()


def test_recipes_fit_with_the_reference_parameters():
    def options(fit, **recipe):
        return MO.Recipe(fit=fit, **recipe).fit_options()

    served = options(MO.fit_boosted)
    assert served == {"rounds": 300, "step": 0.03, "leaves": 15, "l1": 0.1, "l2": 1.0,
                      "least_rows": 5}
    smoted = options(MO.fit_boosted, balance="smote")
    assert (smoted["rounds"], smoted["step"], smoted["leaves"]) == (200, 0.05, 31)
    assert options(MO.fit_forest) == {"trees": 200, "depth": 8}
    assert options(MO.fit_forest, balance="smote") == {"trees": 100, "depth": 12}
    second = options(MO.fit_boosted, options=MO.FITTERS["second_boosted"][1])
    assert (second["rounds"], second["step"], second["depth"]) == (150, 0.05, 6)


def test_tree_attributions_against_all_subsets(spark):
    df = spark.range(400).select(
        F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"), F.lit(1.0).alias("weight")
    ).withColumn("label", F.expr("int(a > 0.5) + int(b + c > 1.1)")).cache()
    model = MO.fit_forest(df, ["a", "b", "c"], trees=3, depth=3).model
    leaves, base = TS.forest_leaves(model)
    x = np.array(df.select("a", "b", "c").limit(15).collect())
    phi = TS.attribute(leaves, x, 3)

    def expected(node, row, known):
        if node.subtreeDepth() == 0:
            s = np.array(list(node.impurityStats().stats()))
            return s / s.sum()
        f, t = node.split().featureIndex(), node.split().threshold()
        left, right = node.leftChild(), node.rightChild()
        if f in known:
            return expected(left if row[f] <= t else right, row, known)
        n = node.impurityStats().count()
        return sum(
            ch.impurityStats().count() / n * expected(ch, row, known) for ch in (left, right)
        )

    roots = [t._call_java("rootNode") for t in model.trees]
    for r, row in enumerate(x[:4]):
        value = {
            s: sum(expected(n, row, set(s)) for n in roots) / len(roots)
            for k in range(4) for s in itertools.combinations(range(3), k)
        }
        for i in range(3):
            want = 0
            rest = [j for j in range(3) if j != i]
            for k in range(3):
                for s in itertools.combinations(rest, k):
                    w = math.factorial(k) * math.factorial(2 - k) / 6
                    want = want + w * (value[tuple(sorted((*s, i)))] - value[s])
            assert phi[r, i] == pytest.approx(want, abs=1e-9)
    assert base == pytest.approx(value[()])


def test_linear_attributions_add_up(spark, sf_dir):
    from auditlens.plans import frames

    rows = AT.with_linear_attributions(frames.verdicts(spark, sf_dir), k=32)
    zero = (0.0,) * 5
    got = rows.select(
        "predicted_class", *K.SCORER_WEIGHTS,
        F.expr("aggregate(top, 0D, (s, e) -> s + e.shap_value)").alias("total"),
    ).limit(50).collect()
    for r in got:
        want = sum(
            K.SCORER_WEIGHTS.get(f, zero)[r.predicted_class] * (r[f] - K.SCORER_BASELINE[f])
            for f in K.SCORER_WEIGHTS
        )
        assert r.total == pytest.approx(want, abs=0.002)
    assert isinstance(AT.base_value(), float)


def test_admission_against_a_plain_loop(spark, sf_dir):
    from auditlens.plans import frames, io

    got = io.stream_cap(spark, sf_dir).collect()
    gated = frames.verdicts(spark, sf_dir).filter("gated").select("tenant", "event_id", "time_us")
    admitted = {r.event_id: r.admitted for r in got}
    taken = {}
    rows = sorted(gated.collect(), key=lambda r: (r.time_us, r.event_id))
    assert len(rows) == len(got)
    for r in rows:
        recent = [t for t in taken.get(r.tenant, []) if t >= r.time_us - 600_000_000]
        if len(recent) < 5:
            recent.append(r.time_us)
            assert admitted[r.event_id]
        else:
            assert not admitted[r.event_id]
        taken[r.tenant] = recent


def test_blocks_find_exact_neighbours_far_from_the_origin():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (300, 3)) * 1e-4 + 1e4  # ties, and products that cancel
    x = np.unique(x, axis=0)
    frame = pd.DataFrame({"label": 0, "vid": [f"{i:03}" for i in range(len(x))], "vec": list(x)})
    found = SM._block_neighbours(frame.iloc[:40], frame, 5)
    want = []
    for i in range(40):
        dist = ((x - x[i]) ** 2).sum(axis=1)
        want += [(f"{i:03}", f"{j:03}") for d, j in sorted((d, j) for j, d in enumerate(dist) if j != i)[:5]]
    assert list(zip(found.vid, found.nvid, strict=True)) == want
    assert SM._block_neighbours(frame.iloc[:3], frame.iloc[:3], 5).shape == (6, 4)
    assert SM._block_neighbours(frame.iloc[:0], frame, 5).empty


def test_cells_are_ruled_out_only_if_all_their_points_are_too_far(monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(30, 4)) * 3
    members = centre[:, None, :] + rng.normal(size=(30, 20, 4)) * 0.3
    far = ((members - centre[:, None, :]) ** 2).sum(axis=2).max(axis=1)
    x = rng.normal(size=(50, 4)) * 3
    nearest = ((x[:, None, None, :] - members[None]) ** 2).sum(axis=3).min(axis=2)
    limit = rng.choice([0.5, 4.0, np.inf], 50)
    may = SM._may_reach(x, centre, far, limit)
    assert may[nearest <= limit[:, None]].all()
    assert not may.all() and may[np.isinf(limit)].all()
    lo, hi = members.min(axis=1), members.max(axis=1)
    rows, cols = np.nonzero(may)
    monkeypatch.setattr(SM, "MEASURED", 11)
    gap = np.maximum(np.maximum(lo[cols] - x[rows], x[rows] - hi[cols]), 0.0)
    assert SM._gaps(x, rows, cols, lo, hi) == pytest.approx((gap * gap).sum(axis=1))
    monkeypatch.setattr(SM, "AT_ONCE", 100)
    runs = [*SM._slices(50, 30)]
    assert max(r.stop - r.start for r in runs) * 30 <= 100
    assert [i for r in runs for i in range(50)[r]] == [*range(50)]


def test_small_cells_and_bounds_leave_the_exact_neighbours(spark):
    """As brute force has them, with fewer residents a probe than without small cells."""
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 4, (900, 2)) * 5.0, rng.normal(size=900).round(2)])
    rows = [(int(c), *map(float, v)) for c, v in zip(rng.integers(0, 2, 900), x)]
    df = spark.createDataFrame(rows, "label int, a double, b double, c double")
    pts = materialise(SM.points(df, list("abc")), "points")
    near = SM.nearest_neighbours(pts, 4, block=300, spacing=10).toPandas()
    for label, group in pts.toPandas().groupby("label"):
        v, vids = np.stack(group.vec), group.vid.to_numpy()
        dist = ((v[:, None] - v[None]) ** 2).sum(-1)
        np.fill_diagonal(dist, np.inf)
        for i, vid in enumerate(vids):
            want = sorted(zip(dist[i], vids))[:4]
            got = near[(near.vid == vid) & (near.label == label)].sort_values(["dist", "nvid"])
            assert got.dist.tolist() == pytest.approx([d for d, _ in want])
            assert len({*got.nvid}) == 4


def test_a_bound_rules_out_residents_but_no_neighbour():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 5, (200, 3)) + rng.normal(size=(200, 3)) * 0.01
    frame = pd.DataFrame({"label": 0, "vid": [f"{i:03}" for i in range(200)], "vec": list(x)})
    dist = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(dist, np.inf)
    kth = np.sort(dist, axis=1)[:, 4]
    want = SM._block_neighbours(frame.iloc[:60], frame, 5)
    for bound in (kth, kth * 30, np.where(kth > np.median(kth), np.inf, kth)):
        probes = frame.assign(bound=bound).iloc[:60]
        pd.testing.assert_frame_equal(SM._block_neighbours(probes, frame, 5), want)
    # nothing is measured that is beyond the bound
    none = frame.assign(bound=kth / 2).iloc[:60]
    found = SM._block_neighbours(none, frame, 5)
    assert (found.dist.to_numpy() <= (kth / 2)[found.vid.astype(int)] * (1 + 1e-6)).all()


def test_oversampled_rows_are_made_once(spark, cloud):
    """The fit reads a table, and does not look for the neighbours again in every pass."""
    seen = []

    def fit(df, columns):
        seen.append(df)

    MO.train(cloud, MO.Recipe(fit=fit, columns=tuple("abcd"), balance="smote"))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Join" not in plan
    assert seen[0].groupBy("label").count().select("count").distinct().count() == 1


def test_models_side_by_side_share_the_cores(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(MO.boosting, "fit_boosted", lambda df, columns, **options: asked.append(options))
    rows = spark.createDataFrame(
        [(i % 2, i % 3, float(i)) for i in range(30)], "label int, fold int, a double"
    )
    recipe = MO.Recipe(fit=MO.fit_boosted, columns=("a",), alpha=0.0, models=8)
    MO.train(rows, recipe)
    assert asked.pop()["models"] == 8
    monkeypatch.setattr(MO.Pipeline, "score", lambda self, df: df.withColumn("predicted_class", F.col("label")))
    MO.cross_validate(rows, 3, MO.Recipe(fit=MO.fit_boosted, columns=("a",), alpha=0.0))
    assert [options["models"] for options in asked] == [3, 3, 3]
