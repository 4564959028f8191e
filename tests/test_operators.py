"""Gates, trailing counts, ranks, weights, metrics, incidents, text."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions import scoring as S
from auditlens.functions import text as X
from auditlens.operators import balance as B
from auditlens.operators import gate as G
from auditlens.operators import metrics as ME
from auditlens.operators import ranking as R
from auditlens.operators import scaling as SC
from auditlens.operators.trailing import with_trailing_count
from auditlens.sources import incidents as ST


def test_trailing_count_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.randrange(0, 4000), rng.random() < 0.6, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, c boolean, i int")
    for current in (True, False):
        got = with_trailing_count(df, "k", "t", F.col("c"), 600, "n", current).collect()
        assert len(got) == len(rows)
        for r in got:
            hi = r.t if current else r.t - 1
            want = sum(1 for k, t, c, _ in rows if k == r.k and c and r.t - 600 <= t <= hi)
            assert r.n == want


def test_rolling_cap_bounds(spark):
    second = 1_000_000
    rows = [("x", t * second) for t in (0, 100, 200, 300, 400, 600, 601, 1001)]
    df = spark.createDataFrame(rows, "tenant string, t long")
    got = G.with_room(df, "tenant", "t", F.lit(True)).orderBy("t").collect()
    # 600 s old still counts, 601 s does not
    assert [r.recent_containments for r in got] == [1, 2, 3, 4, 5, 6, 6, 3]
    assert [r.room for r in got] == [4, 3, 2, 1, 0, 0, 0, 2]


def test_gate_decisions(spark):
    rows = [
        ("arn:aws:iam::1:user/bob", 0, 0.99, 5),
        ("arn:aws:iam::1:user/bob", 2, 0.7499, 5),
        ("arn:aws:iam::1:user/bob", 2, 0.75, 3),
        ("arn:aws:iam::1:user/Admin", 2, 0.9, 5),
        ("arn:aws:iam::1:root", 2, 0.9, 5),
        ("ops", 2, 0.9, 5),
        ("arn:aws:iam::1:user/bob", 2, 0.9, 0),
    ]
    df = spark.createDataFrame(
        rows, "principal string, predicted_class int, confidence double, room int"
    )
    got = G.with_decision(df, G.protected_names(["Ops "])).collect()
    assert [r.status for r in got] == [
        "monitor", "monitor", "pending", "blocked", "blocked", "blocked", "blocked",
    ]
    assert [r.protected for r in got] == [False, False, False, True, True, True, False]
    assert [r.blast_capped for r in got] == [False] * 6 + [True]


def test_confidence_is_rounded_before_the_gate(spark):
    df = spark.createDataFrame(
        [(0.25004, 0.74996, 0.0, 0.0, 0.0), (0.2501, 0.7499, 0.0, 0.0, 0.0),
         (0.4, 0.4, 0.2, 0.0, 0.0)],
        "p0 double, p1 double, p2 double, p3 double, p4 double",
    )
    rows = S.with_verdict(df).collect()
    assert [(r.predicted_class, r.confidence, r.gated) for r in rows] == [
        (1, 0.75, True), (1, 0.7499, False), (0, 0.4, False),
    ]


def test_group_rank_is_the_plain_window(spark):
    df = spark.range(3000).withColumn("label", (F.col("id") % 7 % 3).cast("int"))
    for digits in (1, 2, 4):
        got = R.with_group_rank(df, "label", "id", 5, digits).collect()
        by_class = {}
        for r in sorted(got, key=lambda r: _md5(f"5:{r.id}")):
            by_class.setdefault(r.label, []).append(r)
        for rows in by_class.values():
            assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
            assert {r.group_size for r in rows} == {len(rows)}


def _md5(text):
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


def test_splits_partition_the_rows(spark):
    df = spark.range(1003).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    split = R.holdout_split(df, "label", "id").groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in split} == {
        (0, "test"): 180, (0, "train"): 722, (1, "test"): 20, (1, "train"): 81,
    }
    folds = R.kfold(df, "label", "id").groupBy("label", "fold").count().collect()
    assert sum(r["count"] for r in folds) == 1003
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r.label == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    with pytest.raises(ValueError):
        R.kfold(spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id int, label int"), "label", "id")


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 80 + [(1,)] * 15 + [(2,)] * 5, "label int")
    for alpha in (0.0, 0.25, 1.0):
        got = {r.label: r.weight for r in B.class_weights(df, "label", alpha).collect()}
        raw = {c: (100 / (3 * n)) ** alpha for c, n in ((0, 80), (1, 15), (2, 5))}
        for c in raw:
            assert got[c] == pytest.approx(raw[c] / min(raw.values()))
        assert min(got.values()) == 1


def test_scaler_uses_population_deviation_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, 60.0), (2.0, 60.0), (6.0, 60.0)], "a double, b double")
    out = SC.Scaler.fit(df, ["a", "b"]).transform(df).collect()
    std = (((1 - 3) ** 2 + (2 - 3) ** 2 + (6 - 3) ** 2) / 3) ** 0.5
    assert [r.a for r in out] == pytest.approx([(x - 3) / std for x in (1, 2, 6)])
    assert [r.b for r in out] == [0, 0, 0]


def test_macro_scores_leave_out_absent_classes(spark):
    rows = [(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 0)]
    df = spark.createDataFrame(rows, "label int, predicted_class int")
    cells = ME.confusion_cells(df)
    got = ME.macro(cells).first()
    f1 = [2 * 6 / (8 + 7), 2 * 3 / (3 + 5), 0.0]
    assert got.macro_f1 == round(sum(f1) / 3, 4)
    assert got.accuracy == 0.75 and got.n == 12
    assert sum(r.n for r in ME.confusion(cells).collect()) == 12
    support = {r.class_id: r.support for r in ME.per_class(cells).collect()}
    assert support == {0: 8, 1: 3, 2: 1, 3: 0, 4: 0}


def test_best_alpha_takes_the_first_of_equals(spark):
    df = spark.createDataFrame(
        [(0.0, 0.9, 0.8), (0.25, 0.9, 0.9), (0.5, 0.9, 0.9), (1.0, 0.8, 0.99)],
        "alpha double, cv_macro_f1_mean double, cv_accuracy_mean double",
    )
    assert ME.best_alpha(df).first().alpha == 0.25


def test_one_decimal_is_rounded_on_the_binary_value(spark):
    values = [97.35, 97.25, 75.5, 0.0, 100.0, 12.05, 90.25, 99.95, 1 / 3] + [
        round(i / 10000, 4) * 100 for i in range(0, 10001, 7)
    ]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(X.one_decimal(F.col("v"))).collect()]
    want = [str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in values]
    assert got == want


def test_whole_percent_goes_to_even_halves(spark):
    df = spark.createDataFrame([(0.745,), (0.755,), (0.9,), (0.005,)], "v double")
    got = [r[0] for r in df.select(X.whole_percent(F.col("v"))).collect()]
    assert got == [f"{v * 100:.0f}%" for v in (0.745, 0.755, 0.9, 0.005)]


def test_strip_arn_and_principal(spark):
    rows = [("arn:aws:iam::1:user/a/b", None), ("arn:aws:iam::1:root", ""), ("", "joe"), (None, None)]
    df = spark.createDataFrame(rows, "arn string, userName string").select(
        F.struct("arn", "userName").alias("userIdentity")
    )
    got = df.select(X.strip_arn(F.col("userIdentity.arn")), X.principal()).collect()
    assert [r[0] for r in got] == ["b", "root", "", ""]
    assert [r[1] for r in got] == [rows[0][0], rows[1][0], "joe", K.UNKNOWN_PRINCIPAL]


def test_top_up_reaches_the_target_and_keeps_the_rest(spark):
    rows = [(0,)] * 50 + [(1,)] * 5 + [(2,)] * 200 + [(4,)] * 1
    df = spark.createDataFrame(rows, "label int").withColumns(
        {f: F.lit(0.0) for f in K.FEATURES}
    )
    got = {r.label: r["count"] for r in B.top_up(df, 120).groupBy("label").count().collect()}
    assert got == {0: 50, 1: 120, 2: 200, 4: 120}
    minted = B.top_up(df, 120).filter("minted")
    assert minted.filter("off_hours_activity + weekend_activity > 0").isEmpty()
    assert minted.filter("label = 1 and assume_role_freq = 0").isEmpty()
    assert minted.filter("label = 4 and lateral_movement_action = 0").isEmpty()
    assert minted.filter("label = 4 and access_denied_flag = 1").isEmpty()


def test_noise_is_normal_and_repeatable(spark):
    df = spark.range(20000).withColumn("a", F.lit(5.0))
    noisy = B.with_noise(df, ["a"], "id")
    stats = noisy.agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s")).first()
    assert stats.m == pytest.approx(5, abs=0.01) and stats.s == pytest.approx(0.25, abs=0.01)
    assert noisy.exceptAll(B.with_noise(df.repartition(7), ["a"], "id")).isEmpty()


def test_incident_defaults_changes_and_removals(spark):
    from auditlens.session import scratch_path

    path = scratch_path(spark, "inc")
    rows = spark.sql(
        "SELECT id, id % 3 AS user_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS created_at, "
        "CAST(NULL AS STRING) AS source, 2 AS predicted_class FROM range(30)"
    )
    ST.append(rows, path)
    stored = ST.read(spark, path)
    first = ST.read(spark, path, 1).orderBy("id").first()
    assert (first.id, first.source, first.action_status, first.confidence) == (
        1, "manual", "MONITORED", 0.0,
    )
    changes = spark.createDataFrame(
        [(1, 1, 1, "CONTAINED", True, "tok", True), (1, 1, 2, "REVERSED", True, None, True),
         (1, 4, 1, "CONTAINED", True, None, False), (2, 1, 9, "WRONG", True, None, False)],
        ST.CHANGES,
    )
    state = {r.id: r for r in ST.latest_state(stored, changes).collect()}
    assert (state[1].action_status, state[1].rollback) == ("REVERSED", None)
    assert state[4].action_status == "CONTAINED" and state[7].action_status == "MONITORED"
    assert len(state) == 30
    assert ST.newest(stored, 9999).count() == 30
    assert ST.newest(stored, 0).count() == 3
    assert ST.remove_owner(spark, path, 1) == 10
    assert ST.read(spark, path, 1).isEmpty() and ST.read(spark, path).count() == 20
    # rows that arrive later stay, also with ids below removed ones, and after a second removal
    ST.append(rows.filter("id = 7"), path)
    assert [r.id for r in ST.read(spark, path, 1).collect()] == [7]
    assert ST.remove_owner(spark, path, 1) == 1 and ST.remove_owner(spark, path, 1) == 0
    ST.append(rows.filter("id IN (4, 28)"), path)
    before = sorted(ST.read(spark, path).collect())
    assert sorted(r.id for r in before if r.user_id == 1) == [4, 28]
    ST.compact(spark, path, 1)
    assert sorted(ST.read(spark, path).collect()) == before
    files = spark.read.schema(ST.STORED).parquet(path)
    assert files.filter("user_id = 1").count() == 2


def test_triage_summary_counts_errors_and_truncates(spark):
    from auditlens.operators import triage as TR

    rows = spark.createDataFrame(
        [(1, None, 0, 0.9, False), (2, "bad", 3, 0.9, True), (3, None, 2, 0.8, True),
         (4, None, 1, 0.5, False), (5, None, 4, 1.0, True)],
        "row int, error string, predicted_class int, confidence double, gated boolean",
    )
    got = TR.summary(rows, max_rows=4).first().asDict()
    assert got == {
        "total_received": 5, "analyzed": 4, "truncated": 1, "threats_detected": 2,
        "incidents_recorded": 2, "benign": 1, "auto_contained": 1, "errors": 1,
        "avg_confidence": 0.55,
    }
    empty = TR.summary(rows.filter("row > 9")).first()
    assert (empty.analyzed, empty.avg_confidence, empty.truncated) == (0, 0.0, 0)


def test_capped_threats_keep_the_first_in_order(spark):
    from auditlens.operators import triage as TR

    rows = spark.range(300).select(
        F.col("id").alias("row"), (F.col("id") % 2).alias("upload"),
        F.lit(None).cast("string").alias("error"), (F.col("id") % 3).cast("int").alias("predicted_class"),
    )
    got = TR.capped_threats(rows, "upload", cap=10).collect()
    for upload in (0, 1):
        want = [i for i in range(300) if i % 2 == upload and i % 3][:10]
        assert sorted(r.row for r in got if r.upload == upload) == want


def test_samples_per_class_in_one_go(spark):
    df = spark.range(500).withColumn("label", (F.col("id") % 4).cast("int"))
    got = R.samples_per_class(df, "label", "id", (42, 7))
    for seed in (42, 7):
        want = {(r.label, r.id) for r in R.sample_per_class(df, "label", "id", seed).collect()}
        assert {(r.label, r.id) for r in got.filter(F.col("seed") == seed).collect()} == want
    with pytest.raises(R.EmptyClassError, match="125"):
        R.samples_per_class(df, "label", "id", (42,), needed=(0, 9))


def test_one_campaign_by_id(spark):
    from auditlens.operators import campaigns as CP

    catalogue = CP.catalogue(spark)
    assert CP.by_id(catalogue, K.CAMPAIGNS[1][0]).count() == 1
    with pytest.raises(KeyError):
        CP.by_id(catalogue, "none")


def test_deep_merge_equals_plain_recursion(spark):
    import copy
    import json
    import random

    from auditlens.operators import campaigns as CA

    draw = random.Random(3)

    def made(depth):
        kind = draw.random()
        if depth and kind < 0.6:
            return {draw.choice("abcd"): made(depth - 1) for _ in range(draw.randrange(4))}
        return draw.choice([None, 1, "x", [1, {"a": 2}], [], True, 2.5, {}])

    def plain(base, overrides):
        out = copy.deepcopy(base)
        for key, value in (overrides or {}).items():
            both = isinstance(value, dict) and isinstance(out.get(key), dict)
            out[key] = plain(out[key], value) if both else value
        return out

    objects = lambda: {k: made(4) for k in "abc"[: draw.randrange(4)]}
    pairs = [(objects(), objects()) for _ in range(300)]
    rows = [(json.dumps(b), json.dumps(o)) for b, o in pairs] + [('{"a": 1}', None), (None, '{"b": 2}')]
    df = spark.createDataFrame(rows, "b string, o string")
    got = [json.loads(r[0]) for r in df.select(CA.deep_merged("b", "o")).collect()]
    assert got == [plain(b, o) for b, o in pairs] + [{"a": 1}, {"b": 2}]


def test_slots_stay_where_their_range_is_and_draw_once(spark):
    """However large the table is thought to be, slots are not shuffled to a task a class."""
    rows = spark.range(600).selectExpr("cast(id % 7 as int) % 5 AS label")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        slots = B.top_up_slots(rows, 2 * B.SLOTS_A_TASK * 10)
        plan = slots._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert "splits=20" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    minted = B.mint_events(B.top_up_slots(rows, 300))
    assert minted._jdf.queryExecution().optimizedPlan().toString().count("md5(") == len(B.DRAWS)
