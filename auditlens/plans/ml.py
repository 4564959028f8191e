"""Registered queries: weights, scaling, splits, metrics, training, sampling."""

from __future__ import annotations

from dataclasses import replace
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.scoring import linear_verdicts
from auditlens.operators import balance as B
from auditlens.operators import metrics as ME
from auditlens.operators import models as MO
from auditlens.operators import ranking as R
from auditlens.operators import scaling as SC
from auditlens.operators import smote as SM
from auditlens.operators import tree_shap as TS
from auditlens.plans import frames as FR
from auditlens.session import materialise, scratch_path
from auditlens.sources.adapter import audit_events

FEATURES = list(K.FEATURES)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.featured(spark, sf_dir).select("event_id", "label", *FEATURES)


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights for every alpha of the sweep."""
    events = audit_events(spark, sf_dir)
    parts = [
        B.class_weights(events, "label", a).withColumn("alpha", F.lit(a)) for a in K.SWEEP_ALPHAS
    ]
    out = reduce(DataFrame.unionByName, parts)
    return out.select("alpha", "label", "n", F.round("weight", 6).alias("weight"))


def scaler_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = SC.scaler_stats(FR.featured(spark, sf_dir), FEATURES)
    return stats.select(
        "feature", *[F.round(c, 6).alias(c) for c in ("mean", "std", "divisor")]
    )


def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    scaled = SC.Scaler.fit(rows, FEATURES).transform(rows)
    return scaled.select("event_id", *[F.round(f, 4).alias(f) for f in FEATURES])


def embedding_scaler_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return SC.vector_stats(vectors, "embedding").select(
        "position", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")
    )


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit_events(spark, sf_dir).select("event_id", "label")
    return R.holdout_split(rows, "label", "event_id").select("event_id", "label", "split")


def kfold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit_events(spark, sf_dir).select("event_id", "label")
    return R.kfold(rows, "label", "event_id").select("event_id", "label", "fold")


def embedding_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    return R.kfold(rows, "label", "vec_id").select("vec_id", "label", "fold")


def sample_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = audit_events(spark, sf_dir).select("event_id", "label", "eventName")
    return R.sample_per_class(events, "label", "event_id").withColumnRenamed(
        "eventName", "event_name"
    )


# --- metrics on deterministic predictions -------------------------------------


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear_verdicts(_labelled(spark, sf_dir)).select(
        "event_id", "label", "predicted_class"
    )


def _arms(rows: DataFrame) -> DataFrame:
    """Predictions with and without the four real-signal features, scored in one pass."""
    arms = rows.withColumn("arm", F.explode(F.array(F.lit("with"), F.lit("without"))))
    blanked = arms.withColumns(
        {
            f: F.when(F.col("arm") == "with", F.col(f)).otherwise(F.lit(0.0))
            for f in K.REAL_SIGNAL_FEATURES
        }
    )
    kept = [c for c in ("arm", "event_id", "label", "fold") if c in blanked.columns]
    return linear_verdicts(blanked).select(*kept, "predicted_class")


def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ME.confusion(ME.confusion_cells(_predictions(spark, sf_dir)))


def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ME.per_class(ME.confusion_cells(_predictions(spark, sf_dir)))


def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ME.macro(ME.confusion_cells(_predictions(spark, sf_dir)))


def model_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of several predictors, among them always predicting benign."""
    arms = _arms(_labelled(spark, sf_dir))
    benign = audit_events(spark, sf_dir).select(
        F.lit("always_benign").alias("arm"), "event_id", "label",
        F.lit(0).alias("predicted_class"),
    )
    rows = arms.unionByName(benign)
    return ME.macro(ME.confusion_cells(rows, ["arm"]), ["arm"]).select("arm", "accuracy", "n")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arms(R.kfold(_labelled(spark, sf_dir), "label", "event_id"))


def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ME.confusion_cells(_folded(spark, sf_dir), ["arm", "fold"])
    return ME.fold_summary(ME.macro(cells, ["arm", "fold"], places=None), ["arm"])


def pooled_class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ME.confusion_cells(_folded(spark, sf_dir), ["arm"])
    return ME.per_class(cells, ["arm"]).select("arm", "class_id", "f1", "support")


def recipe_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ME.confusion_cells(_arms(_labelled(spark, sf_dir)), ["arm"])
    return ME.arm_deltas(
        ME.per_class(cells, ["arm"]), "without", "with", ["precision", "recall", "f1"],
        ["class_id"],
    )


def best_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep on probabilities re-weighted by the damped class weights."""
    rows = linear_verdicts(_labelled(spark, sf_dir)).select(
        "label", *[f"p{c}" for c in K.CLASS_IDS]
    )
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    total, k = sum(counts.values()), len(counts)
    choices = []
    for alpha in K.SWEEP_ALPHAS:
        raw = {c: (total / (k * n)) ** alpha for c, n in counts.items()}
        low = min(raw.values())
        weighted = [F.round(F.col(f"p{c}") * (raw.get(c, 0.0) / low), 9) for c in K.CLASS_IDS]
        best = F.greatest(*weighted)
        pick = F.lit(4)
        for c in reversed(K.CLASS_IDS[:-1]):
            pick = F.when(weighted[c] == best, c).otherwise(pick)
        choices.append(F.struct(F.lit(alpha).alias("alpha"), pick.alias("predicted_class")))
    spread = rows.select("label", F.inline(F.array(*choices)))
    scores = ME.macro(ME.confusion_cells(spread, ["alpha"]), ["alpha"])
    return ME.best_alpha(
        scores.select(
            "alpha",
            F.col("macro_f1").alias("cv_macro_f1_mean"),
            F.col("accuracy").alias("cv_accuracy_mean"),
        )
    )


# --- resampling ---------------------------------------------------------------


def minority_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of the thin classes with a target above their size, and minted events.

    The target is the size of the largest class, so that there is work to do.
    """
    rows = audit_events(spark, sf_dir).select("label")
    target = rows.groupBy("label").count().agg(F.max("count")).first()[0]
    minted = B.mint_events(B.top_up_slots(rows, target))
    return minted.select(
        "label", "n", F.col("eventTime").alias("event_time"), F.col("eventName").alias("event_name"),
        F.col("eventSource").alias("event_source"), F.col("userIdentity.type").alias("identity"),
        F.col("sourceIPAddress").alias("source_ip"),
        F.coalesce("errorCode", F.lit("")).alias("error_code"),
    )


def topped_up_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    target = rows.groupBy("label").count().agg(F.max("count")).first()[0]
    return (
        B.top_up(rows, target)
        .groupBy("label", "minted")
        .agg(F.count("*").alias("n"),
             F.round(F.sum("assume_role_freq"), 0).cast("bigint").alias("assume_role"),
             F.round(F.sum("lateral_movement_action"), 0).cast("bigint").alias("lateral"),
             F.round(F.sum("off_hours_activity"), 0).cast("bigint").alias("off_hours"))
        .withColumn("minted", F.col("minted").cast("int"))
    )


def noisy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = B.with_noise(_labelled(spark, sf_dir), FEATURES, "event_id")
    return noisy.select("event_id", "label", *[F.round(f, 6).alias(f) for f in FEATURES])


def smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class sizes before and after, and whether all new rows are inside their class's box."""
    rows = materialise(_labelled(spark, sf_dir), "labelled")
    scaled = SC.Scaler.fit(rows, FEATURES).transform(rows)
    grown = materialise(SM.smote(scaled, FEATURES), "grown")
    box = grown.filter("NOT synthetic").groupBy("label").agg(
        *[F.min(f).alias(f"lo_{f}") for f in FEATURES],
        *[F.max(f).alias(f"hi_{f}") for f in FEATURES],
    )
    inside = reduce(
        lambda a, b: a & b,
        [F.col(f).between(F.col(f"lo_{f}") - 1e-9, F.col(f"hi_{f}") + 1e-9) for f in FEATURES],
    )
    return (
        grown.join(F.broadcast(box), "label")
        .groupBy("label", F.col("synthetic").cast("int").alias("synthetic"))
        .agg(F.count("*").alias("n"), F.count_if(~inside).alias("outside"))
    )


def smote_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest distinct points of the same class, for all classes but the largest."""
    rows = _labelled(spark, sf_dir)
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    largest = max(counts, key=lambda c: (counts[c], -c))
    columns = [F.round(f, 6).alias(f) for f in FEATURES]
    thin = rows.filter(F.col("label") != largest).select("event_id", "label", *columns)
    first = SM.points(thin, FEATURES, extra=F.min("event_id").alias("event_id"))
    pts = materialise(first, "points")
    near = SM.nearest_neighbours(pts, 5)
    place = F.row_number().over(Window.partitionBy("label", "vid").orderBy("dist", "nvid"))
    return (
        near.join(pts.select("label", "vid", "event_id"), ["label", "vid"])
        .withColumn("place", place)
        .select("label", "event_id", "place", F.round("dist", 4).alias("dist"))
    )


def smote_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class sizes before and after oversampling of the embedding classes."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    size = table.select(F.size("embedding")).first()[0]
    columns = [f"e{i}" for i in range(size)]
    rows = table.select("label", *[F.col("embedding")[i].alias(c) for i, c in enumerate(columns)])
    return SM.smote(rows, columns).groupBy("label", "synthetic").agg(F.count("*").alias("n"))


# --- training -------------------------------------------------------------------

#: The primary model, as it is validated, compared and swept.
PRIMARY = MO.Recipe(fit=MO.fit_boosted)

def _holdout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(
        R.holdout_split(_labelled(spark, sf_dir), "label", "event_id"), "holdout"
    )


def _evaluated(rows: DataFrame, model: str, fit, options: dict) -> DataFrame:
    """Support by class on the hold-out part, and whether the model beats always benign."""
    predicted = MO.holdout_predictions(rows, MO.Recipe(fit=fit, options=options))
    scores = ME.against_always_benign(ME.confusion_cells(predicted))
    return scores.select(F.lit(model).alias("model"), *scores.columns)


def train_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(_holdout_rows(spark, sf_dir), "logistic", MO.fit_logistic, {})


def train_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(_holdout_rows(spark, sf_dir), "forest", *MO.FITTERS["forest"])


def train_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(_holdout_rows(spark, sf_dir), "boosted", *MO.FITTERS["boosted"])


def train_second_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitter = MO.FITTERS["second_boosted"]
    return _evaluated(_holdout_rows(spark, sf_dir), "second_boosted", *fitter)


def train_samme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(_holdout_rows(spark, sf_dir), "samme", *MO.FITTERS["samme"])


def four_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four models on one hold-out part, fitted side by side."""
    rows = _holdout_rows(spark, sf_dir)
    fit = inheritable_thread_target(spark)(
        lambda named: _evaluated(rows, named[0], *named[1])
    )
    with ThreadPool(len(MO.FITTERS)) as pool:
        return reduce(DataFrame.unionByName, pool.map(fit, MO.FITTERS.items(), chunksize=1))


def tree_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest attributions of every test row: with the base value they add up to its score."""
    rows = _holdout_rows(spark, sf_dir)
    fitted = MO.train(rows.filter(F.col("split") == "train"), MO.Recipe(fit=MO.fit_forest))
    leaves, base = TS.forest_leaves(fitted.model.model)
    scored = fitted.score(rows.filter(F.col("split") == "test")).select(
        "event_id", "predicted_class", "confidence", *FEATURES
    )
    explained = TS.with_tree_attributions(scored, FEATURES, leaves, len(base), k=len(FEATURES))
    of_class = F.element_at(
        F.array(*[F.lit(float(x)) for x in base]), F.col("predicted_class") + 1
    )
    total = F.aggregate("top", of_class, lambda acc, t: acc + t["shap_value"])
    # 32 values of four places
    return explained.select(
        "event_id", (F.abs(total - F.col("confidence")) < 0.005).cast("int").alias("adds_up")
    )


def primary_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary model's attributions of every test row: with the base value, its margin."""
    rows = _holdout_rows(spark, sf_dir)
    fitted = MO.train(rows.filter(F.col("split") == "train"), PRIMARY)
    leaves, base = TS.boosted_leaves(fitted.model.trees, len(K.CLASS_IDS))
    test = fitted.score(rows.filter(F.col("split") == "test"))
    scored = fitted.model.with_margins(test).select(
        "event_id", "predicted_class", "margins", *FEATURES
    )
    explained = TS.with_tree_attributions(scored, FEATURES, leaves, len(base), k=len(FEATURES))
    place = F.col("predicted_class") + 1
    of_class = F.element_at(F.array(*[F.lit(float(x)) for x in base]), place)
    total = F.aggregate("top", of_class, lambda acc, t: acc + t["shap_value"])
    return explained.select(
        "event_id",
        (F.abs(total - F.element_at("margins", place)) < 0.005).cast("int").alias("adds_up"),
    )


def published_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model saved under a version, read back by its pointer row.

    The model that was read back must give every row the verdict of the fitted one.
    """
    rows = materialise(_labelled(spark, sf_dir), "labelled")
    fitted = MO.train(rows, PRIMARY)
    path = scratch_path(spark, "models")
    MO.publish(spark, fitted, path, "v0")
    MO.publish(spark, fitted, path, "v1")
    version, loaded = MO.published(spark, path)
    verdicts = [m.score(rows).select("event_id", "predicted_class", "confidence")
                for m in (fitted, loaded)]
    different = verdicts[0].exceptAll(verdicts[1]).count()
    scaler = spark.read.parquet(f"{path}/{version}/scaler")
    return scaler.select(
        F.lit(version).alias("version"), F.lit(loaded.resampling).alias("resampling"),
        "feature", F.round("mean", 6).alias("mean"), F.round("divisor", 6).alias("divisor"),
        F.lit(different).cast("bigint").alias("different_verdicts"),
    )


def _fold_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = materialise(_labelled(spark, sf_dir), "labelled")
    folds = R.fold_count(rows, "label")
    return materialise(R.kfold(rows, "label", "event_id"), "folds"), folds


def _validated(rows: DataFrame, folds: int, arms: dict[str, MO.Recipe]) -> DataFrame:
    parts = [
        ME.against_always_benign(ME.confusion_cells(predicted, ["fold"]), ["fold"]).withColumn(
            "arm", F.lit(arm)
        )
        for arm, predicted in MO.cross_validate_arms(rows, folds, arms).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The served recipe of the primary model over all folds."""
    rows, folds = _fold_rows(spark, sf_dir)
    return _validated(rows, folds, {"served": PRIMARY})


def recipe_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversampling against class weights on one split (fold -1) and over all folds.

    All twelve models are prepared and fitted side by side.
    """
    recipes = {
        "old": replace(PRIMARY, balance="smote"),
        "new": replace(PRIMARY, alpha=1.0),
    }
    rows, (folded, folds) = MO.side_by_side(
        spark, [partial(_holdout_rows, spark, sf_dir), partial(_fold_rows, spark, sf_dir)]
    )
    arms = {arm: replace(recipe, models=2 + 2 * folds) for arm, recipe in recipes.items()}

    def split(arm: str) -> DataFrame:
        cells = ME.confusion_cells(MO.holdout_predictions(rows, arms[arm]))
        scores = ME.against_always_benign(cells)
        return scores.withColumn("arm", F.lit(arm)).withColumn("fold", F.lit(-1))

    works = [*[partial(split, arm) for arm in arms], partial(_validated, folded, folds, arms)]
    return reduce(DataFrame.unionByName, MO.side_by_side(spark, works))


def feature_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tuple(f for f in K.FEATURES if f not in K.REAL_SIGNAL_FEATURES)
    arms = {
        "without": replace(PRIMARY, columns=kept, alpha=1.0),
        "with": replace(PRIMARY, alpha=1.0),
    }
    return _validated(*_fold_rows(spark, sf_dir), arms)


def weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = {str(a): replace(PRIMARY, alpha=a) for a in K.SWEEP_ALPHAS}
    swept = _validated(*_fold_rows(spark, sf_dir), arms)
    return swept.withColumn("alpha", F.col("arm").cast("double")).drop("arm")


def hybrid_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With and without top-up of the thin classes to twice the rarest one."""
    rows, folds = _fold_rows(spark, sf_dir)
    target = 2 * rows.groupBy("label").count().agg(F.min("count")).first()[0]
    arms = {
        "real": replace(PRIMARY, alpha=1.0),
        "hybrid": replace(PRIMARY, alpha=1.0, top_up=True, target=target),
    }
    return _validated(rows, folds, arms)


QUERIES = {
    f.__name__: f
    for f in (
        class_weights, scaler_stats, scaled_features, embedding_scaler_stats, holdout_split,
        kfold_assignment, embedding_kfold, sample_per_class, confusion_counts, per_class_metrics,
        macro_metrics, model_accuracy, cv_summary, pooled_class_f1, recipe_delta, best_alpha,
        minority_topup, topped_up_set, noisy_features, smote, smote_neighbours, smote_embeddings,
        train_logistic,
        train_forest, train_boosted, train_second_boosted, train_samme, four_models,
        tree_attributions, primary_attributions,
        published_model, cross_validation, recipe_ab, feature_ablation, weight_sweep, hybrid_ab,
    )
}
