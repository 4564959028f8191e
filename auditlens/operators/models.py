"""Classifiers: multinomial logistic, forest, boosted softmax trees, SAMME.

A fitted model is anything with `score(df)`, which adds p0..p4 to a frame that
has the (scaled) feature columns. Training input has the feature columns,
`label` in 0..4 and `weight`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import astuple, dataclass, field, replace
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.scoring import PROBABILITIES, with_verdict
from auditlens.operators import balance, boosting, forest
from auditlens.operators.scaling import Scaler
from auditlens.operators.smote import smote
from auditlens.session import materialise

CLASSES = K.CLASS_IDS
#: Points a cell of the neighbour search. Within a class only a few of the features vary freely,
#: so small cells rule out most other points.
SPACING = 250


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def _training_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    return assemble(df, columns).select(
        "features", F.col("label").cast("double").alias("label"), F.col("weight").cast("double")
    )


def _unpack(df: DataFrame, vector: str, size: int) -> DataFrame:
    """p0..p4 from a probability vector that may be shorter than five."""
    array = df.withColumn("_p", vector_to_array(vector))
    return array.withColumns(
        {
            p: F.col("_p")[c] if c < size else F.lit(0.0)
            for c, p in enumerate(PROBABILITIES)
        }
    )


@dataclass
class VectorModel:
    """A Spark ML classifier with a probability column."""

    model: object
    columns: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(assemble(df, self.columns))
        return _unpack(scored, "probability", self.model.numClasses).drop(
            "features", "rawPrediction", "probability", "prediction", "_p"
        )

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, columns: list[str]) -> VectorModel:
        return cls(DefaultParamsReader.loadParamsInstance(path, spark), columns)


def fit_logistic(df: DataFrame, columns: list[str], iterations: int = 50,
                 reg: float = 1e-4) -> VectorModel:
    estimator = LogisticRegression(
        family="multinomial", weightCol="weight", maxIter=iterations, regParam=reg
    )
    return VectorModel(estimator.fit(_training_frame(df, columns)), columns)


def fit_forest(df: DataFrame, columns: list[str], trees: int = 100, depth: int = 8,
               seed: int = 42) -> forest.ForestModel:
    return forest.fit(df, columns, trees, depth, seed)


def fit_boosted(
    df: DataFrame, columns: list[str], models: int = 1, **growth
) -> boosting.SoftmaxTrees:
    """The boosted model; growth as in boosting.Growth. models: fits that share the cores."""
    return boosting.fit_boosted(df, columns, models=models, **growth)


@dataclass(frozen=True)
class Stump:
    feature: str
    threshold: float
    left: int
    right: int
    alpha: float

    def prediction(self) -> Column:
        return F.when(F.col(self.feature) <= self.threshold, self.left).otherwise(self.right)


STUMPS = "n int, feature string, threshold double, left int, right int, alpha double"


@dataclass
class SammeModel:
    """Stumps with their votes; scoring is one expression, with no lineage to cut."""

    stumps: list[Stump] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        rows = [(n, *astuple(stump)) for n, stump in enumerate(self.stumps)]
        spark.createDataFrame(rows, STUMPS).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, columns: list[str]) -> SammeModel:
        rows = spark.read.parquet(path).orderBy("n").collect()
        return cls([Stump(*tuple(r)[1:]) for r in rows], columns)

    def votes(self, c: int) -> Column:
        """Sum of the votes for class c."""
        parts = [F.when(s.prediction() == c, s.alpha).otherwise(0.0) for s in self.stumps]
        return sum(parts, F.lit(0.0))

    def score(self, df: DataFrame) -> DataFrame:
        """Probabilities as a softmax of the vote shares, as SAMME defines them."""
        total = sum(s.alpha for s in self.stumps) or 1.0
        decision = {
            f"_d{c}": self.votes(c) / total - (F.lit(total) - self.votes(c)) / total / 4.0
            for c in CLASSES
        }
        scored = df.withColumns(decision)
        exps = {f"_x{c}": F.exp(F.col(f"_d{c}") / 4.0) for c in CLASSES}
        scored = scored.withColumns(exps)
        norm = sum((F.col(f"_x{c}") for c in CLASSES), F.lit(0.0))
        share = F.struct(*[(F.col(f"_x{c}") / norm).alias(p) for c, p in enumerate(PROBABILITIES)])
        return scored.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(share)))


def fit_samme(df: DataFrame, columns: list[str], rounds: int = 80) -> SammeModel:
    """Boosted stumps with class votes; all rounds are one job."""
    stumps = boosting.fit_stumps(df, columns, rounds)
    return SammeModel([Stump(columns[f], *rest) for _, f, *rest in stumps], columns)


#: What the reference fits its primary model and its forest with: on real rows with weights
#: ("served"), and after oversampling ("smote").
REFERENCE = {
    fit_boosted: {
        "served": {
            "rounds": 300, "step": 0.03, "leaves": 15, "l1": 0.1, "l2": 1.0, "least_rows": 5,
        },
        "smote": {
            "rounds": 200, "step": 0.05, "leaves": 31, "l1": 0.0, "l2": 0.0, "least_rows": 20,
        },
    },
    fit_forest: {
        "served": {"trees": 200, "depth": 8},
        "smote": {"trees": 100, "depth": 12},
    },
}

#: The four models and the options the queries fit them with, besides the ones of REFERENCE.
FITTERS = {
    "boosted": (fit_boosted, {}),
    "second_boosted": (
        fit_boosted,
        {"rounds": 150, "step": 0.05, "depth": 6, "leaves": 64, "l1": 0.0, "l2": 1.0,
         "least_rows": 1, "least_hessian": 1.0},
    ),
    "forest": (fit_forest, {}),
    "samme": (fit_samme, {}),
}


# --- recipes ------------------------------------------------------------------


def side_by_side(spark: SparkSession, works: list[Callable]) -> list:
    """What each of the works gives; their jobs run at the same time."""
    run = inheritable_thread_target(spark)(lambda work: work())
    with ThreadPool(len(works)) as pool:
        return pool.map(run, works, chunksize=1)


@dataclass
class Recipe:
    """How a training part is prepared and what is fitted on it.

    balance is 'weights' (damped class weights), 'smote' or 'none'; top_up adds
    minted rows of the thin classes before scaling. Options that are not given are the ones
    REFERENCE has for the balance. models is how many are fitted side by side, this one included:
    boosted ones share the cores.
    """

    fit: object = fit_logistic
    options: dict = field(default_factory=dict)
    columns: tuple[str, ...] = K.FEATURES
    balance: str = "weights"
    alpha: float = K.SERVED_ALPHA
    top_up: bool = False
    target: int = K.AUGMENT_TARGET
    models: int = 1

    def fit_options(self) -> dict:
        mode = "smote" if self.balance == "smote" else "served"
        return REFERENCE.get(self.fit, {}).get(mode, {}) | self.options


@dataclass
class Pipeline:
    """A fitted scaler and model."""

    scaler: Scaler
    model: object
    resampling: str

    def score(self, df: DataFrame) -> DataFrame:
        """Verdict columns; the features come out scaled."""
        return with_verdict(self.model.score(self.scaler.transform(df)))


def train(train_rows: DataFrame, recipe: Recipe) -> Pipeline:
    """Fit scaler and model on the training part only."""
    columns = list(recipe.columns)
    rows = train_rows
    if recipe.top_up:
        rows = balance.top_up(rows, recipe.target)
    scaler = Scaler.fit(rows, columns)
    scaled = scaler.transform(rows)
    if recipe.balance == "smote":
        # Written once: bins are looked for in two passes over it and filled in a third.
        grown = materialise(smote(scaled, columns, spacing=SPACING), "grown")
        ready = grown.withColumn("weight", F.lit(1.0))
        note = "SMOTE (train fold)"
    elif recipe.balance == "weights" and recipe.alpha > 0:
        ready = balance.with_sample_weight(scaled, "label", recipe.alpha)
        note = f"damped class weights alpha={recipe.alpha:g} (no SMOTE)"
    else:
        ready = scaled.withColumn("weight", F.lit(1.0))
        note = "no class weighting (alpha=0, no SMOTE)"
    beside = {"models": recipe.models} if recipe.fit is fit_boosted else {}
    model = recipe.fit(ready, columns, **beside, **recipe.fit_options())
    return Pipeline(scaler, model, note)


def holdout_predictions(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """Predictions on the test part of a frame with a `split` column."""
    fitted = train(rows.filter(F.col("split") == "train"), recipe)
    return fitted.score(rows.filter(F.col("split") == "test")).select(
        "label", "predicted_class", "confidence"
    )


def cross_validate(rows: DataFrame, folds: int, recipe: Recipe) -> DataFrame:
    """Predictions of every row by the model that did not see its fold.

    The folds are fitted side by side; the predictions stay lazy and are evaluated together.
    """

    recipe = replace(recipe, models=max(recipe.models, folds))

    def one(i: int) -> DataFrame:
        fitted = train(rows.filter(F.col("fold") != i), recipe)
        return fitted.score(rows.filter(F.col("fold") == i)).select(
            "fold", "label", "predicted_class"
        )

    with ThreadPool(folds) as pool:
        parts = pool.map(inheritable_thread_target(rows.sparkSession)(one), range(folds))
    return reduce(DataFrame.unionByName, parts)


def shares_a_table(recipe: Recipe, folds: int = 1) -> bool:
    """Whether a recipe's folds are weightings of the same rows, so that they fit together.

    Minted rows are told apart by the folds they are for, which are bits.
    """
    by_bits = not recipe.top_up or folds <= 30
    return recipe.fit is fit_boosted and recipe.balance != "smote" and by_bits


def cross_validate_arms(
    rows: DataFrame, folds: int, arms: dict[str, Recipe]
) -> dict[str, DataFrame]:
    """Predictions of every row for every arm.

    All boosted arms without oversampling are fitted side by side, all their folds on one table,
    or on one a target where thin classes are topped up. Trees do not depend on the columns' scale, so they see the columns as they are.
    Each of the other arms runs beside them.
    """
    together = {arm: recipe for arm, recipe in arms.items() if shares_a_table(recipe, folds)}
    found: dict[str, DataFrame] = {}
    every = max([folds * len(arms), *[recipe.models for recipe in arms.values()]])

    def alone(arm: str) -> None:
        found[arm] = cross_validate(rows, folds, replace(arms[arm], models=every))

    def joint() -> None:
        options = {
            arm: {
                "alpha": recipe.alpha if recipe.balance == "weights" else 0.0,
                "columns": recipe.columns,
                "growth": boosting.Growth(**recipe.fit_options()),
                "target": recipe.target if recipe.top_up else None,
            }
            for arm, recipe in together.items()
        }
        models = boosting.fit_folds(rows, folds, list(K.FEATURES), options, models=every)
        for arm in together:
            parts = [
                with_verdict(models[arm, i].score(rows.filter(F.col("fold") == i))).select(
                    "fold", "label", "predicted_class"
                )
                for i in range(folds)
            ]
            found[arm] = reduce(DataFrame.unionByName, parts)
    works = [partial(alone, arm) for arm in arms if arm not in together]
    side_by_side(rows.sparkSession, [*works, *([joint] if together else [])])
    return {arm: found[arm] for arm in arms}


# --- published models -----------------------------------------------------------

KINDS = {
    "vector": VectorModel, "softmax": boosting.SoftmaxTrees, "forest": forest.ForestModel,
    "samme": SammeModel,
}


def publish(spark: SparkSession, pipeline: Pipeline, path: str, version: str) -> str:
    """Save a model under a new version; only then add a pointer row for it.

    Pointer rows are never changed: the newest one names the model in use. A failed save,
    or a failed pointer, leaves the one before in use.
    """
    target = f"{path}/{version}"
    pipeline.model.save(f"{target}/model")
    stats = [
        (c, pipeline.scaler.means[c], pipeline.scaler.divisors[c]) for c in pipeline.scaler.means
    ]
    spark.createDataFrame(stats, "feature string, mean double, divisor double").coalesce(
        1
    ).write.parquet(f"{target}/scaler")
    kind = next(k for k, model in KINDS.items() if isinstance(pipeline.model, model))
    columns = list(pipeline.model.columns)
    pointer = spark.createDataFrame(
        [(version, pipeline.resampling, kind, columns, time.time_ns())],
        "version string, resampling string, kind string, columns array<string>, published bigint",
    )
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return target


def published(spark: SparkSession, path: str) -> tuple[str, Pipeline]:
    """The version in use and its model, read back."""
    row = spark.read.parquet(f"{path}/versions").orderBy(F.desc("published")).first()
    target = f"{path}/{row.version}"
    stats = spark.read.parquet(f"{target}/scaler").collect()
    scaler = Scaler({r.feature: r["mean"] for r in stats}, {r.feature: r.divisor for r in stats})
    model = KINDS[row.kind].load(spark, f"{target}/model", list(row.columns))
    return row.version, Pipeline(scaler, model, row.resampling)
