"""Classification metrics from one conditional count per confusion cell.

The 25 cells of a group are counted in one partial aggregation; everything else
is arithmetic on that single row, so no metric shuffles more than one row per
group and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens import constants as K

C = K.CLASS_IDS


def _cell(actual: int, predicted: int) -> str:
    return f"n{actual}{predicted}"


def _add(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _support(c: int) -> Column:
    return _add([F.col(_cell(c, j)) for j in C])


def _predicted(c: int) -> Column:
    return _add([F.col(_cell(i, c)) for i in C])


def _total() -> Column:
    return _add([F.col(_cell(i, j)) for i in C for j in C])


def _ratio(top: Column, bottom: Column) -> Column:
    """top/bottom, with 0 where there is nothing to divide by."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _precision(c: int) -> Column:
    return _ratio(F.col(_cell(c, c)), _predicted(c))


def _recall(c: int) -> Column:
    return _ratio(F.col(_cell(c, c)), _support(c))


def _f1(c: int) -> Column:
    return _ratio(2 * F.col(_cell(c, c)), _support(c) + _predicted(c))


def confusion_cells(
    df: DataFrame, by: list[str] = (), label: str = "label", predicted: str = "predicted_class"
) -> DataFrame:
    """One row per group with the 25 confusion counts n00..n44."""
    cells = [
        F.count_if((F.col(label) == i) & (F.col(predicted) == j)).alias(_cell(i, j))
        for i in C
        for j in C
    ]
    return df.groupBy(*by).agg(*cells)


def confusion(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per cell: the count and its share of the actual class's rows."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("label"),
                F.lit(j).alias("predicted_class"),
                F.col(_cell(i, j)).alias("n"),
                F.round(_ratio(F.col(_cell(i, j)), _support(i)), 4).alias("share"),
            )
            for i in C
            for j in C
        ]
    )
    return cells.select(*by, F.inline(rows))


def per_class(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class, four places."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("class_id"),
                F.lit(K.CLASS_LABELS[c]).alias("class_label"),
                F.round(_precision(c), 4).alias("precision"),
                F.round(_recall(c), 4).alias("recall"),
                F.round(_f1(c), 4).alias("f1"),
                _support(c).alias("support"),
            )
            for c in C
        ]
    )
    return cells.select(*by, F.inline(rows))


def macro(cells: DataFrame, by: list[str] = (), places: int | None = 4) -> DataFrame:
    """Accuracy and macro scores, averaged over classes in truth or prediction."""
    present = [F.when(_support(c) + _predicted(c) > 0, 1).otherwise(0) for c in C]

    def mean(score) -> Column:
        # An absent class scores 0, so it adds nothing to the sum.
        value = _ratio(_add([score(c) for c in C]), _add(present))
        return F.round(value, places) if places is not None else value

    correct = _ratio(_add([F.col(_cell(c, c)) for c in C]), _total())
    return cells.select(
        *by,
        (F.round(correct, places) if places is not None else correct).alias("accuracy"),
        mean(_precision).alias("macro_precision"),
        mean(_recall).alias("macro_recall"),
        mean(_f1).alias("macro_f1"),
        _total().alias("n"),
    )


def against_always_benign(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per class the support, beside whether the macro F1 beats always predicting benign.

    That baseline follows from the supports alone.
    """
    others = _add([F.when(_support(c) > 0, 1).otherwise(0) for c in C if c != 0])
    baseline = _ratio(2.0 * _support(0), _support(0) + _total()) / (others + 1)
    classes = F.array(
        *[F.struct(F.lit(c).alias("class_id"), _support(c).alias("support")) for c in C]
    )
    own = macro(cells, [*by, classes.alias("_classes"), baseline.alias("_benign")], places=None)
    return own.select(
        *by,
        F.inline("_classes"),
        F.round("_benign", 4).alias("benign_macro_f1"),
        (F.col("macro_f1") > F.col("_benign")).cast("int").alias("beats_benign"),
    ).select(*by, "class_id", "support", "benign_macro_f1", "beats_benign")


def fold_summary(fold_scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean and population deviation over folds; input has one macro row per fold."""
    return fold_scores.groupBy(*by).agg(
        F.count("*").alias("folds"),
        F.round(F.avg("macro_f1"), 4).alias("cv_macro_f1_mean"),
        F.round(F.stddev_pop("macro_f1"), 4).alias("cv_macro_f1_std"),
        F.round(F.avg("accuracy"), 4).alias("cv_accuracy_mean"),
        F.round(F.stddev_pop("accuracy"), 4).alias("cv_accuracy_std"),
    )


def best_alpha(summary: DataFrame) -> DataFrame:
    """The alpha with the best (macro F1, accuracy), the smallest one among equals."""
    order = F.struct("cv_macro_f1_mean", "cv_accuracy_mean", (-F.col("alpha")).alias("least"))
    return summary.agg(
        F.max_by("alpha", order).alias("alpha"),
        F.max_by("cv_macro_f1_mean", order).alias("cv_macro_f1_mean"),
        F.max_by("cv_accuracy_mean", order).alias("cv_accuracy_mean"),
    )


def arm_deltas(scores: DataFrame, base: str, other: str, values: list[str], by: list[str] = ()):
    """Per score: the value of both arms and other - base."""

    def of(arm: str, value: str) -> Column:
        return F.max(F.when(F.col("arm") == arm, F.col(value)))

    columns = []
    for value in values:
        columns += [
            of(base, value).alias(f"{value}_{base}"),
            of(other, value).alias(f"{value}_{other}"),
            F.round(of(other, value) - of(base, value), 4).alias(f"{value}_delta"),
        ]
    return scores.groupBy(*by).agg(*columns)
