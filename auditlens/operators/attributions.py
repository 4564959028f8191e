"""Linear attributions, risk drivers and incident summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.text import class_label, describe_feature, severity, whole_percent


def ranked(values: dict[str, tuple[int, str]], k: int) -> Column:
    """The k largest values by size as structs; the later feature first among equals.

    values maps a feature to its place in the vector and the SQL text of its
    value. The ranking happens inside the row, so nothing is shuffled.
    """
    entries = ", ".join(
        f"named_struct('tie', -{i}, 'value', {v}, 'feature', '{f}')"
        for f, (i, v) in values.items()
    )
    keyed = (
        f"transform(array({entries}), e -> named_struct("
        "'key', -abs(e.value), 'tie', e.tie, 'value', e.value, 'feature', e.feature))"
    )
    return F.expr(f"""transform(slice(array_sort({keyed}), 1, {k}), e -> named_struct(
        'feature', e.feature,
        'shap_value', round(e.value, 4),
        'contribution', round(abs(e.value), 4),
        'direction', CASE WHEN e.value > 0 THEN 'increases_risk' ELSE 'decreases_risk' END))""")


def with_linear_attributions(verdicts: DataFrame, k: int = 5) -> DataFrame:
    """Adds `top`: exact Shapley values of the pinned linear scorer.

    For a linear score they are weight * (value - baseline). Filter to the rows
    that need an explanation first. A feature without a weight always has the
    value 0, and of those only the last k can be among the first k.
    """
    weightless = [f for f in K.FEATURES if f not in K.SCORER_WEIGHTS][-k:]
    values = {}
    for i, f in enumerate(K.FEATURES):
        if f in K.SCORER_WEIGHTS:
            pick = " ".join(f"WHEN {c} THEN {K.SCORER_WEIGHTS[f][c]}D" for c in K.CLASS_IDS)
            baseline = K.SCORER_BASELINE[f]
            values[f] = (i, f"(CASE predicted_class {pick} END * ({f} - {baseline}D))")
        elif f in weightless:
            values[f] = (i, "0.0D")
    return verdicts.withColumn("top", ranked(values, k))


def base_value() -> float:
    """The scorer's mean over classes at the baseline."""
    at_baseline = [
        K.SCORER_BIAS[c] + sum(w[c] * K.SCORER_BASELINE[f] for f, w in K.SCORER_WEIGHTS.items())
        for c in K.CLASS_IDS
    ]
    return round(sum(at_baseline) / len(at_baseline), 4)


def driver_phrases(n: int = 3) -> Column:
    """The first n attributions that raise the risk, described and joined."""
    raising = F.filter("top", lambda e: e["direction"] == "increases_risk")
    phrases = F.transform(F.slice(raising, 1, n), lambda e: describe_feature(e["feature"]))
    # Through nullif, so that the phrases are worked out once.
    joined = F.nullif(F.array_join(phrases, ", "), F.lit(""))
    return F.coalesce(joined, F.lit(K.DEFAULT_DRIVERS))


def summary_text(contained_in: Column | None = None) -> Column:
    """The incident summary; contained_in is the containment time in seconds."""
    percent = whole_percent(F.col("confidence"))
    label = class_label(F.col("predicted_class"))
    benign = F.concat(
        F.lit("INFO: Activity classified as "), label, F.lit(" with "), percent,
        F.lit(" confidence. No malicious privilege escalation indicators detected."
              " No action required."),
    )
    action = F.lit("")
    if contained_in is not None:
        revoked = F.concat(
            F.lit(" Action Taken: IAM tokens revoked in "), contained_in.cast("string"), F.lit("s.")
        )
        action = F.when(contained_in.isNotNull(), revoked).otherwise("")
    alert = F.concat(
        severity(F.col("predicted_class")), F.lit(" ALERT: "), label, F.lit(" detected with "),
        percent, F.lit(" confidence. Top drivers: "), driver_phrases(), F.lit("."), action,
    )
    return F.when(F.col("predicted_class") == 0, benign).otherwise(alert)
