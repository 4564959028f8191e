"""Class probabilities, verdict columns and the pinned linear scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens import constants as K

PROBABILITIES = [f"p{c}" for c in K.CLASS_IDS]


def linear_logit(class_id: int) -> Column:
    """Bias plus weighted features, as one SQL expression.

    Written as text because a score has some hundred nodes, and building them one
    call at a time takes longer than running them on a small input.
    """
    terms = [f"{K.SCORER_BIAS[class_id]}D"] + [
        f"({weights[class_id]}D * {feature})" for feature, weights in K.SCORER_WEIGHTS.items()
    ]
    return F.expr(" + ".join(terms))


def with_softmax(df: DataFrame, logits: list[str]) -> DataFrame:
    """p0..p4 from logit columns, which are dropped.

    The probabilities come out of a one-element inline. Spark does not push a
    filter on a verdict through it; through plain projections it would copy the
    expressions below into the filter once per use, at every level, until the
    plan has millions of nodes.
    """
    top = f"greatest({', '.join(logits)})"
    exps = df.withColumns({f"_e{i}": F.expr(f"exp({z} - {top})") for i, z in enumerate(logits)})
    total = " + ".join(f"_e{i}" for i in range(len(logits)))
    probs = ", ".join(f"'{p}', _e{i} / ({total})" for i, p in enumerate(PROBABILITIES))
    kept = [f"`{c}`" for c in df.columns if c not in logits]
    return exps.selectExpr(*kept, f"inline(array(named_struct({probs})))")


def with_verdict(df: DataFrame, threshold: float = K.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Predicted class, confidence, gate and action from p0..p4.

    The first of several equal maxima wins, the confidence is rounded to four
    places, and the gate looks at the rounded value.
    """
    best = f"greatest({', '.join(PROBABILITIES)})"
    first = " ".join(f"WHEN p{c} = {best} THEN {c}" for c in K.CLASS_IDS[:-1])
    picked = df.withColumns(
        {
            "predicted_class": F.expr(f"CASE {first} ELSE {K.CLASS_IDS[-1]} END"),
            "confidence": F.expr(f"round({best}, 4)"),
        }
    )
    gated = f"confidence >= {threshold}D AND predicted_class <> 0"
    return picked.withColumns(
        {
            **{p: F.expr(f"round({p}, 4)") for p in PROBABILITIES},
            "gated": F.expr(gated),
            "action_status": F.expr(f"CASE WHEN {gated} THEN 'CONTAINED' ELSE 'MONITORED' END"),
        }
    )


def linear_verdicts(featured: DataFrame, threshold: float = K.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Score a feature frame with the pinned linear scorer; no shuffle."""
    logits = [f"_z{c}" for c in K.CLASS_IDS]
    scored = featured.withColumns({z: linear_logit(c) for c, z in enumerate(logits)})
    return with_verdict(with_softmax(scored, logits), threshold)


def probability_map() -> Column:
    """Class label -> probability."""
    pairs = [x for c in K.CLASS_IDS for x in (F.lit(K.CLASS_LABELS[c]), F.col(f"p{c}"))]
    return F.create_map(*pairs)


def top_probabilities(n: int = 3) -> Column:
    """The n most likely classes as structs, the lower class first among equals."""
    ranked = F.array_sort(
        F.array(
            *[
                F.struct((-F.col(f"p{c}")).alias("key"), F.lit(c).alias("class_id"))
                for c in K.CLASS_IDS
            ]
        )
    )
    return F.transform(
        F.slice(ranked, 1, n),
        lambda s: F.struct(s["class_id"].alias("class_id"), (-s["key"]).alias("probability")),
    )
