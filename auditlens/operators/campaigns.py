"""Campaign steps, their scoring and their rollups, and the attack graph."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from auditlens import constants as K
from auditlens.functions.features import with_features
from auditlens.functions.scoring import linear_verdicts
from auditlens.functions.text import class_label


def catalogue(spark: SparkSession) -> DataFrame:
    """One row per campaign with its steps as an array of structs."""
    step = (
        "name string, technique_id string, tactic string, seed_class int, event_name string, "
        "event_source string, mfa string, recipient string"
    )
    rows = [
        (
            cid, name, tactic, arn, ip,
            [
                (s[0], s[1], s[2], s[3], s[4], s[5],
                 s[6].get("mfaAuthenticated"), s[6].get("recipientAccountId"))
                for s in steps
            ],
        )
        for cid, name, tactic, arn, ip, steps in K.CAMPAIGNS
    ]
    schema = (
        "campaign_id string, campaign string, campaign_tactic string, attacker string, "
        f"source_ip string, steps array<struct<{step.replace(' ', ':').replace(',:', ',')}>>"
    )
    return spark.createDataFrame(rows, schema)


def listing(campaigns: DataFrame) -> DataFrame:
    """Catalogue rows: the number of steps and their techniques."""
    return campaigns.select(
        "campaign_id",
        F.col("campaign").alias("name"),
        F.col("campaign_tactic").alias("tactic"),
        F.size("steps").alias("step_count"),
        F.transform("steps", lambda s: s["technique_id"]).alias("techniques"),
    )


def by_id(campaigns: DataFrame, campaign_id: str) -> DataFrame:
    """One campaign; KeyError if there is none of this id."""
    found = campaigns.filter(F.col("campaign_id") == campaign_id)
    if found.isEmpty():
        raise KeyError(campaign_id)
    return found


def steps(campaigns: DataFrame) -> DataFrame:
    return campaigns.select(
        "campaign_id", "campaign", "attacker", "source_ip", F.posexplode("steps").alias("pos", "s")
    ).select("campaign_id", "campaign", "attacker", "source_ip",
             (F.col("pos") + 1).alias("step"), "s.*")


def _deep(base: object, override: object) -> object:
    if not (isinstance(base, dict) and isinstance(override, dict)):
        return override
    own = {k: _deep(base[k], v) if k in base else v for k, v in override.items()}
    return {**base, **own}


@F.pandas_udf(StringType())
def deep_merged(base: pd.Series, override: pd.Series) -> pd.Series:
    """Two JSON objects merged at any depth, as JSON.

    Objects merge key by key; anything else of the override, nulls and arrays too, takes the
    place of the base's. A null or empty override leaves the base. How deep objects nest is
    known by row only, so no fixed plan of built-in functions can express it.
    """
    return pd.Series(
        [
            b if o is None else json.dumps(_deep(json.loads(b or "{}"), json.loads(o) or {}))
            for b, o in zip(base, override, strict=True)
        ],
        dtype=object,
    )


def merged(override: Column, base: Column) -> Column:
    """A leaf of a deep merge: the override where it has a value."""
    return F.coalesce(override, base)


def stamp_identity(identity: Column, arn: Column) -> Column:
    """The attacker's ARN and user name on an identity that keeps its other fields."""
    return (
        identity.withField("arn", arn)
        .withField("type", F.coalesce(identity["type"], F.lit("IAMUser")))
        .withField("userName", F.substring_index(arn, "/", -1))
    )


def step_events(step_rows: DataFrame, base_per_class: DataFrame) -> DataFrame:
    """The step's event: the base event of its class, the step's overrides, the attacker.

    base_per_class has at most one event per class, so the join side is five
    rows at most.
    """
    joined = step_rows.join(
        F.broadcast(base_per_class), F.col("seed_class") == F.col("label"), "left"
    )
    with_overrides = joined.withColumns(
        {
            "eventName": merged(F.col("event_name"), F.col("eventName")),
            "eventSource": merged(F.col("event_source"), F.col("eventSource")),
            "recipientAccountId": merged(F.col("recipient"), F.col("recipientAccountId")),
            "userIdentity": stamp_identity(
                F.col("userIdentity").withField(
                    "mfaAuthenticated",
                    merged(F.col("mfa"), F.col("userIdentity.mfaAuthenticated")),
                ),
                F.col("attacker"),
            ),
            "sourceIPAddress": merged(F.nullif(F.col("source_ip"), F.lit("")),
                                      F.col("sourceIPAddress")),
        }
    )
    return with_overrides.drop("event_name", "event_source", "recipient", "mfa", "label")


def replay_events(step_rows: DataFrame, sampled_per_class: DataFrame,
                  base_per_class: DataFrame) -> DataFrame:
    """Real replay: the sampled event of the step's class, stamped with the attacker.

    A class without a sampled event plays the catalogue's step instead and has
    no truth to compare with.
    """
    synthetic = step_events(step_rows, base_per_class).withColumns(
        {"truth": F.lit(None).cast("int"), "step_source": F.lit("synthetic")}
    )
    keep = [c for c in step_rows.columns if c not in
            ("event_name", "event_source", "recipient", "mfa")]
    real = step_rows.select(*keep).join(
        F.broadcast(sampled_per_class), F.col("seed_class") == F.col("label"), "left"
    )
    real = real.withColumns(
        {
            "userIdentity": stamp_identity(F.col("userIdentity"), F.col("attacker")),
            "sourceIPAddress": merged(F.nullif(F.col("source_ip"), F.lit("")),
                                      F.col("sourceIPAddress")),
            "truth": F.col("label"),
            "step_source": F.lit("real"),
        }
    )
    has_sample = real.filter(F.col("label").isNotNull()).drop("label")
    missing = synthetic.join(
        F.broadcast(sampled_per_class.select("label")),
        F.col("seed_class") == F.col("label"),
        "left_anti",
    )
    return has_sample.unionByName(missing, allowMissingColumns=True)


def timeline(events: DataFrame, score=linear_verdicts) -> DataFrame:
    """Verdict per step and, where the truth is known, whether it is right."""
    scored = score(with_features(events))
    return scored.withColumns(
        {
            "class_label": class_label(F.col("predicted_class")),
            "correct": F.coalesce(F.col("predicted_class") == F.col("truth"), F.lit(False)),
        }
    )


def rollup(step_verdicts: DataFrame) -> DataFrame:
    return step_verdicts.groupBy("campaign_id").agg(
        F.count("*").alias("steps_total"),
        F.count_if(F.col("predicted_class") != 0).alias("threats_detected"),
        F.count_if("gated").alias("auto_contained"),
        F.count_if(F.col("step_source") == "real").alias("real_steps"),
    )


def replay_accuracy(step_verdicts: DataFrame) -> DataFrame:
    """Hits and scored steps per campaign; steps without a truth are not scored."""
    return step_verdicts.groupBy("campaign_id").agg(
        F.count_if(F.col("truth").isNotNull() & F.col("correct")).alias("hits"),
        F.count("truth").alias("scored"),
    )


# --- attack graph -----------------------------------------------------------


def graph_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.GRAPH_EDGES, "source string, target string")


def graph_paths(spark: SparkSession) -> DataFrame:
    rows = [(c, n) for c, nodes in K.GRAPH_PATHS.items() for n in nodes]
    return spark.createDataFrame(rows, "class_id int, node string")


def active_edges(spark: SparkSession) -> DataFrame:
    """Edges whose two ends are on the class's path, per class."""
    paths = graph_paths(spark)
    edges = graph_edges(spark)
    starts = edges.join(F.broadcast(paths), F.col("source") == F.col("node")).drop("node")
    ends = paths.select(F.col("class_id"), F.col("node").alias("target"))
    return starts.join(F.broadcast(ends), ["class_id", "target"], "left_semi")


def attack_paths(verdicts: DataFrame) -> DataFrame:
    """Active edges of every verdict; the joined side is the fixed graph."""
    edges = active_edges(verdicts.sparkSession)
    return verdicts.join(
        F.broadcast(edges), F.col("predicted_class") == F.col("class_id")
    ).select("event_id", "predicted_class", "source", "target")
