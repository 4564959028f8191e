"""Containment gates, admission room and containment plans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.text import strip_arn
from auditlens.operators.trailing import with_trailing_count


def is_threat(threshold: float = K.CONFIDENCE_THRESHOLD) -> Column:
    return (F.col("predicted_class") != 0) & (F.col("confidence") >= threshold)


def protected_names(
    configured: Iterable[str] = (), responder: str = K.DEFAULT_RESPONDER
) -> list[str]:
    """Built-in and configured names in lower case, sorted, each once."""
    extra = {name.strip().lower() for name in configured if name.strip()}
    return sorted(set(K.PROTECTED_PRINCIPALS) | {responder.lower()} | extra)


def is_protected(principal: Column, names: list[str]) -> Column:
    return F.lower(strip_arn(principal)).isin(*names)


def with_room(
    verdicts: DataFrame,
    tenant: str,
    time_us: str,
    contained: Column,
    cap: int = K.CONTAINMENT_CAP,
    window_seconds: int = K.CONTAINMENT_WINDOW_SECONDS,
    include_current: bool = True,
) -> DataFrame:
    """Adds the containments in the trailing window and the room the cap leaves."""
    counted = with_trailing_count(
        verdicts,
        tenant,
        time_us,
        contained,
        window_seconds * 1_000_000,
        "recent_containments",
        include_current,
    )
    room = F.greatest(F.lit(0), F.lit(cap) - F.col("recent_containments"))
    return counted.withColumn("room", room.cast("bigint"))


def with_decision(
    verdicts: DataFrame,
    names: list[str],
    threshold: float = K.CONFIDENCE_THRESHOLD,
    cap: int = K.CONTAINMENT_CAP,
    window_seconds: int = K.CONTAINMENT_WINDOW_SECONDS,
) -> DataFrame:
    """Adds decision status, flags and reason; needs principal and room."""
    name = strip_arn(F.col("principal"))
    threat = is_threat(threshold)
    protected = threat & is_protected(F.col("principal"), names)
    capped = threat & ~protected & (F.col("room") <= 0)
    capped_text = K.REASON_CAPPED.format(cap=cap, minutes=window_seconds // 60)
    reason = (
        F.when(~threat, K.REASON_MONITOR)
        .when(protected, F.concat(F.lit("'"), name, F.lit(K.REASON_PROTECTED)))
        .when(capped, capped_text)
        .otherwise(K.REASON_PENDING)
    )
    status = F.when(~threat, "monitor").when(protected | capped, "blocked").otherwise("pending")
    return verdicts.withColumns(
        {"status": status, "protected": protected, "blast_capped": capped, "reason": reason}
    )


def manual_refusal(threshold: float = K.CONFIDENCE_THRESHOLD) -> Column:
    """The reason a manual containment is refused; null if it is carried out."""
    below, benign = K.REASON_MANUAL
    text = F.concat(
        F.lit("Confidence "),
        F.col("confidence").cast("string"),
        F.lit(f"{below}{threshold}{benign}"),
    )
    return F.when(~is_threat(threshold), text)


def live_label() -> Column:
    """One word per verdict row, by its state first and its decision second."""
    return (
        F.when(F.col("state") == "contained", "CONTAINED")
        .when(F.col("state") == "reversed", "REVERSED")
        .when(F.col("status") == "pending", "PENDING")
        .when(F.col("status") == "blocked", "GUARDED")
        .otherwise("MONITORED")
    )


def containment_plan(
    gated: DataFrame,
    instance_id: str = K.DEFAULT_INSTANCE_ID,
    quarantine_group: str = K.DEFAULT_QUARANTINE_GROUP,
) -> DataFrame:
    """Two planned actions per gated row; nothing is carried out.

    Sessions issued before the event are to be revoked by a deny-all policy, and
    the host is to keep only forensic egress. Needs event_time and principal.
    """
    none = F.lit(None).cast("string")
    revoke_condition = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    actions = F.array(
        F.struct(
            F.lit(1).alias("step"),
            F.lit("revoke_iam_session").alias("action"),
            F.col("principal").alias("target"),
            F.lit(K.REVOKE_POLICY).alias("control"),
            F.lit("Deny").alias("effect"),
            revoke_condition.alias("token_issued_before"),
            none.alias("egress"),
            F.lit("Deny-all policy attached; older session tokens invalidated.").alias("detail"),
        ),
        F.struct(
            F.lit(2).alias("step"),
            F.lit("micro_segment_host").alias("action"),
            F.lit(instance_id).alias("target"),
            F.lit(quarantine_group).alias("control"),
            F.lit("Deny").alias("effect"),
            none.alias("token_issued_before"),
            F.lit("tcp 443-443 10.0.0.0/8").alias("egress"),
            F.lit("Host isolated into deny-all quarantine security group.").alias("detail"),
        ),
    )
    return gated.select(
        "event_id", "principal", F.col("predicted_class").alias("threat_class"),
        F.inline(actions),
    )
