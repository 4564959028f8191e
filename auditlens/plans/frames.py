"""The frames that the registered queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.functions import times
from auditlens.functions.features import with_features
from auditlens.functions.scoring import linear_verdicts
from auditlens.functions.text import class_label, lookup, principal
from auditlens.operators import admission, gate
from auditlens.session import materialise
from auditlens.sources import incidents as store
from auditlens.sources.adapter import audit_events


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their features, and the whole event as raw_log where it is used."""
    return with_features(store.with_raw_log(audit_events(spark, sf_dir)))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events with their principal, tenant and time in microseconds."""
    return linear_verdicts(featured(spark, sf_dir)).withColumns(
        {
            "principal": principal(),
            "tenant": F.col("recipientAccountId"),
            "time_us": times.micros(F.col("event_time")),
        }
    )


def fault() -> Column:
    """Why an event of the triage input cannot be analysed: its error code, or null."""
    return F.when(F.col("errorCode") == "InvalidInstanceId", "event cannot be analysed")


def triage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and error rows of daily uploads; the row is the event id."""
    rows = verdicts(spark, sf_dir).withColumns(
        {
            "row": F.col("event_id"),
            "upload": F.date_format("event_time", "yyyy-MM-dd"),
            "error": fault(),
            "class_label": class_label(F.col("predicted_class")),
        }
    )
    return rows


#: What analysts did with pending verdicts, by the event's user agent.
ANALYST = {"Mozilla/5.0": "contained", "": "reversed"}


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate asks of the verdicts, scored once for the log and the decisions."""
    rows = verdicts(spark, sf_dir).select(
        "event_id", "tenant", "time_us", "principal", "predicted_class", "confidence", "gated",
        "userAgent",
    )
    return materialise(rows, "judged")


def containments(rows: DataFrame) -> DataFrame:
    """The table of confirmed verdicts with whether the cap admitted them.

    What was reversed later was contained first and took a slot as well.
    """
    name = gate.protected_names()
    confirmed = rows.filter(
        F.col("gated")
        & ~gate.is_protected(F.col("principal"), name)
        & F.col("userAgent").isin(*ANALYST)
    )
    log = admission.containment_log(confirmed.select("tenant", "event_id", "time_us"))
    return materialise(log, "containments")


def decisions(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Gate decisions; the room is what the tenant's containments before left."""
    return gate.with_decision(admission.with_room(rows, log), gate.protected_names())


def incident_source() -> Column:
    """Where an incident comes from, by its event's user agent."""
    return lookup(
        F.col("userAgent"),
        {"aws-cli/2.13.0": "live", "Boto3/1.34.0 Python/3.11": "upload", "": "scenario"},
        F.lit("live-aws"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of all verdicts."""
    return store.from_verdicts(verdicts(spark, sf_dir), incident_source())


def changes_of(incidents: DataFrame) -> DataFrame:
    """Containments that were later confirmed, and some of those reversed.

    An incident with a rollback token is confirmed first; where it came in live
    from the account it is then reversed and its token cleared. Works on streams too.
    """
    base = incidents.filter(F.col("rollback").isNotNull())
    none = F.lit(None).cast("string")
    confirm = F.struct(
        F.lit(1).cast("bigint").alias("seq"),
        F.lit("CONTAINED").alias("action_status"),
        F.lit(True).alias("sets_status"),
        none.alias("rollback"),
        F.lit(False).alias("sets_rollback"),
    )
    reverse = F.struct(
        F.lit(2).cast("bigint").alias("seq"),
        F.lit("REVERSED").alias("action_status"),
        F.lit(True).alias("sets_status"),
        none.alias("rollback"),
        F.lit(True).alias("sets_rollback"),
    )
    changes = F.when(F.col("source") == "live-aws", F.array(confirm, reverse)).otherwise(
        F.array(confirm)
    )
    return base.select("user_id", "id", F.inline(changes))
