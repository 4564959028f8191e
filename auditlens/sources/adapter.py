"""Audit events worked out of the `events` table of the test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.functions.text import lookup

ACCOUNT = "123456789012"
OTHER_ACCOUNT = "987654321098"

# Event names by event type; the position is k modulo the number of names.
NAMES = {
    "click": ("DescribeInstances", "ListBuckets", "DescribeSecurityGroups", "RunInstances"),
    "view": ("GetObject", "PutObject", "Decrypt", "GetSecretValue"),
    "purchase": ("AssumeRole", "SendCommand", "StartSession"),
    "signup": (
        "AttachUserPolicy",
        "PutUserPolicy",
        "CreateAccessKey",
        "CreateLoginProfile",
        "CreateRole",
    ),
}
AGENTS = {0: "aws-cli/2.13.0", 1: "Boto3/1.34.0 Python/3.11", 2: "", 3: "Mozilla/5.0"}


def _event_name(kind: Column, k: Column) -> Column:
    case = None
    for event_type, names in NAMES.items():
        pick = lookup(k % len(names), dict(enumerate(names)))
        hit = kind == event_type
        case = F.when(hit, pick) if case is None else case.when(hit, pick)
    return case.otherwise("ConsoleLogin")


def _event_source(kind: Column, k: Column) -> Column:
    view = lookup(
        k % 4,
        {2: "kms.amazonaws.com", 3: "secretsmanager.amazonaws.com"},
        F.lit("s3.amazonaws.com"),
    )
    purchase = F.when(k % 3 == 0, "sts.amazonaws.com").otherwise("ssm.amazonaws.com")
    return (
        F.when(kind == "click", "ec2.amazonaws.com")
        .when(kind == "view", view)
        .when(kind == "purchase", purchase)
        .when(kind == "signup", "iam.amazonaws.com")
        .otherwise("signin.amazonaws.com")
    )


def _label(event_id: Column, name: Column) -> Column:
    return (
        F.when(event_id % 10 == 0, 0)
        .when(name.isin("AttachUserPolicy", "PutUserPolicy", "CreateLoginProfile"), 2)
        .when(name.isin("GetSecretValue", "Decrypt"), 3)
        .when(name.isin("SendCommand", "StartSession", "RunInstances"), 4)
        .when(name == "AssumeRole", 1)
        .otherwise(0)
    )


def to_audit_events(events: DataFrame) -> DataFrame:
    """A narrow projection of the events table; works on batch and stream frames."""
    kind, user = F.col("event_type"), F.col("user_id")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    base = events.withColumns({"k": k}).withColumns({"eventName": _event_name(kind, F.col("k"))})
    k = F.col("k")
    user_name = (
        F.when(user % 29 == 0, "Admin")
        .when(user % 31 == 0, "root")
        .otherwise(F.concat(F.lit("u"), user.cast("string")))
    )
    arn = F.concat(F.lit(f"arn:aws:iam::{ACCOUNT}:user/"), user_name)
    identity = F.struct(
        F.lit("IAMUser").alias("type"),
        F.when(k % 17 == 0, "").when(k % 19 == 0, None).otherwise(arn).alias("arn"),
        F.lit(ACCOUNT).alias("accountId"),
        F.when(k % 19 != 0, user_name).alias("userName"),
        lookup(k % 3, {0: "true", 1: "false"}).alias("mfaAuthenticated"),
    )
    bucket = F.lit("arn:aws:s3:::b")
    resources = F.array(
        *[F.concat(bucket, n.cast("string")) for n in (k % 3, k % 5, user % 2)]
    )
    error = F.when(
        kind == "error",
        lookup(
            k % 3,
            {0: "AccessDenied", 1: "Client.UnauthorizedOperation", 2: "InvalidInstanceId"},
        ),
    )
    return base.select(
        "event_id",
        "user_id",
        F.col("ts").alias("event_time"),
        "eventName",
        _event_source(kind, k).alias("eventSource"),
        identity.alias("userIdentity"),
        F.concat(F.lit("203.0.113."), ((user * 7 + k) % 254).cast("string")).alias(
            "sourceIPAddress"
        ),
        lookup(k % 4, AGENTS).alias("userAgent"),
        error.alias("errorCode"),
        F.when(k % 5 != 0, ACCOUNT).alias("accountId"),
        F.when(k % 7 == 0, OTHER_ACCOUNT).otherwise(ACCOUNT).alias("recipientAccountId"),
        F.when(k % 13 != 0, resources).alias("accessed_resources"),
        (k % 10).alias("login_freq_1h"),
        (k.cast("double") / 20).alias("geo_anomaly_score"),
        (F.col("value") / 4).alias("api_burst_rate"),
        (F.col("value") * 3).alias("data_exfil_volume_mb"),
        ((k % 11).cast("double") / 10).alias("lateral_movement_score"),
        _label(F.col("event_id"), F.col("eventName")).alias("label"),
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_audit_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
