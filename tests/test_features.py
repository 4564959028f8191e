"""Golden feature rows and the edge cases of the projection."""

import math

import pytest
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions import times
from auditlens.functions.features import list_entropy, with_features
from auditlens.sources.ingest import with_event_columns

ONE = -math.log2(1 + 1e-10)

# name, time, source, mfa, user agent, geo, burst, lateral, accounts differ, resources
EVENTS = [
    ("ConsoleLogin", "08:02:11", "signin.amazonaws.com", "true", "Mozilla/5.0", 0.1, 2.0, 0.0, 0, 0),
    ("AssumeRole", "08:44:53", "sts.amazonaws.com", "false", "Boto3/1 Python/3", 1.8, 14.0, 0.2, 0, 1),
    ("GetObject", "09:10:27", "s3.amazonaws.com", "false", "Boto3/1 Python/3", 1.6, 120.0, 0.7, 0, 1),
    ("DescribeInstances", "09:55:40", "ec2.amazonaws.com", "false", "aws-cli/2", 3.2, 30.0, 0.95, 1, 1),
    ("AttachUserPolicy", "10:22:57", "iam.amazonaws.com", "false", "Boto3/1 Python/3", 2.5, 25.0, 0.3, 0, 1),
    ("ListBuckets", "09:31:44", "s3.amazonaws.com", "true", "aws-cli/2", 0.2, 6.0, 0.0, 0, 1),
    ("DescribeSecurityGroups", "11:40:02", "ec2.amazonaws.com", "true", "aws-cli/2", 0.15, 4.0, 0.0, 0, 1),
]
COLUMNS = (
    "resource_entropy", "priv_api_call_freq", "admin_policy_attach", "assume_role_freq",
    "cross_account_access", "mfa_disabled", "off_hours_activity", "iam_change_freq",
    "security_group_mod", "s3_sensitive_access", "console_login_anomaly", "cli_tool_usage",
    "suspicious_user_agent", "anomaly_aggregate_score",
)
GOLDEN = [
    (0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0.7300),
    (ONE, 0, 0, 1, 0, 1, 1, 0, 0, 0, 0, 1, 1, 4.2900),
    (ONE, 0, 0, 0, 0, 1, 0, 0, 0, 1, 0, 1, 1, 30.6550),
    (ONE, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 1, 0, 8.6975),
    (ONE, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 1, 7.0750),
    (ONE, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1, 0, 1.5600),
    (ONE, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 1, 0, 1.0450),
]


def event_json(row):
    import json

    name, clock, source, mfa, agent, geo, burst, lateral, cross, n = row
    return json.dumps(
        {
            "eventName": name,
            "eventTime": f"2026-08-08T{clock}Z",
            "eventSource": source,
            "userAgent": agent,
            "userIdentity": {"mfaAuthenticated": mfa},
            "accountId": "1",
            "recipientAccountId": "2" if cross else "1",
            "geo_anomaly_score": geo,
            "api_burst_rate": burst,
            "lateral_movement_score": lateral,
            "accessed_resources": ["r"] * n,
            # derived flags on the event are not read
            "off_hours_activity": 7,
            "admin_policy_attach": 7,
        }
    )


def test_golden_rows(spark):
    raw = spark.createDataFrame([(i, event_json(e)) for i, e in enumerate(EVENTS)], "i int, t string")
    events = with_event_columns(raw.withColumn("event", F.parse_json("t")), "event")
    rows = with_features(events).orderBy("i").select(*COLUMNS, *K.FEATURES[-4:], "weekend_activity")
    for got, want in zip(rows.collect(), GOLDEN):
        assert [round(got[c], 12) for c in COLUMNS] == pytest.approx(list(want), abs=1e-9)
        assert [got[c] for c in K.FEATURES[-4:]] == [0, 0, 0, 0]
        assert got.weekend_activity == 1


@pytest.mark.parametrize(
    "text, off",
    [
        ("2024-01-01T08:59:59.999999", True),
        ("2024-01-01T09:00:00", False),
        ("2024-01-01T18:00:00", False),
        ("2024-01-01T18:00:00.000001", True),
        ("2024-01-01T20:00:00+05:00", True),
        ("2024-01-01T14:00:00-11:00", False),
    ],
)
def test_off_hours_uses_the_wall_clock(spark, text, off):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(times.is_off_hours(times.wall_clock(F.col("t")))).first()[0] is off


def test_micros_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 02:30:00.000123' AS t")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert df.select(times.micros(F.col("t"))).first()[0] == 1711852200000123
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize(
    "items, want",
    [
        (None, 0.0),
        ([], 0.0),
        (["a"], ONE),
        (["a", None], ONE),
        (["a", "a", "b", "c"], 1.49999999957),
        (["c", "b", "a", "b"], 1.49999999957),
    ],
)
def test_list_entropy(spark, items, want):
    df = spark.createDataFrame([(items,)], "x array<string>")
    assert df.select(list_entropy(F.col("x"))).first()[0] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(
    "recipient, account, want", [(None, None, 0), ("1", None, 1), ("1", "1", 0), ("1", "2", 1)]
)
def test_cross_account(spark, recipient, account, want):
    df = spark.createDataFrame(
        [(recipient, account)], "recipientAccountId string, accountId string"
    ).withColumn("event_time", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert with_features(df).first().cross_account_access == want


@pytest.mark.parametrize(
    "value, want", [('"true"', 0), ('"True"', 1), ("true", 1), ("null", 1), ('"false"', 1)]
)
def test_only_the_text_true_counts_as_mfa(spark, value, want):
    text = '{"eventTime": "2024-01-01T10:00:00Z", "userIdentity": {"mfaAuthenticated": %s}}' % value
    df = spark.createDataFrame([(text,)], "t string").withColumn("event", F.parse_json("t"))
    assert with_features(with_event_columns(df, "event")).first().mfa_disabled == want


def test_defaults_of_an_empty_event(spark):
    df = spark.createDataFrame([("{}",)], "t string").withColumn("event", F.parse_json("t"))
    row = with_features(with_event_columns(df, "event", "2024-01-06 12:00:00")).first()
    for name, default in K.PASS_THROUGH_DEFAULTS.items():
        assert row[name] == default
    assert row.suspicious_user_agent == 1 and row.mfa_disabled == 1 and row.weekend_activity == 1
