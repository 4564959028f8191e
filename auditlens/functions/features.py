"""The 32 features of an audit event, as one narrow projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions import times


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is null."""
    return F.when(condition, 1).otherwise(0)


def contains_any(col: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(p)) for p in parts])


def list_entropy(items: Column) -> Column:
    """Shannon entropy of a list; null members are dropped, an empty list gives 0.

    Equal members are brought together by sorting, and one pass over the sorted
    list adds up the finished runs, so a long list costs n log n.
    """
    present = F.array_sort(F.filter(items, lambda x: x.isNotNull()))

    def term(run: Column, size: Column) -> Column:
        share = run / size
        return -share * F.log2(share + F.lit(1e-10))

    def close_runs(sorted_items: Column) -> Column:
        size = F.size(sorted_items).cast("double")
        start = F.struct(
            F.lit(None).cast("string").alias("value"),
            F.lit(0.0).alias("run"),
            F.lit(0.0).alias("total"),
        )

        def step(acc: Column, x: Column) -> Column:
            same = acc["value"].eqNullSafe(x)
            finished = F.when(acc["run"] > 0, term(acc["run"], size)).otherwise(0.0)
            return F.struct(
                x.alias("value"),
                F.when(same, acc["run"] + 1.0).otherwise(1.0).alias("run"),
                F.when(same, acc["total"]).otherwise(acc["total"] + finished).alias("total"),
            )

        return F.aggregate(
            sorted_items, start, step, lambda acc: acc["total"] + term(acc["run"], size)
        )

    return F.when(F.size(present) > 0, close_runs(present)).otherwise(0.0)


def feature_columns(available: list[str]) -> dict[str, Column]:
    """Expressions for all 32 features over an event frame with these columns.

    A column the frame does not have counts as absent in every row.
    """

    def text(name: str) -> Column:
        return F.col(name) if name in available else F.lit(None).cast("string")

    def number(name: str) -> Column:
        absent = F.lit(K.PASS_THROUGH_DEFAULTS[name])
        return F.coalesce(F.col(name).cast("double"), absent) if name in available else absent

    name = F.coalesce(text("eventName"), F.lit(""))
    source = F.coalesce(text("eventSource"), F.lit(""))
    agent = F.coalesce(text("userAgent"), F.lit(""))
    error = F.coalesce(text("errorCode"), F.lit(""))
    mfa = F.col("userIdentity.mfaAuthenticated") if "userIdentity" in available else F.lit(None)
    when = F.col("event_time")
    off_hours = times.is_off_hours(when)

    out: dict[str, Column] = {f: number(f) for f in K.PASS_THROUGH_DEFAULTS}
    out["resource_entropy"] = (
        list_entropy(F.col("accessed_resources"))
        if "accessed_resources" in available
        else F.lit(0.0)
    )
    out["priv_api_call_freq"] = flag(name.isin(*K.PRIVILEGED_CALLS))
    out["admin_policy_attach"] = flag(F.contains(name, F.lit("AttachUserPolicy")))
    out["assume_role_freq"] = flag(name == "AssumeRole")
    out["cross_account_access"] = flag(~text("recipientAccountId").eqNullSafe(text("accountId")))
    out["mfa_disabled"] = flag(~mfa.eqNullSafe(F.lit("true")))
    out["off_hours_activity"] = flag(off_hours)
    out["weekend_activity"] = flag(times.is_weekend(when))
    out["iam_change_freq"] = flag(name.rlike("|".join(K.CHANGE_VERBS)))
    out["security_group_mod"] = flag(F.contains(name, F.lit("SecurityGroup")))
    out["s3_sensitive_access"] = flag(F.contains(F.lower(source), F.lit("s3")))
    out["kms_decrypt_freq"] = flag(name == "Decrypt")
    out["secret_access_freq"] = flag(F.contains(source, F.lit("secretsmanager")))
    out["console_login_anomaly"] = flag(F.contains(name, F.lit("ConsoleLogin")) & off_hours)
    out["cli_tool_usage"] = flag(contains_any(F.lower(agent), ("aws-cli", "boto3")))
    out["suspicious_user_agent"] = flag(
        (agent == "") | F.contains(F.lower(agent), F.lit("python"))
    )
    out["anomaly_aggregate_score"] = (
        number("geo_anomaly_score") * 0.3
        + flag(off_hours) * 0.2
        + number("api_burst_rate") * 0.25
        + number("lateral_movement_score") * 0.25
    )
    out["access_denied_flag"] = flag(contains_any(error, K.DENIED_ERROR_MARKERS))
    out["sensitive_privilege_action"] = flag(name.isin(*K.SENSITIVE_PRIVILEGE_ACTIONS))
    out["credential_access_action"] = flag(name.isin(*K.CREDENTIAL_ACCESS_ACTIONS))
    out["lateral_movement_action"] = flag(name.isin(*K.LATERAL_MOVEMENT_ACTIONS))
    return {f: out[f].cast("double") for f in K.FEATURES}


def with_features(events: DataFrame) -> DataFrame:
    """The event columns plus the 32 features.

    Feature columns that the events already carry are replaced: the flags are
    always worked out from the event itself.
    """
    exprs = feature_columns(events.columns)
    kept = [F.col(f"`{c}`") for c in events.columns if c not in exprs]
    return events.select(*kept, *[e.alias(f) for f, e in exprs.items()])
