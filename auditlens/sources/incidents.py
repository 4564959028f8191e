"""The incident table: append, change, list, report and remove.

Rows are stored by owner bucket, so an owner's reads prune to one bucket; a
bucket with a busy owner is many files, sorted by owner and id.
Changes are appended as rows of their own and the latest one wins on read.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlens import constants as K
from auditlens.functions.text import class_label, lookup, one_decimal, strip_arn
from auditlens.session import exists, materialise

BUCKETS = 64

COLUMNS = (
    "id bigint, user_id bigint, created_at timestamp_ntz, source string, event_name string, "
    "principal string, source_ip string, predicted_class int, class_label string, "
    "confidence double, action_status string, raw_log string, rollback string"
)

CHANGES = (
    "user_id bigint, id bigint, seq bigint, action_status string, sets_status boolean, "
    "rollback string, sets_rollback boolean"
)


def owner_bucket(user: Column) -> Column:
    return F.pmod(F.xxhash64(user.cast("bigint")), F.lit(BUCKETS)).cast("int")


def with_defaults(rows: DataFrame) -> DataFrame:
    """The 13 incident columns, with the column's default where a value is missing."""

    def get(name: str, kind: str, default) -> Column:
        missing = F.lit(default).cast(kind)
        return F.coalesce(F.col(name).cast(kind), missing) if name in rows.columns else missing

    def maybe(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    return rows.select(
        F.col("id").cast("bigint").alias("id"),
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("created_at"),
        get("source", "string", "manual").alias("source"),
        get("event_name", "string", "").alias("event_name"),
        get("principal", "string", "").alias("principal"),
        get("source_ip", "string", "").alias("source_ip"),
        get("predicted_class", "int", 0).alias("predicted_class"),
        get("class_label", "string", "").alias("class_label"),
        get("confidence", "double", 0.0).alias("confidence"),
        get("action_status", "string", "MONITORED").alias("action_status"),
        maybe("raw_log").alias("raw_log"),
        maybe("rollback").alias("rollback"),
    )


#: Columns of an event frame that are no part of the event itself.
NOT_EVENT = ("event_id", "user_id", "label")
#: Times in raw_log keep their microseconds.
RAW_OPTIONS = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def with_raw_log(events: DataFrame) -> DataFrame:
    """Adds raw_log: the whole event, all columns of the frame but its keys, as JSON.

    To be called before the features, which replace absent numbers by defaults.
    """
    parts = [F.col(c) for c in events.columns if c not in NOT_EVENT]
    return events.withColumn("raw_log", F.to_json(F.struct(*parts), RAW_OPTIONS))


def stored_events(incidents: DataFrame, schema: StructType) -> DataFrame:
    """The incidents' events out of raw_log, with the incident's id and stored class."""
    kept = StructType([f for f in schema.fields if f.name not in NOT_EVENT])
    event = F.from_json("raw_log", kept, RAW_OPTIONS)
    return incidents.select(
        "id", F.col("predicted_class").alias("stored_class"), event.alias("event")
    ).select("id", "stored_class", "event.*")


def from_verdicts(verdicts: DataFrame, source: Column) -> DataFrame:
    """Incident rows of scored events that have the raw_log of with_raw_log."""
    user_name = strip_arn(F.col("principal"))
    rollback = F.when(
        F.col("gated"),
        F.to_json(F.struct(F.lit("iam_user").alias("kind"), user_name.alias("username"))),
    )
    return with_defaults(
        verdicts.select(
            F.col("event_id").alias("id"),
            "user_id",
            F.col("event_time").alias("created_at"),
            source.alias("source"),
            F.col("eventName").alias("event_name"),
            "principal",
            F.col("sourceIPAddress").alias("source_ip"),
            "predicted_class",
            class_label(F.col("predicted_class")).alias("class_label"),
            "confidence",
            "action_status",
            "raw_log",
            rollback.alias("rollback"),
        )
    )


def append(incidents: DataFrame, path: str) -> None:
    """Append to the table. Every row carries the time it arrived, in microseconds.

    That time is never before the last removal, whatever the clocks say, so a row that is
    stored after a removal stays. The rebalance hint brings a bucket into few files and splits
    one that is too large for a task, which a plain repartition by the same key would not.
    """
    spark = incidents.sparkSession
    last = 0
    if exists(spark, f"{path}-removed"):
        removed = spark.read.schema(REMOVALS).parquet(f"{path}-removed")
        last = removed.agg(F.max("before")).first()[0] or 0
    (
        with_defaults(incidents)
        .withColumn("arrived", F.lit(max(last, _now())).cast("bigint"))
        .withColumn("owner_bucket", owner_bucket(F.col("user_id")))
        .hint("rebalance", "owner_bucket")
        .sortWithinPartitions("owner_bucket", "user_id", "id")
        .write.mode("append")
        .partitionBy("owner_bucket")
        .parquet(path)
    )


#: Rows of an owner that arrived before this are removed.
REMOVALS = "user_id bigint, before bigint"
STORED = f"{COLUMNS}, arrived bigint, owner_bucket int"


def _now() -> int:
    return time.time_ns() // 1000


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows but the removed ones, with arrived and owner_bucket."""
    table = spark.read.schema(STORED).parquet(path)
    if not exists(spark, f"{path}-removed"):
        return table
    removed = spark.read.schema(REMOVALS).parquet(f"{path}-removed")
    last = removed.groupBy("user_id").agg(F.max("before").alias("_before"))
    arrived = F.coalesce("arrived", F.lit(0))
    return (
        table.join(last, "user_id", "left")
        .filter(F.col("_before").isNull() | (arrived >= F.col("_before")))
        .select(*table.columns)
    )


def read(spark: SparkSession, path: str, user_id: int | None = None) -> DataFrame:
    """Stored incidents without the removed ones; of one owner, from one bucket only."""
    table = _stored(spark, path)
    if user_id is not None:
        mine = owner_bucket(F.lit(user_id))
        table = table.filter((F.col("owner_bucket") == mine) & (F.col("user_id") == user_id))
    return table.drop("owner_bucket", "arrived")


def remove_owner(spark: SparkSession, path: str, user_id: int) -> int:
    """Hides an owner's incidents so far by one appended row; returns how many they are.

    What counts is when a row arrived, not its id: rows that are stored later stay, smaller ids
    too. Only the owner's bucket is read and nothing is rewritten; `compact` drops the rows.
    """
    mine = _stored(spark, path).filter(
        (F.col("owner_bucket") == owner_bucket(F.lit(user_id))) & (F.col("user_id") == user_id)
    )
    found = mine.agg(F.count("*").alias("n"), F.max("arrived").alias("last")).first()
    if found.n:
        before = max(_now(), (found["last"] or 0) + 1)
        spark.createDataFrame([(user_id, before)], REMOVALS).coalesce(1).write.mode(
            "append"
        ).parquet(f"{path}-removed")
    return found.n


def compact(spark: SparkSession, path: str, user_id: int) -> None:
    """Rewrites the owner's bucket without removed rows; no other bucket is touched.

    The rows are first written beside the table, and then take the bucket's place at once;
    what a reader sees is the same before and after. Appends to the bucket have to wait.
    """
    bucket = spark.range(1).select(owner_bucket(F.lit(user_id))).first()[0]
    kept = materialise(_stored(spark, path).filter(F.col("owner_bucket") == bucket), "compacted")
    (
        kept.hint("rebalance", "owner_bucket")
        .sortWithinPartitions("user_id", "id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("owner_bucket")
        .parquet(path)
    )


def append_changes(changes: DataFrame, path: str) -> None:
    """Append change rows beside the incidents, by owner bucket as these are."""
    (
        changes.withColumn("owner_bucket", owner_bucket(F.col("user_id")))
        .hint("rebalance", "owner_bucket")
        .write.mode("append")
        .partitionBy("owner_bucket")
        .parquet(f"{path}-changes")
    )


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{CHANGES}, owner_bucket int").parquet(f"{path}-changes").drop(
        "owner_bucket"
    )


def latest_state(incidents: DataFrame, changes: DataFrame) -> DataFrame:
    """Incidents with their changes applied; only status and rollback can change.

    changes holds CHANGES rows; of each of the two fields the last change wins.
    """

    def last(field: str, sets: str) -> Column:
        order = F.when(F.col(sets), F.col("seq"))
        return F.max_by(F.struct(F.col(field).alias("value")), order)

    final = changes.groupBy("user_id", "id").agg(
        last("action_status", "sets_status").alias("_status"),
        last("rollback", "sets_rollback").alias("_rollback"),
    )

    def apply(change: str, field: str) -> Column:
        return F.when(F.col(change).isNotNull(), F.col(f"{change}.value")).otherwise(F.col(field))

    return (
        incidents.join(final, ["user_id", "id"], "left")
        .withColumns(
            {
                "action_status": apply("_status", "action_status"),
                "rollback": apply("_rollback", "rollback"),
            }
        )
        .drop("_status", "_rollback")
    )


def newest(incidents: DataFrame, limit: int = K.INCIDENT_LIST_LIMIT) -> DataFrame:
    """The newest rows of every owner, with `ordinal` and the `limit` that was applied.

    The limit is kept between 1 and 500; that it was is seen in the column. Spark cuts each
    owner to the limit in every task before the shuffle.
    """
    limit = min(max(limit, 1), K.MOST_INCIDENTS_LISTED)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("id")))
    ranked = incidents.withColumn("ordinal", place).filter(F.col("ordinal") <= limit)
    return ranked.withColumns(
        {"ordinal": F.col("ordinal").cast("bigint"), "limit": F.lit(limit).cast("bigint")}
    )


def cards(incidents: DataFrame) -> DataFrame:
    """Total, threats, contained, benign and first and last time per owner."""
    return incidents.groupBy("user_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("predicted_class") != 0).alias("threats"),
        F.count_if(F.col("action_status") == "CONTAINED").alias("contained"),
        F.count_if(F.col("predicted_class") == 0).alias("benign"),
        F.max_by("created_at", "id").alias("newest"),
        F.min_by("created_at", "id").alias("oldest"),
    )


def distribution(incidents: DataFrame) -> DataFrame:
    """Count and percentage per owner and class; classes without rows are left out."""
    counts = incidents.groupBy("user_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("predicted_class") == c).alias(f"n{c}") for c in K.CLASS_IDS],
    )
    lines = F.array(
        *[
            F.struct(F.lit(K.REPORT_CLASS_NAMES[c]).alias("class_name"), F.col(f"n{c}").alias("n"))
            for c in K.CLASS_IDS
        ]
    )
    rows = counts.select("user_id", "total", F.inline(lines)).filter(F.col("n") > 0)
    return rows.select(
        "user_id", "class_name", "n", one_decimal(F.col("n") / F.col("total") * 100).alias("pct")
    )


def report_rows(newest_rows: DataFrame) -> DataFrame:
    """The report's incident log, one line per incident of a newest-first list."""
    name = F.coalesce(
        lookup(F.col("source"), K.REPORT_SOURCE_NAMES, F.nullif(F.col("source"), F.lit(""))),
        F.lit("—"),
    )
    return newest_rows.select(
        "user_id",
        "ordinal",
        "created_at",
        name.alias("source_name"),
        F.coalesce(F.nullif(F.col("event_name"), F.lit("")), F.lit("—")).alias("event_name"),
        F.coalesce(F.nullif(F.col("principal"), F.lit("")), F.lit("n/a")).alias("principal"),
        F.coalesce(F.col("source_ip"), F.lit("")).alias("source_ip"),
        lookup(
            F.col("predicted_class"), K.REPORT_CLASS_NAMES, F.col("predicted_class").cast("string")
        ).alias("class_name"),
        F.concat(one_decimal(F.col("confidence") * 100), F.lit("%")).alias("confidence"),
        "action_status",
    )
