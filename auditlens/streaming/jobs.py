"""Scoring, duplicate suppression and incident storage of arriving event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.functions.features import with_features
from auditlens.functions.scoring import linear_verdicts
from auditlens.session import is_directory, scratch_path
from auditlens.sources.adapter import to_audit_events
from auditlens.sources.incidents import owner_bucket, with_raw_log


def event_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """Rows of event files as they arrive; the schema is that of the files there.

    A stream watches a folder; the path of a single file is that file in its folder.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if not is_directory(spark, path):
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def audit_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Audit events with the instant that watermarks need beside the wall clock."""
    events = to_audit_events(event_stream(spark, path, files_per_batch))
    return events.withColumn("event_instant", F.col("event_time").cast("timestamp"))


def score(events: DataFrame) -> DataFrame:
    """Stateless: the same projections as in batch."""
    return linear_verdicts(with_features(with_raw_log(events)))


def without_duplicates(events: DataFrame, look_back: str = "60 minutes") -> DataFrame:
    """Each event once, however often it is delivered inside the look-back time.

    State is dropped when the watermark passes, so it is bounded by the events of
    one look-back.
    """
    return events.withWatermark("event_instant", look_back).dropDuplicatesWithinWatermark(
        ["event_id"]
    )


def run_to_table(
    df: DataFrame, name: str, partition_by: tuple[str, ...] = (), path: str | None = None
) -> str:
    """Process everything that is there into a parquet table; returns its path.

    The file sink commits each micro-batch in its log, so a restarted or retried
    batch is not read twice.
    """
    spark = df.sparkSession
    target = path or scratch_path(spark, name)
    writer = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", f"{target}-checkpoint")
        .option("path", target)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start()
    query.awaitTermination()
    return target


def store_incidents(incidents: DataFrame, name: str = "incidents") -> str:
    """Stream of incident rows into the table that sources.incidents reads."""
    placed = incidents.withColumns(
        {
            "arrived": F.unix_micros(F.current_timestamp()),
            "owner_bucket": owner_bucket(F.col("user_id")),
        }
    )
    return run_to_table(placed, name, ("owner_bucket",))


def store_changes(changes: DataFrame, path: str) -> str:
    """Stream of change rows into the table beside the incidents at path."""
    placed = changes.withColumn("owner_bucket", owner_bucket(F.col("user_id")))
    return run_to_table(placed, "changes", ("owner_bucket",), f"{path}-changes")
