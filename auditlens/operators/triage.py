"""Batch triage: verdict rows, error rows and their rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.scoring import probability_map
from auditlens.functions.text import one_decimal_percent


def summary(
    rows: DataFrame, max_rows: int | None = None, incident_cap: int = K.INCIDENTS_PER_UPLOAD
) -> DataFrame:
    """One row of totals over the verdict and error rows of one upload.

    A row whose `error` is not null counts as analysed but has no verdict; the
    mean confidence is taken over all analysed rows. With max_rows only rows up
    to that position are analysed.
    """
    inside = F.lit(True) if max_rows is None else F.col("row") <= max_rows
    ok = F.col("error").isNull() & inside
    analyzed = F.count_if(inside)
    threats = F.count_if(ok & (F.col("predicted_class") != 0))
    return rows.agg(
        F.count("*").alias("total_received"),
        analyzed.alias("analyzed"),
        (F.count("*") > analyzed).cast("int").alias("truncated"),
        threats.alias("threats_detected"),
        F.least(threats, F.lit(incident_cap)).cast("bigint").alias("incidents_recorded"),
        F.count_if(ok & (F.col("predicted_class") == 0)).alias("benign"),
        F.count_if(ok & F.col("gated")).alias("auto_contained"),
        F.count_if(inside & F.col("error").isNotNull()).alias("errors"),
        F.round(
            F.when(
                analyzed > 0,
                F.coalesce(F.sum(F.when(ok, F.col("confidence"))), F.lit(0.0)) / analyzed,
            ).otherwise(0.0),
            4,
        ).alias("avg_confidence"),
    )


def class_distribution(rows: DataFrame) -> DataFrame:
    """Count and share of the analysed rows for all five classes, zeros included."""
    ok = F.col("error").isNull()
    counts = rows.agg(
        F.count("*").alias("analyzed"),
        *[F.count_if(ok & (F.col("predicted_class") == c)).alias(f"n{c}") for c in K.CLASS_IDS],
    )
    lines = F.array(
        *[
            F.struct(F.lit(c).alias("class_id"), F.lit(K.CLASS_LABELS[c]).alias("class_label"),
                     F.col(f"n{c}").alias("n"))
            for c in K.CLASS_IDS
        ]
    )
    return counts.select("analyzed", F.inline(lines)).select(
        "class_id",
        "class_label",
        "n",
        F.when(F.col("analyzed") > 0, F.col("n") / F.col("analyzed") * 100)
        .otherwise(0.0)
        .alias("share"),
    )


def result_rows(rows: DataFrame) -> DataFrame:
    """The verdict rows as the caller sees them."""
    return rows.filter(F.col("error").isNull()).select(
        "row",
        F.col("event_time").alias("timestamp"),
        F.col("eventName").alias("event_name"),
        "principal",
        F.col("sourceIPAddress").alias("source_ip"),
        "predicted_class",
        "class_label",
        "confidence",
        probability_map().alias("probabilities"),
        F.col("action_status").alias("action"),
        "raw_log",
    )


def error_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("error").isNotNull()).select("row", "error", "raw_log")


def capped_threats(
    rows: DataFrame, upload: str, row: str = "row", cap: int = K.INCIDENTS_PER_UPLOAD
) -> DataFrame:
    """The first `cap` threats of every upload in row order.

    The filter on row_number lets Spark keep at most `cap` rows per upload and
    task before the shuffle, so a huge upload does not land in one task.
    """
    position = F.row_number().over(Window.partitionBy(upload).orderBy(row))
    return (
        rows.filter(F.col("error").isNull() & (F.col("predicted_class") != 0))
        .withColumn("position", position)
        .filter(F.col("position") <= cap)
        .withColumn("position", F.col("position").cast("bigint"))
    )


def export_rows(rows: DataFrame) -> DataFrame:
    """The eight text columns of the CSV export; error rows are left out."""
    return rows.filter(F.col("error").isNull()).select(
        F.col("row").cast("string").alias("row"),
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("eventName").alias("event_name"),
        F.replace(F.col("principal"), F.lit(","), F.lit(" ")).alias("principal"),
        F.col("sourceIPAddress").alias("source_ip"),
        "class_label",
        one_decimal_percent(F.col("confidence")).alias("confidence"),
        F.col("action_status").alias("action"),
    )


