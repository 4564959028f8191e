"""Labelled data: featurise, report and validate."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.features import with_features
from auditlens.functions.labels import with_label, with_variant_label
from auditlens.session import shared_dir
from auditlens.sources import ingest


class DatasetError(ValueError):
    """The labelled data cannot be used for training."""


def has_all_features(df: DataFrame) -> bool:
    return set(K.FEATURES) <= set(df.columns)


def precomputed(df: DataFrame) -> DataFrame:
    """Feature rows as they are: null and '' count as 0, other text is an error."""

    def value(name: str):
        return F.coalesce(F.col(name).cast("string").try_cast("double"), F.lit(0.0))

    def is_bad(name: str):
        cell = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
        return (cell != "") & cell.try_cast("double").isNull()

    bad = F.filter(
        F.array(*[F.when(is_bad(f), F.lit(f)) for f in K.FEATURES]), lambda x: x.isNotNull()
    )
    return df.withColumn("bad_features", bad).withColumns({f: value(f) for f in K.FEATURES})


def featurise(df: DataFrame) -> DataFrame:
    """Features plus `shape` and `error` per row, for raw events or feature rows."""
    if has_all_features(df):
        rows = precomputed(df)
        error = F.when(
            F.size("bad_features") > 0,
            F.concat(F.lit("non-numeric: "), F.array_join("bad_features", ", ")),
        )
        return rows.withColumns({"shape": F.lit("precomputed_features"), "error": error}).drop(
            "bad_features"
        )
    error = F.when(F.col("event_time").isNull(), "unparsable event time")
    return with_features(df).withColumns({"shape": F.lit("raw_events"), "error": error})


def report(rows: DataFrame, order: str) -> DataFrame:
    """Totals of a labelled load, one row, one pass."""
    used = F.col("label").isNotNull() & F.col("error").isNull()
    raw = F.coalesce(F.bool_or(used & (F.col("shape") == "raw_events")), F.lit(False))
    pre = F.coalesce(F.bool_or(used & (F.col("shape") == "precomputed_features")), F.lit(False))
    return rows.agg(
        F.count("*").alias("rows_total"),
        F.count_if(used).alias("rows_used"),
        F.count_if(~used).alias("rows_skipped"),
        F.count_if(F.col("label").isNotNull() & F.col("error").isNotNull()).alias(
            "featurize_errors"
        ),
        *[F.count_if(used & (F.col("label") == c)).alias(f"class_{c}") for c in K.CLASS_IDS],
        F.coalesce(
            F.min_by("label_key", F.when(F.col("label").isNotNull(), F.col(order))), F.lit("")
        ).alias("label_key"),
        F.when(raw & pre, "mixed").when(pre, "precomputed_features").otherwise("raw_events").alias(
            "shape"
        ),
    )


def check(
    totals: DataFrame,
    min_total: int = K.MIN_ROWS_TOTAL,
    min_per_class: int = K.MIN_ROWS_PER_CLASS,
) -> DataFrame:
    """Adds `problem`: the first reason the data cannot be used, or ''."""
    counts = F.array(
        *[
            F.struct(F.lit(c).alias("class_id"), F.col(f"class_{c}").alias("n"))
            for c in K.CLASS_IDS
        ]
    )
    present = F.filter(counts, lambda x: x["n"] > 0)
    thin = F.filter(present, lambda x: x["n"] < min_per_class)
    detail = F.array_join(
        F.transform(
            thin,
            lambda x: F.concat(
                F.lit("class "), x["class_id"].cast("string"), F.lit(": "), x["n"].cast("string")
            ),
        ),
        ", ",
    )
    problem = (
        F.when(F.col("rows_used") == 0, "no labelled rows")
        .when(
            F.size(present) < 2,
            F.concat(
                F.lit("only one threat class: "), present[0]["class_id"].cast("string")
            ),
        )
        .when(
            F.col("rows_used") < min_total,
            F.concat(
                F.lit("only "), F.col("rows_used").cast("string"),
                F.lit(f" usable rows, at least {min_total} needed"),
            ),
        )
        .when(
            F.size(thin) > 0,
            F.concat(
                F.lit("too few rows ("), detail, F.lit(f"), at least {min_per_class} each needed")
            ),
        )
        .otherwise("")
    )
    return totals.withColumn("problem", problem)


def read(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """Files of labelled events, featurised: label, label_key, shape and error per row.

    Labels of JSON events are resolved cell by cell, those of CSV columns by their text.
    Lines that hold no event are rows with an error and without a label, so that a report
    counts them.
    """
    events = ingest.read_events(spark, path, fmt, keep_broken=True)
    labelled = (
        with_variant_label(events) if "event" in events.columns else with_label(events)
    )
    failed = F.col("error")
    return featurise(labelled.withColumnRenamed("error", "_error")).withColumn(
        "error", F.coalesce("_error", failed)
    )


def load(rows: DataFrame, order: str) -> DataFrame:
    """Usable labelled rows; raises DatasetError with the first problem found."""
    problem = check(report(rows, order)).first().problem
    if problem:
        raise DatasetError(problem)
    return rows.filter(F.col("label").isNotNull() & F.col("error").isNull())


def availability(rows: DataFrame, label: str = "label") -> DataFrame:
    """Events per class with zeros, the total, and whether the class can be sampled."""
    counts = rows.agg(
        *[F.count_if(F.col(label) == c).alias(f"n{c}") for c in K.CLASS_IDS],
    )
    lines = F.array(
        *[
            F.struct(F.lit(c).alias("class_id"), F.col(f"n{c}").alias("n"))
            for c in K.CLASS_IDS
        ]
    )
    total = sum((F.col(f"n{c}") for c in K.CLASS_IDS), F.lit(0))
    return counts.select(total.cast("bigint").alias("total"), F.inline(lines)).withColumn(
        "available", (F.col("n") > 0).cast("int")
    )


def cached_copy(spark: SparkSession, path: str, key: dict, build) -> DataFrame:
    """A parquet copy of build()'s result, reused until a source file changes.

    The copy's folder name holds a hash of the newest modification time, the
    number and the size of the source files, and of the key.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    state = files.select("path", "modificationTime", "length").distinct().agg(
        F.max("modificationTime").cast("string").alias("newest"),
        F.count("*").alias("files"),
        F.sum("length").alias("bytes"),
    )
    stamp = F.sha2(F.concat_ws("|", "newest", "files", "bytes", F.lit(path),
                               F.lit(json.dumps(key, sort_keys=True))), 256)
    copy = f"{shared_dir(spark)}/cache-{state.select(stamp).first()[0]}"
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{copy}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(copy)
    return spark.read.parquet(copy)
