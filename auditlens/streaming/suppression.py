"""Duplicate suppression that loses no row: what comes too late is kept beside the rest.

Spark's own dropDuplicatesWithinWatermark drops rows behind the watermark without a trace.
Here a micro-batch is settled against a bound that earlier batches have set, and every
delivery ends up scored, as a duplicate, or late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.functions import times

SCORED, DUPLICATE, LATE = "scored", "duplicate", "late"
LIVE = "live array<struct<batch: bigint, high: bigint>>"
MINUTE = 60_000_000


def _before(spark: SparkSession, path: str, batch: int) -> list:
    """The batches before this one that still count, as (number, its highest time)."""
    if batch == 0:
        return []
    return spark.read.schema(LIVE).parquet(f"{path}/bounds/batch={batch - 1}").first().live


def settle(
    rows: DataFrame,
    path: str,
    batch: int,
    look_back: int = 60,
    id_col: str = "event_id",
    time: Column | None = None,
) -> None:
    """Store one micro-batch as rows with an outcome and the number of their deliveries.

    Late is what is more than `look_back` minutes before the highest time of earlier batches.
    Of the others the first delivery of an id is scored, further ones are duplicates, within
    the batch or of an earlier one; they are counted, not kept. A scored id is known for as
    long as its time is not behind the bound. Rows without an id are never duplicates, rows
    without a time never late and known within their batch only.

    Deliveries of one id are added up before the shuffle, so one id may be any share of the
    rows. What is read of earlier batches are the ids and times of those inside the look-back.
    A batch that runs again writes over what it had written.
    """
    spark = rows.sparkSession
    us = times.micros(F.col("event_time")) if time is None else time
    before = _before(spark, path, batch)
    bound = max((b.high for b in before), default=None)
    bound = None if bound is None else bound - look_back * MINUTE
    live = [b for b in before if b.high >= bound]
    late = F.lit(False) if bound is None else F.coalesce(us < bound, F.lit(False))
    whole = F.struct(*[F.col(c) for c in rows.columns]).alias("row")
    known_id = F.col(id_col).isNotNull()
    firsts = (
        rows.filter(~late & known_id)
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.first(whole).alias("row"), F.count("*").alias("deliveries"))
    )
    if live:
        folders = [f"{path}/rows/batch={b.batch}/outcome={SCORED}" for b in live]
        seen = spark.read.schema(rows.schema).parquet(*folders).filter(us >= bound)
        seen = seen.select(F.col(id_col).alias("id"), F.lit(True).alias("seen"))
        firsts = firsts.join(seen, "id", "left")
    else:
        firsts = firsts.withColumn("seen", F.lit(None).cast("boolean"))
    again = F.col("seen").isNotNull()
    copies = F.col("deliveries") - F.when(again, 0).otherwise(1)
    named = firsts.select(
        "row",
        F.inline(
            F.array(
                F.struct(
                    F.lit(SCORED).alias("outcome"),
                    F.when(again, 0).otherwise(1).cast("bigint").alias("deliveries"),
                ),
                F.struct(F.lit(DUPLICATE).alias("outcome"), copies.alias("deliveries")),
            )
        ),
    ).filter("deliveries > 0")
    one = F.lit(1).cast("bigint").alias("deliveries")
    unnamed = rows.filter(~late & ~known_id).select(whole, F.lit(SCORED).alias("outcome"), one)
    behind = rows.filter(late).select(whole, F.lit(LATE).alias("outcome"), one)
    settled = named.unionByName(unnamed).unionByName(behind)
    target = f"{path}/rows/batch={batch}"
    settled.select("row.*", "outcome", "deliveries").write.mode("overwrite").partitionBy(
        "outcome"
    ).parquet(target)
    stored = spark.read.schema(_schema(rows)).parquet(target).filter(F.col("outcome") == SCORED)
    high = stored.agg(F.max(us)).first()[0]
    if high is not None:
        live = [*live, (batch, high)]
    spark.createDataFrame([(live,)], LIVE).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/bounds/batch={batch}"
    )


def _schema(rows: DataFrame) -> str:
    parts = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return ", ".join([*parts, "deliveries bigint", "outcome string"])


def run(events: DataFrame, path: str, look_back: int = 60, **options) -> None:
    """Settle everything that has arrived at a stream; a later run goes on from there."""

    def each(batch: DataFrame, number: int) -> None:
        settle(batch, path, number, look_back, **options)

    writer = events.writeStream.foreachBatch(each).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{path}/checkpoint").start().awaitTermination()


def deliveries(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """All settled rows with the columns of `rows`, their outcome, deliveries and batch."""
    return spark.read.schema(f"{_schema(rows)}, batch bigint").parquet(f"{path}/rows")
