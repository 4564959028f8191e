"""Counts over a trailing time window per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_trailing_count(
    rows: DataFrame,
    key: str,
    time_us: str,
    counted: Column,
    window_us: int,
    out: str,
    include_current: bool = True,
) -> DataFrame:
    """Adds how many counted rows of the same key lie in [t - window, t].

    With include_current=False the window is [t - window, t). key and time_us
    must not be null.

    A key may hold a large part of all rows, so its window is not one sort:
    rows are first counted per (key, time), and the counts are cut into slices
    of one window length. A slice also gets the counts of the slice before it,
    which is all that its trailing windows can reach.
    """
    per_time = rows.groupBy(key, time_us).agg(F.sum(counted.cast("bigint")).alias("_n"))
    start_of_slice = F.col(time_us) - F.pmod(F.col(time_us), F.lit(window_us))
    slices = per_time.withColumn(
        "_ahead",
        F.explode(F.when(F.col("_n") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    ).withColumn(
        "_slice",
        F.call_function("div", start_of_slice, F.lit(window_us)) + F.col("_ahead"),
    )
    window = (
        Window.partitionBy(key, "_slice")
        .orderBy(time_us)
        .rangeBetween(-window_us, 0 if include_current else -1)
    )
    counts = (
        slices.withColumn(out, F.coalesce(F.sum("_n").over(window), F.lit(0)))
        .filter(F.col("_ahead") == 0)
        .select(key, time_us, out)
    )
    return rows.join(counts, [key, time_us])
