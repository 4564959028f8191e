"""Column scaling with the population deviation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaler_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: mean, population deviation and the divisor used.

    One pass and one row per task, whatever the number of rows.
    """
    sums = [F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"{c}.mean").alias("mean"),
                F.col(f"{c}.std").alias("std"),
            )
            for c in columns
        ]
    )
    return (
        df.agg(*sums)
        .select(F.inline(rows))
        .withColumn("divisor", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))
    )


@dataclass(frozen=True)
class Scaler:
    """Fitted means and divisors, two numbers per column."""

    means: dict[str, float]
    divisors: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> "Scaler":
        fitted = scaler_stats(df, columns).collect()
        return Scaler(
            {r.feature: r.mean for r in fitted}, {r.feature: r.divisor for r in fitted}
        )

    def transform(self, df: DataFrame) -> DataFrame:
        """Scales in place; the numbers are literals of a narrow projection."""
        return df.withColumns(
            {
                c: (F.col(c) - F.lit(self.means[c])) / F.lit(self.divisors[c])
                for c in self.means
            }
        )


def vector_stats(df: DataFrame, vector: str) -> DataFrame:
    """Mean and population deviation per position of an array column."""
    return (
        df.select(F.posexplode(vector).alias("position", "value"))
        .groupBy("position")
        .agg(
            F.avg(F.col("value").cast("double")).alias("mean"),
            F.stddev_pop(F.col("value").cast("double")).alias("std"),
        )
    )
