"""Dense ranks and splits inside a few very large groups.

A window over (class, order) would sort a whole class in one task. Here rows are
ordered by a hash of their id, the leading hex digits of the hash cut every
class into equal slices, the slice sizes give each slice its offset, and only
the slice is sorted. The result is the same dense rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, id_col: str) -> Column:
    """A pseudo-random order that does not depend on partitions or retries."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def with_group_rank(
    df: DataFrame,
    group: str,
    id_col: str,
    seed: int = 42,
    digits: int = 4,
    rank: str = "rank",
    size: str = "group_size",
) -> DataFrame:
    """Adds the 1-based rank of each row in its group by hash order, and the group's size.

    id_col must be unique in the group. There are 16**digits slices per group.
    """
    hashed = df.withColumn("_h", hash_order(seed, id_col)).withColumn(
        "_slice", F.substring("_h", 1, digits)
    )
    per_slice = hashed.groupBy(group, "_slice").agg(F.count("*").alias("_n"))
    before = (
        Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_slice.select(
        group,
        "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(group)).alias(size),
    )
    inside = F.row_number().over(Window.partitionBy(group, "_slice").orderBy("_h"))
    return (
        hashed.join(offsets, [group, "_slice"])
        .withColumn(rank, (F.col("_before") + inside).cast("bigint"))
        .drop("_h", "_slice", "_before")
    )


def holdout_split(
    df: DataFrame, label: str, id_col: str, share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds `split`: 'test' for round(share * n) rows of every class, else 'train'."""
    ranked = with_group_rank(df, label, id_col, seed)
    is_test = F.col("rank") <= F.round(F.col("group_size") * share)
    return ranked.withColumn("split", F.when(is_test, "test").otherwise("train")).drop(
        "rank", "group_size"
    )


def fold_count(df: DataFrame, label: str, folds: int = 5) -> int:
    """min(folds, rows of the rarest class); below 2 there is no cross-validation."""
    rarest = df.groupBy(label).count().agg(F.min("count")).first()[0]
    return min(folds, int(rarest or 0))


def kfold(
    df: DataFrame, label: str, id_col: str, folds: int = 5, seed: int = 42
) -> DataFrame:
    """Adds `fold`: every class is dealt out evenly over the folds."""
    k = fold_count(df, label, folds)
    if k < 2:
        raise ValueError("the rarest class has fewer than two rows: no folds")
    ranked = with_group_rank(df, label, id_col, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop(
        "rank", "group_size"
    )


def hash_key(seed: int, id_col: str) -> Column:
    """The first 60 bits of the hash order as a number."""
    return F.conv(F.substring(hash_order(seed, id_col), 1, 15), 16, 10).cast("bigint")


def sample_per_class(df: DataFrame, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """One pseudo-random row per class.

    The smallest key per class is a hash aggregate over one number; the row is
    then fetched by a join with at most one key per class. Aggregating the row
    itself would make Spark sort all rows by class.
    """
    keyed = df.withColumn("_key", hash_key(seed, id_col))
    least = keyed.groupBy(label).agg(F.min("_key").alias("_key"))
    return keyed.join(least, [label, "_key"], "left_semi").select(*df.columns)


class EmptyClassError(ValueError):
    """A class has no event to sample; the message has the events per class."""


def samples_per_class(
    df: DataFrame, label: str, id_col: str, seeds: tuple[int, ...], needed: tuple[int, ...] = ()
) -> DataFrame:
    """The rows of sample_per_class for several seeds, with `seed`, in two scans.

    What passes through the driver is one number a class and seed. A class of `needed`
    without a row raises EmptyClassError.
    """
    keys = {s: hash_key(s, id_col) for s in seeds}
    least = df.groupBy(label).agg(
        F.count("*").alias("n"), *[F.min(k).alias(f"k{s}") for s, k in keys.items()]
    ).collect()
    counts = {r[label]: r.n for r in least}
    if missing := [c for c in needed if not counts.get(c)]:
        raise EmptyClassError(f"no event of class {missing}; events per class: {counts}")
    chosen = F.array(
        *[
            F.when(F.struct(F.col(label), key).isin(
                *[F.struct(F.lit(r[label]), F.lit(r[f"k{s}"])) for r in least]
            ), F.lit(s))
            for s, key in keys.items()
        ]
    )
    marked = df.withColumn("seed", F.filter(chosen, lambda s: s.isNotNull()))
    return marked.filter(F.size("seed") > 0).withColumn("seed", F.explode("seed"))
