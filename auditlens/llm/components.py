"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the members of a group are dealt to when they look up what the group has in common.
SLICES = 16


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs every larger neighbour of a node on the node's smallest one. Here u > v.

    A node with no smaller neighbour keeps its larger ones, and may have very many of them.
    The smallest neighbours are checkpointed: both sides of the join are then plain shuffles,
    of which Spark splits a hot key's part.
    """
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")).checkpoint()
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs a node and its smaller neighbours on the smallest one. Here u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), "m")
    return hung.union(least.select("u", "m")).toDF("u", "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (u, v) edges: the smallest node it can reach.

    Nodes are longs. Every round is checkpointed, so the lineage stays short and survives
    lost executors. It ends when a round changes
    nothing. Loops and repeated edges are allowed; a node with only a loop is left out.
    """
    now = (
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
        .checkpoint()
    )
    mark = None
    while True:
        summary = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        if summary == mark or not summary[0]:
            break
        mark = summary
        now = _small_star(_large_star(now)).checkpoint()
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def with_least(members: DataFrame, roots: DataFrame, node: str, value: str) -> DataFrame:
    """Adds root and component, the smallest `value` of a group, to every row of members.

    roots is what components() gives; a node that is not in it is a group of its own. Members
    look their group up in slices, each of which has a copy of the group's row, so a group may
    hold any share of them. Nulls do not count as smallest; a group of nulls only has null.
    """
    found = members.join(roots.withColumnRenamed("node", node), node, "left")
    least = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(value).alias("component"))
    copies = least.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    sliced = found.withColumns(
        {"root": F.coalesce("root", node), "slice": F.pmod(F.xxhash64(node), F.lit(SLICES)).cast("int")}
    )
    named = sliced.join(copies, ["root", "slice"], "left").drop("slice")
    return named.withColumn("component", F.coalesce("component", value))
