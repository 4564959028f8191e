"""Shards of equal numbers of rows, by balanced label propagation.

Documents with equal texts are linked. Linked documents start dealt out evenly and then move,
round by round, to the shard where most of their neighbours are. A shard takes no more than
its quota: moves both ways between two shards are swapped, what is left over goes into free
room. Unlinked documents then fill every shard up to its exact share.

All neighbours of a document are its group, so what a round needs of a group is how many of
its documents are in each shard: the state is one row a group, and nothing in it grows with
the group. Documents get their places in the end, by their rank in the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens.llm.common import content_key, scratch

ROUNDS = 12
#: Rows that are ranked together, about, and the least numbers of slices: of all rows, and
#: of a group.
SLICE, LEAST_SLICES, LEAST_GROUP_SLICES = 20_000, 512, 64


def _sum_before(df: DataFrame, by: list[str], order: list, amount: str, slices: int) -> DataFrame:
    """Adds `before`: the sum of the amounts of the rows that come first in the same `by`.

    order names a column of few values and then columns that tell rows apart. Rows are cut by
    the first and by a hash of the others; the slices' sums, few rows, give every slice its
    offset, and only a slice is sorted.
    """
    first, *others = order
    cut = df.withColumn("_cut", F.pmod(F.xxhash64(*others), F.lit(slices)))
    earlier = Window.partitionBy(*by).orderBy(first, "_cut")
    offsets = (
        cut.groupBy(*by, first, "_cut")
        .agg(F.sum(amount).alias("_sum"))
        .withColumn("_offset", F.sum("_sum").over(earlier) - F.col("_sum"))
        .drop("_sum")
    )
    inside = Window.partitionBy(*by, first, "_cut").orderBy(*others)
    return (
        cut.withColumn(
            "_inside", F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, -1))
        )
        .join(offsets, [*by, first, "_cut"])
        .withColumn("before", F.col("_offset") + F.coalesce("_inside", F.lit(0)))
        .drop("_cut", "_inside", "_offset")
    )


def _array(values: list) -> Column:
    return F.array(*(F.lit(int(v)) for v in values)).cast("array<bigint>")


def _moves(groups: DataFrame, free: list[int], everywhere: bool) -> DataFrame:
    """(g1, g2, from, to, n, class): where the documents of each group in a shard
    would go: to the shard with most of the group, and on a tie to the first by a hash.

    everywhere: to any shard; else only to shards with room.
    """
    room = _array(free)
    rank = lambda s, n: F.struct(n.alias("n"), F.xxhash64("g1", s).alias("h"), s.alias("s"))
    each = F.transform(F.col("counts"), lambda n, s: rank(s, n))
    held = groups.withColumn("each", F.filter(each, lambda x: x.n > 0))
    targets = (
        F.col("each")
        if everywhere
        else F.filter("each", lambda x: F.element_at(room, x.s + 1) > 0)
    )
    return (
        held.withColumn("best", F.array_max(targets))
        .filter("best IS NOT NULL AND size(each) > 1")
        .withColumn("one", F.explode("each"))
        .filter("one < best")
        .select(
            "g1",
            "g2",
            F.col("one.s").alias("from"),
            F.col("best.s").alias("to"),
            F.col("one.n").alias("n"),
            (-F.floor(F.log2(F.col("best.n")))).alias("class"),
        )
    )


def _quotas(wanted: dict, free: list[int], shards: int) -> list[list[int]]:
    """How many documents may go from each shard to each.

    First exchanges, which need no room: along the cycles of the wanted moves, short ones
    first. Then the free room of each shard, shared by what is still wanted.
    """
    want = [[wanted.get((a, b), 0) for b in range(shards)] for a in range(shards)]
    out = [[0] * shards for _ in range(shards)]
    while cycle := _cycle(want):
        steps = list(zip(cycle, cycle[1:] + cycle[:1], strict=True))
        amount = min(want[a][b] for a, b in steps)
        for a, b in steps:
            want[a][b] -= amount
            out[a][b] += amount
    for b in range(shards):
        rest = [want[a][b] for a in range(shards)]
        left = min(free[b], sum(rest))
        share = [left * n // max(sum(rest), 1) for n in rest]
        left -= sum(share)
        for a in range(shards):
            more = min(left, rest[a] - share[a])
            out[a][b] += share[a] + more
            left -= more
    return out


def _cycle(want: list[list[int]]) -> list[int] | None:
    """A shortest cycle of wanted moves between shards."""
    shards, best = len(want), None
    for start in range(shards):
        paths = [[start]]
        while paths and best is None or paths and len(paths[0]) < len(best or ()):
            longer, seen = [], {p[-1] for p in paths}
            for path in paths:
                if want[path[-1]][start] and (best is None or len(path) < len(best)):
                    best = path
                for b in range(shards):
                    if want[path[-1]][b] and b not in path and b not in seen:
                        seen.add(b)
                        longer.append([*path, b])
            paths = longer
    return best


def _propagated(groups: DataFrame, quota: list[int], slices: int, rounds: int) -> DataFrame:
    """The groups' counts by shard after the moves."""
    shards = len(quota)
    everywhere = False
    for _ in range(rounds):
        loads = groups.agg(*(F.sum(F.col("counts")[s]) for s in range(shards))).first()
        free = [q - (n or 0) for q, n in zip(quota, loads, strict=True)]
        everywhere = everywhere or max(free) <= 0
        moves = _moves(groups, free, everywhere).checkpoint()
        wanted = {
            (r["from"], r["to"]): r["n"]
            for r in moves.groupBy("from", "to").agg(F.sum("n").alias("n")).collect()
        }
        allowed = _quotas(wanted, free, shards)
        if not any(map(any, allowed)):
            if everywhere:
                break
            everywhere = True  # nothing fits: exchanges with full shards are tried
            continue
        everywhere = False
        limit = _array([n for row in allowed for n in row])
        limit = F.element_at(limit, (F.col("from") * shards + F.col("to") + 1).cast("int"))
        taken = F.greatest(F.least("n", limit - F.col("before")), F.lit(0))
        ranked = _sum_before(moves, ["from", "to"], ["class", "g1", "g2"], "n", slices)
        change = [
            F.sum(
                F.when(F.col("to") == s, F.col("taken"))
                .when(F.col("from") == s, -F.col("taken"))
                .otherwise(0)
            )
            for s in range(shards)
        ]
        admitted = (
            ranked.withColumn("taken", taken)
            .filter("taken > 0")
            .groupBy("g1", "g2")
            .agg(F.array(*change).alias("change"))
        )
        groups = (
            groups.join(admitted, ["g1", "g2"], "left")
            .withColumn(
                "counts",
                F.when(F.col("change").isNull(), F.col("counts")).otherwise(
                    F.zip_with("counts", "change", lambda n, c: n + c)
                ),
            )
            .drop("change")
            .checkpoint()
        )
    return groups


def balanced_shards(
    docs: DataFrame,
    shards: int = 8,
    rounds: int = ROUNDS,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row.

    Shards differ by one row at most, the first ones having more; slots count from 0 without
    gaps. size is the text's UTF-8 bytes plus 1. A null text counts no bytes, has the
    checksum of the empty text, and is linked to nothing; empty texts are equal texts.
    Repeated rows are linked. A group larger than a shard fills as few shards as the rounds
    reach. An empty table gives an empty result. The result does not depend on partitions.
    """
    scratch(docs.sparkSession)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    one, two = content_key(F.col(text))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        one.alias("g1"),
        two.alias("g2"),
    ).checkpoint()
    total = rows.count()
    slices = max(LEAST_SLICES, -(-total // SLICE))
    quota = [total // shards + (s < total % shards) for s in range(shards)]

    # Ranks in a group are cut by a hash of the id, so no task holds a whole group.
    group_slices = max(LEAST_GROUP_SLICES, -(-total // SLICE))
    cut = rows.withColumn("cut", F.pmod(F.xxhash64("id"), F.lit(group_slices)))
    parts = cut.filter("g1 IS NOT NULL").groupBy("g1", "g2", "cut").agg(F.count("*").alias("n"))
    of_group = Window.partitionBy("g1", "g2")
    parts = (
        parts.withColumn("group", F.sum("n").over(of_group))
        .filter("group > 1")
        .withColumn("part", F.sum("n").over(of_group.orderBy("cut")) - F.col("n"))
        .select("g1", "g2", "cut", "group", "part")
        .checkpoint()
    )
    sizes = parts.groupBy("g1", "g2").agg(F.first("group").alias("n")).withColumn("all", F.lit(0))
    dealt = _sum_before(sizes, [], ["all", "g1", "g2"], "n", slices)
    whole = F.col("n") / shards
    extra = lambda s: F.pmod(F.lit(s) - F.col("before"), F.lit(shards)) < F.pmod("n", F.lit(shards))
    groups = dealt.select(
        "g1",
        "g2",
        F.array(
            *(F.floor(whole) + extra(s).cast("bigint") for s in range(shards))
        ).alias("counts"),
    ).checkpoint()
    groups = _propagated(groups, quota, slices, rounds)

    # Where a group's documents stand in each shard, then the documents by rank.
    pieces = groups.select("g1", "g2", F.posexplode("counts").alias("shard", "n"))
    pieces = pieces.withColumn("all", F.lit(0)).filter("n > 0")
    placed = _sum_before(pieces, ["shard"], ["all", "g1", "g2"], "n", slices)
    places = placed.groupBy("g1", "g2").agg(
        F.array_sort(F.collect_list(F.struct("shard", "n", F.col("before").alias("slot")))).alias(
            "places"
        )
    )
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("end"), F.lit(-1).alias("shard"), zero.alias("slot"))
    found = F.aggregate(
        "places",
        start,
        lambda acc, p: F.when(acc["shard"] >= 0, acc).otherwise(
            F.struct(
                (acc["end"] + p["n"]).alias("end"),
                F.when(F.col("rank") < acc["end"] + p["n"], p["shard"])
                .otherwise(F.lit(-1))
                .alias("shard"),
                (p["slot"] + F.col("rank") - acc["end"]).alias("slot"),
            )
        ),
    )
    inside = Window.partitionBy("g1", "g2", "cut").orderBy("id")
    keyed = cut.join(parts.join(places, ["g1", "g2"]), ["g1", "g2", "cut"], "left")
    linked = (
        keyed.filter("part IS NOT NULL")
        .withColumn("rank", F.col("part") + F.row_number().over(inside) - 1)
        .withColumn("found", found)
        .select("id", "size", "text_crc32", "found.shard", "found.slot")
    )
    loads = groups.agg(*(F.sum(F.col("counts")[s]) for s in range(shards))).first()
    loads = [n or 0 for n in loads]
    ends = [sum(quota[: s + 1]) - sum(loads[: s + 1]) for s in range(shards)]
    singles = _sum_before(
        keyed.filter("part IS NULL").select(
            "id", "size", "text_crc32", "g1", "g2", F.lit(0).alias("all"), F.lit(1).alias("one")
        ),
        [],
        ["all", "id", "text_crc32", "size"],
        "one",
        slices,
    )
    shard = F.size(F.filter(_array(ends), lambda end: end <= F.col("before")))
    offset = _array([n - (ends[s - 1] if s else 0) for s, n in enumerate(loads)])
    filling = singles.withColumn("shard", shard).select(
        "id",
        "size",
        "text_crc32",
        "shard",
        (F.element_at(offset, F.col("shard") + 1) + F.col("before")).alias("slot"),
    )
    return linked.unionByName(filling)


def shard_report(docs: DataFrame) -> DataFrame:
    """Per document its size, checksum, shard and slot under the law of equal rows."""
    return balanced_shards(docs.select("doc_id", "text")).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
