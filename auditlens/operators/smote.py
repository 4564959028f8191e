"""Oversampling of thin classes between near neighbours of the same class.

Rows with equal features are collapsed first, with their number, so a group of
copies is one point. Points go to cells around pivots; a point is only compared
with cells whose bounding box is nearer than the k-th neighbour it already has,
and a comparison is one block of points against another inside a task. Pairs never become rows: a block gives at most k
neighbours per point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens.operators.balance import uniform
from auditlens.operators.ranking import with_group_rank
from auditlens.session import materialise

NEIGHBOUR = "label int, vid string, nvid string, dist double"
#: Distances that a task holds at a time, and vectors it holds the differences of.
AT_ONCE, MEASURED = 1_000_000, 50_000


def _slices(rows: int, columns: int) -> Iterator[slice]:
    """The rows in runs whose distances to that many others are at most AT_ONCE."""
    step = max(1, AT_ONCE // max(1, columns))
    for i in range(0, rows, step):
        yield slice(i, i + step)


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()) if len(series) else np.empty((0, 0))


def _estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and by row of a how far off they may be.

    A product of two vectors in doubles is off by at most its length times the machine's
    precision times both norms; the margin here is four times that.
    """
    left, right = (np.einsum("ij,ij->i", x, x) for x in (a, b))
    off = 4 * (a.shape[1] + 4) * np.finfo(np.float64).eps * (left + right.max(initial=0.0))
    dist = a @ b.T
    dist *= -2.0
    dist += left[:, None]
    dist += right
    return dist, off


def _block_neighbours(probes: pd.DataFrame, residents: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest residents of every probe, without the probe itself.

    Estimates leave the residents that can be among them; these are measured and sorted. A
    probe's `bound` is at least the distance of its k-th neighbour: what is beyond it is none,
    and k more are only looked for where many residents are within.
    """
    empty = pd.DataFrame({"label": [], "vid": [], "nvid": [], "dist": []})
    if not len(probes) or not len(residents):
        return empty.astype({"label": "int32", "dist": "float64"})
    a, b = _matrix(probes.vec), _matrix(residents.vec)
    ids = residents.vid.to_numpy()
    dist, off = _estimates(a, b)
    own = pd.Index(ids).get_indexer(probes.vid)
    rows = np.flatnonzero(own >= 0)
    dist[rows, own[rows]] = np.inf
    near = ~np.isposinf(dist)
    if "bound" in probes:
        near &= ~(dist > (probes.bound.to_numpy(np.float64) * (1 + 1e-9) + off)[:, None])
    many = np.flatnonzero(near.sum(axis=1) > 4 * k)
    if len(many) and len(b) > k:
        limit = np.partition(dist[many], k - 1, axis=1)[:, k - 1] + 2 * off[many]
        near[many] &= ~(dist[many] > limit[:, None])
    rows, cols = np.nonzero(near)
    flat = np.empty(len(rows))
    for i in range(0, len(rows), MEASURED):
        diff = a[rows[i : i + MEASURED]] - b[cols[i : i + MEASURED]]
        flat[i : i + MEASURED] = np.einsum("ij,ij->i", diff, diff)
    found = pd.DataFrame({"row": rows, "nvid": ids[cols], "dist": flat})
    found = found[np.isfinite(flat)].sort_values(["row", "dist", "nvid"])
    found = found.groupby("row", sort=False).head(k)
    row = found.row.to_numpy()
    return pd.DataFrame(
        {
            "label": probes.label.to_numpy()[row],
            "vid": probes.vid.to_numpy()[row],
            "nvid": found.nvid.to_numpy(),
            "dist": found.dist.to_numpy(),
        }
    )


def points(
    df: DataFrame, columns: list[str], label: str = "label", extra: Column | None = None
) -> DataFrame:
    """One row per class and distinct feature vector, with its number of copies.

    extra is one more aggregate over the copies.
    """
    kept = [c for c in df.columns if c not in (label, *columns)]
    more = [] if extra is None else [extra]
    vec = F.array(*[F.col(c).cast("double") for c in columns])
    vid = F.md5(F.array_join(vec.cast("array<string>"), ","))
    return (
        df.select(*kept, F.col(label).cast("int").alias("label"), vec.alias("vec"), vid.alias("vid"))
        .groupBy("label", "vid", "vec")
        .agg(F.count("*").alias("copies"), *more)
    )


def _gaps(
    vec: np.ndarray, rows: np.ndarray, cols: np.ndarray, lo: np.ndarray, hi: np.ndarray
) -> np.ndarray:
    """Squared distances of points to boxes, pair by pair."""
    out = np.empty(len(rows))
    for i in range(0, len(rows), MEASURED):
        at, box = rows[i : i + MEASURED], cols[i : i + MEASURED]
        x = vec[at]
        gap = np.maximum(np.maximum(lo[box] - x, x - hi[box]), 0.0)
        out[i : i + MEASURED] = np.einsum("ij,ij->i", gap, gap)
    return out


def _may_reach(vec: np.ndarray, centre: np.ndarray, far: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """point x cell: False where every point of the cell is surely beyond the point's limit.

    A cell's points are at most `far` (squared) from its centre, so they are at least the
    distance to the centre less that from a point.
    """
    dist, off = _estimates(vec, centre)
    least = np.sqrt(np.maximum(dist - off[:, None], 0.0)) * (1 - 1e-9) - np.sqrt(far) * (1 + 1e-9)
    return ~((least > 0) & (least * least > limit[:, None]))


def _pivots(pts: DataFrame, block: int, most: int) -> dict[int, np.ndarray]:
    """Up to `most` pseudo-random points per class, about one per block of points."""
    sizes = {r.label: r["count"] for r in pts.groupBy("label").count().collect()}
    wanted = {c: min(most, -(-n // block)) for c, n in sizes.items()}
    order = F.row_number().over(Window.partitionBy("label").orderBy("vid"))
    limit = F.lit(0)
    for c, n in wanted.items():
        limit = F.when(F.col("label") == c, n).otherwise(limit)
    chosen = (
        pts.select("label", "vid", "vec")
        .withColumn("_rn", order)
        .filter(F.col("_rn") <= max(wanted.values()))
        .filter(F.col("_rn") <= limit)
        .collect()
    )
    return {c: np.array([r.vec for r in chosen if r.label == c]) for c in wanted}


def nearest_neighbours(
    pts: DataFrame,
    k: int,
    block: int = 2000,
    most_pivots: int = 4096,
    wanted: DataFrame | None = None,
    most_cells: int | None = None,
    spacing: int | None = None,
) -> DataFrame:
    """The k nearest other points of the same class for every point.

    They are exact without most_cells. With it a point is compared with that many cells at
    most, the nearest by their boxes, so that the work grows with the points and not with
    points times cells; in a class of no more cells they are still exact.

    pts comes from points() and should be a written table. Gives (label, vid,
    nvid, dist) with the squared distance; with wanted (label, vid), only for
    these points, so that the work follows what is needed. What is sent to all
    tasks is the pivots and the cells' boxes: at most most_pivots of each per class.
    There is a pivot for `spacing` points (block, if not given). Where few columns vary
    freely, small cells leave a point far fewer others to be compared with.
    """
    pivots = _pivots(pts, spacing or block, most_pivots)
    flagged = pts.select("label", "vid", "vec", F.lit(True).alias("wanted"))
    if wanted is not None:
        marks = wanted.select("label", "vid").distinct().withColumn("wanted", F.lit(True))
        flagged = (
            pts.select("label", "vid", "vec")
            .join(marks, ["label", "vid"], "left")
            .withColumn("wanted", F.col("wanted").isNotNull())
        )

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells, far = np.zeros(len(pdf), dtype="int32"), np.zeros(len(pdf))
            for c, group in pdf.groupby("label"):
                vec, at = _matrix(group.vec), pdf.index.get_indexer(group.index)
                for run in _slices(len(vec), len(pivots[c])):
                    dist, off = _estimates(vec[run], pivots[c])
                    cells[at[run]] = dist.argmin(axis=1)
                    far[at[run]] = np.maximum(dist.min(axis=1), 0.0) + off
            yield pdf.assign(cell=cells, far=far)

    celled = materialise(
        flagged.mapInPandas(
            to_cells,
            "label int, vid string, vec array<double>, wanted boolean, cell int, far double",
        ),
        "cells",
    )
    dims = len(next(iter(pivots.values()))[0])
    box = celled.groupBy("label", "cell").agg(
        F.count("*").alias("n"),
        F.max("far").alias("far"),
        *[F.min(F.col("vec")[i]).alias(f"lo{i}") for i in range(dims)],
        *[F.max(F.col("vec")[i]).alias(f"hi{i}") for i in range(dims)],
    ).collect()
    boxes = {}
    for c in pivots:
        mine = [r for r in box if r.label == c]
        boxes[c] = (
            np.array([r.cell for r in mine]),
            np.array([[r[f"lo{i}"] for i in range(dims)] for r in mine]),
            np.array([[r[f"hi{i}"] for i in range(dims)] for r in mine]),
            np.array([-(-r.n // block) for r in mine]),
            np.array([r.far for r in mine]),
        )
    # A cell larger than a block is cut into chunks by a hash of the point.
    cut = celled.sparkSession.createDataFrame(
        [(r.label, r.cell, -(-r.n // block)) for r in box], "label int, cell int, chunks int"
    )
    chunk = F.pmod(F.xxhash64("vid"), F.col("chunks")).cast("int")
    resident = celled.join(F.broadcast(cut), ["label", "cell"]).withColumn("chunk", chunk)

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        """The distance of the k-th neighbour inside the chunk, an upper bound."""
        probes = pdf[pdf.wanted.to_numpy(bool)]
        within = np.full(len(probes), np.inf)
        if len(probes) and len(pdf) > k:
            dist, off = _estimates(_matrix(probes.vec), _matrix(pdf.vec))
            dist[np.arange(len(probes)), pdf.index.get_indexer(probes.index)] = np.inf
            within = np.maximum(np.partition(dist, k - 1, axis=1)[:, k - 1], 0.0) + off
        return probes.assign(bound=within)[["label", "vid", "vec", "bound"]]

    bounded = resident.groupBy("label", "cell", "chunk").applyInPandas(
        bound, "label int, vid string, vec array<double>, bound double"
    )

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each point once per chunk of every cell its neighbours may be in."""
        for pdf in batches:
            for c, group in pdf.groupby("label"):
                cells, lo, hi, chunks, far = boxes[c]
                vec, centre = _matrix(group.vec), pivots[c][cells]
                vid, limits = group.vid.to_numpy(), group.bound.to_numpy() * (1 + 1e-9)
                for run in _slices(len(vec), len(cells)):
                    x, limit = vec[run], limits[run]
                    if most_cells and len(cells) > most_cells:
                        rows, cols = np.indices((len(x), len(cells))).reshape(2, -1)
                        gaps = _gaps(x, rows, cols, lo, hi)
                        order = np.argsort(gaps.reshape(len(x), -1), axis=1, kind="stable")
                        rank = np.empty_like(order)
                        np.put_along_axis(rank, order, np.arange(len(cells))[None, :], axis=1)
                        reached = (gaps <= limit[rows]) & (rank.ravel() < most_cells)
                    else:
                        rows, cols = np.nonzero(_may_reach(x, centre, far, limit))
                        reached = _gaps(x, rows, cols, lo, hi) <= limit[rows]
                    rows, cols = rows[reached], cols[reached]
                    each = chunks[cols]
                    part = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    rows, cols = np.repeat(rows, each), np.repeat(cols, each)
                    yield pd.DataFrame(
                        {"label": c, "vid": vid[run][rows], "cell": cells[cols], "chunk": part,
                         "bound": group.bound.to_numpy()[run][rows]}
                    )

    # Written without the vectors: a point has one row for each chunk it may reach.
    probes = materialise(
        bounded.mapInPandas(reach, "label int, vid string, cell int, chunk int, bound double"),
        "probes",
    )
    # Probes of a popular chunk are split too; its residents go to every part.
    busy = probes.groupBy("label", "cell", "chunk").agg(
        F.ceil(F.count("*") / block).cast("int").alias("parts")
    )
    part = F.pmod(F.xxhash64("vid", F.lit(1)), F.col("parts")).cast("int")
    left = (
        probes.join(busy, ["label", "cell", "chunk"])
        .withColumn("part", part)
        .join(pts.select("label", "vid", "vec"), ["label", "vid"])
    )
    right = resident.join(busy, ["label", "cell", "chunk"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    key = ["label", "cell", "chunk", "part"]
    found = (
        left.select(*key, "vid", "vec", "bound")
        .groupBy(*key)
        .cogroup(right.select(*key, "vid", "vec").groupBy(*key))
        .applyInPandas(lambda a, b: _block_neighbours(a, b, k), NEIGHBOUR)
    )
    nearest = F.row_number().over(Window.partitionBy("label", "vid").orderBy("dist", "nvid"))
    return found.withColumn("_rn", nearest).filter(F.col("_rn") <= k).drop("_rn")


def neighbour_choices(
    pts: DataFrame,
    k: int,
    wanted: DataFrame | None = None,
    most_cells: int | None = None,
    **bounds: int,
) -> DataFrame:
    """Per (wanted) point an array of (until, vec): the choice below `until` is this vector.

    The copies of a point are its nearest neighbours, and a neighbour counts as
    often as it has copies, up to k choices in all.
    """
    near = nearest_neighbours(pts, k, wanted=wanted, most_cells=most_cells, **bounds)
    other = pts.select(
        "label", F.col("vid").alias("nvid"), F.col("vec").alias("nvec"), F.col("copies")
    )
    own = pts.filter(F.col("copies") > 1).select(
        "label", "vid", F.lit(-1.0).alias("dist"), F.col("vid").alias("nvid"),
        F.col("vec").alias("nvec"), (F.col("copies") - 1).alias("copies"),
    )
    rows = near.join(other, ["label", "nvid"]).select(
        "label", "vid", "dist", "nvid", "nvec", "copies"
    )
    order = Window.partitionBy("label", "vid").orderBy("dist", "nvid")
    upto = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.unionByName(own).withColumn("until", F.least(upto, F.lit(k)))
    # At most k + 1 entries per point.
    return ranked.groupBy("label", "vid").agg(
        F.array_sort(F.collect_list(F.struct("until", "dist", "nvid", "nvec"))).alias("choices")
    )


def smote(
    df: DataFrame, columns: list[str], label: str = "label", neighbours: int = 5,
    seed: int = 42, most_cells: int | None = None, **bounds: int,
) -> DataFrame:
    """Rows (label, columns, synthetic) with every class as large as the largest.

    k is the given number or one less than the rarest class; with fewer than two
    rows in a class nothing is added. Neighbours are exact unless most_cells is given
    (see nearest_neighbours).
    """
    original = df.select(F.col(label).cast("int").alias("label"), *columns)
    sizes = {r.label: r["count"] for r in original.groupBy("label").count().collect()}
    base = original.withColumn("synthetic", F.lit(False))
    k = min(neighbours, min(sizes.values()) - 1)
    missing = {c: max(sizes.values()) - n for c, n in sizes.items() if n < max(sizes.values())}
    if k < 1 or not missing:
        return base
    thin = original.filter(F.col("label").isin(*missing))
    pts = materialise(points(thin, columns), "points")

    # Every missing row draws a row of its class, one of k neighbours and a step.
    deficit, size = F.lit(0), F.lit(0)
    for c, n in missing.items():
        deficit = F.when(F.col("label") == c, n).otherwise(deficit)
        size = F.when(F.col("label") == c, sizes[c]).otherwise(size)
    slots = (
        df.sparkSession.range(max(missing.values()))
        .withColumnRenamed("id", "n")
        .withColumn("label", F.explode(F.array(*[F.lit(c) for c in missing])))
        .filter(F.col("n") < deficit)
    )

    def u(name: str):
        return uniform(seed, F.col("label"), F.col("n"), name)

    draws = slots.select(
        "label",
        "n",
        (F.floor(u("row") * size) + 1).alias("rank"),
        F.floor(u("neighbour") * k).alias("pick"),
        u("step").alias("step"),
    )
    # The rows of a class in a fixed order: copies of one point follow each other.
    spread = pts.select("label", "vid", "vec", "copies")
    ranked = with_group_rank(
        spread.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .withColumn("row_id", F.concat_ws(":", "vid", "copy"))
        .drop("copies", "copy"),
        "label",
        "row_id",
        seed,
    )
    # Only points that were drawn need their neighbours.
    picked = materialise(
        draws.join(ranked.select("label", "rank", "vid", "vec"), ["label", "rank"]), "drawn"
    )
    choices = neighbour_choices(pts, k, wanted=picked, most_cells=most_cells, **bounds)
    drawn = picked.join(choices, ["label", "vid"])
    other = F.element_at(F.filter("choices", lambda c: c["until"] > F.col("pick")), 1)["nvec"]
    moved = drawn.select("label", "step", "vec", other.alias("other"))
    step = [
        (F.col("vec")[i] + F.col("step") * (F.col("other")[i] - F.col("vec")[i])).alias(c)
        for i, c in enumerate(columns)
    ]
    minted = moved.select("label", *step, F.lit(True).alias("synthetic"))
    return base.unionByName(minted)
