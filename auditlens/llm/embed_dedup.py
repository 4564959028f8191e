"""Embedding near-duplicates by int8 quantised tile products.

Distinct unit vectors are dealt into tiles of bounded size and every pair of tiles is one
piece of work. In a piece the vectors are rounded to 8-bit integers; a tile product in
integers gives each cosine up to a bound made of the two vectors' quantisation errors, and
only pairs that the bound cannot rule out are computed again in double precision. A piece
returns how many links each vector has in it and a forest of them, never the pairs.

The work is quadratic in the distinct vectors: for vectors without any order in them no bound
spares a pair of tiles. It is spread over all tasks, and a piece's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.common import content_key, scratch
from auditlens.llm.components import components, with_least

THRESHOLD = 0.9
#: Vectors in a tile at most, and rows of a tile that are multiplied at a time.
TILE, STRIP = 8192, 512
#: Tiles at least, where each has this many vectors, so that few vectors are many pieces too.
LEAST_TILES, SMALL_TILE = 16, 256
#: Sums of at most this many products of int8 are whole numbers in single precision.
EXACT = 1024
#: More than the rounding errors of the double precision bounds.
SLACK = 1e-6


def quantised(unit: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Integers from -127 to 127 (as floats), their scale, and each row's error norm."""
    scale = max(float(np.abs(unit).max(initial=0.0)) / 127, 1e-300)
    whole = np.rint(unit / scale)
    return whole.astype(np.float32), scale, np.linalg.norm(unit - scale * whole, axis=1)


def candidates(
    a: tuple[np.ndarray, float, np.ndarray], b: tuple[np.ndarray, float, np.ndarray], least: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose cosine may reach `least`.

    With u = su + e and v = tw + f, |uv - su*tw| <= |e| |v| + |su| |f| <= |e| + (1 + |e|) |f|.
    """
    (p, s, e), (q, t, f) = a, b
    product = np.zeros((len(p), len(q)), np.float32)
    for first in range(0, p.shape[1], EXACT):
        product += p[:, first : first + EXACT] @ q[:, first : first + EXACT].T
    rounding = SLACK if p.shape[1] <= EXACT else SLACK + 1e-6 * (p.shape[1] / EXACT)
    bound = least - rounding - e - (1 + e) * f.max(initial=0.0)
    floor = bound / (s * t)
    floor = (floor - 1e-6 * np.abs(floor)).astype(np.float32)
    rows, columns = np.nonzero(product >= floor[:, None])
    close = s * t * product[rows, columns] + e[rows] + (1 + e[rows]) * f[columns]
    keep = close >= least - rounding
    return rows[keep], columns[keep]


def _piece(key: tuple, frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links inside one pair of tiles: (u, v, n), n links of u's where v is null.

    key is (dims, low, high). Of two different tiles one may hold no vector of this dimension.
    """
    raw = np.array(frame["v"].tolist(), np.float64)
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    ids, copies = frame["id"].to_numpy(np.int64), frame["copies"].to_numpy(np.int64)
    second = frame["side"].to_numpy(bool)
    alone = key[1] == key[2]
    first, other = np.flatnonzero(~second), np.flatnonzero(~second if alone else second)
    whole, scale, error = quantised(unit)
    count, tree, forest = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
    for start in range(0, len(first), STRIP):
        strip = first[start : start + STRIP]
        rows, columns = candidates(
            (whole[strip], scale, error[strip]), (whole[other], scale, error[other]), least
        )
        i, j = strip[rows], other[columns]
        if alone:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 1 << 18):
            x, y = i[part : part + (1 << 18)], j[part : part + (1 << 18)]
            exact = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
            x, y = x[exact], y[exact]
            np.add.at(count, x, copies[y])
            np.add.at(count, y, copies[x])
            # A forest of the links: the smaller tree wins until nothing is left to join.
            while len(x):
                apart = tree[x] != tree[y]
                x, y = x[apart], y[apart]
                if not len(x):
                    break
                low, high = np.minimum(tree[x], tree[y]), np.maximum(tree[x], tree[y])
                chosen = np.unique(high, return_index=True)[1]
                forest += zip(x[chosen].tolist(), y[chosen].tolist(), strict=True)
                tree[high[chosen]] = low[chosen]
                while (tree != tree[tree]).any():
                    tree = tree[tree]
    linked = np.flatnonzero(count)
    pairs = np.array(forest, np.int64).reshape(-1, 2)
    return pd.DataFrame(
        {
            "u": np.concatenate([ids[linked], ids[pairs[:, 0]]]),
            "v": pd.array([None] * len(linked) + ids[pairs[:, 1]].tolist(), dtype="Int64"),
            "n": np.concatenate([count[linked], np.zeros(len(pairs), np.int64)]),
        }
    )


def tiles(distinct: DataFrame, size: int = TILE) -> DataFrame:
    """(low, high, side, ...): every vector once for each pair of tiles it is in.

    A tile holds vectors of one dimension, dealt by a hash of their id.
    """
    n = distinct.count()
    many = max(1, -(-n // size), min(LEAST_TILES, -(-n // SMALL_TILE)))
    dealt = distinct.withColumn("tile", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(many)))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(many - 1).cast("bigint"))
    return dealt.withColumn("other", F.explode(every)).select(
        "dims",
        F.least("tile", "other").alias("low"),
        F.greatest("tile", "other").alias("high"),
        (F.col("tile") > F.col("other")).alias("side"),
        "id",
        "copies",
        "v",
    )


def near_duplicates(
    vectors: DataFrame,
    written: Callable,
    id_col: str = "vec_id",
    vector: str = "embedding",
    least: float = THRESHOLD,
) -> DataFrame:
    """(id, n_links, component) of every row.

    Rows link at a cosine of at least `least` in double precision; equal vectors do. Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing, and
    neither do vectors of different dimensions. Equal vectors are compared as one, with the
    number of copies. The component is the smallest id reachable, the own one included; null
    ids never count as smallest. Repeated rows count as separate vectors.
    """
    scratch(vectors.sparkSession)
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    key = F.when(usable, F.struct(*content_key(v)))
    rows = vectors.select(F.col(id_col).alias("id"), key.alias("key"), v.alias("v"))
    classes = written(
        rows.filter("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("id").alias("smallest"), F.count("*").alias("copies"), F.first("v").alias("v"))
        .withColumn("id", F.monotonically_increasing_id())
        .withColumn("dims", F.size("v"))
    )
    found = written(
        tiles(classes.select("id", "copies", "v", "dims"))
        .groupBy("dims", "low", "high")
        .applyInPandas(lambda key, frame: _piece(key, frame, least), "u long, v long, n long")
    )
    links = found.groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("v IS NOT NULL").select("u", "v"))
    named = (
        with_least(classes.select("id", "key", "smallest", "copies"), roots, "id", "smallest")
        .join(links, "id", "left")
        .select("key", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    )
    alone = F.col("key").isNull()
    return rows.select("id", "key").join(named, "key", "left").select(
        "id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"),
    )


def link_report(vectors: DataFrame, written: Callable) -> DataFrame:
    """Per vector its number of links, its component, and whether it stands for it."""
    return near_duplicates(vectors, written).select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE u AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
r(id, reached) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id,
  e.vec_id = component_id AS kept
FROM embeddings AS e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
