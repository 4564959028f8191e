"""SimHash near-duplicates with pivot distance tables.

Fingerprints are 64 bits. Two that differ in at most DISTANCE bits agree wholly on at least
two of six parts of the bits, so each fingerprint is filed under its 15 pairs of parts, and
only fingerprints in one file are compared. There, tables of Hamming distances to many
reference fingerprints discard a pair whose distances to any reference differ by more than
DISTANCE (triangle inequality), and the survivors are verified. A file keeps of its links a
forest only, so no group is written out as all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.llm.common import each_text, scratch
from auditlens.llm.components import components, with_least

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Bits of the six parts, as (first bit, number of bits).
PARTS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
PIVOTS = 24
#: Fingerprints of one file that are compared in one piece.
TILE = 4096


def fingerprint(text: str) -> int:
    """The bits set in over half of the shingles' hashes; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return hashed(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    hashes = np.array([hashed(joined[a:b], SEED) for a, b in spans], "<u8")
    bits = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 65536):
        part = hashes[first : first + 65536].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprinter() -> Callable:
    def signed(text: str) -> tuple:
        value = fingerprint(text)
        return (value - (1 << 64) if value >> 63 else value,)

    return lambda texts: map(signed, texts)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `simhash`: struct<bits: long> to every row (two's complement of the 64 bits).

    A column `simhash` of the input is replaced.
    """
    return docs.withColumn("simhash", each_text(_fingerprinter, "bits long")(F.col(text)))


def _part(bits: Column, first: int, size: int) -> Column:
    return F.shiftrightunsigned(bits, first).bitwiseAND((1 << size) - 1)


def filed(prints: DataFrame) -> DataFrame:
    """(file, bits): every distinct fingerprint under each pair of its parts."""
    files = []
    for n, ((a, i), (b, j)) in enumerate(combinations(PARTS, 2)):
        key = F.shiftleft(_part(F.col("bits"), a, i), j).bitwiseOR(_part(F.col("bits"), b, j))
        files.append(F.lit(n << 22).cast("bigint") + key)
    return prints.select("bits", F.explode(F.array(*files)).alias("file"))


def pieces_to_compare(filed_rows: DataFrame) -> DataFrame:
    """(file, low, high, side, bits): what is compared in one piece.

    Files of one fingerprint go. A file is cut into tiles by a hash of the fingerprint, and
    a piece is a pair of its tiles, so that no piece grows with the file.
    """
    sizes = filed_rows.groupBy("file").agg(F.count("*").alias("n")).filter("n > 1")
    tile = F.pmod(F.xxhash64("bits"), F.col("tiles"))
    other = F.col("other")
    return (
        filed_rows.join(sizes.withColumn("tiles", F.ceil(F.col("n") / TILE)), "file")
        .withColumn("tile", tile)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
        .select(
            "file",
            F.least("tile", other).alias("low"),
            F.greatest("tile", other).alias("high"),
            (F.col("tile") > other).alias("side"),
            "bits",
        )
    )


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    return np.random.default_rng(10).integers(0, 1 << 64, count, dtype=np.uint64)


def linked_in(
    bits: np.ndarray, piece: np.ndarray, side: np.ndarray, within: np.ndarray
) -> list[tuple[int, int]]:
    """Links as pairs of rows, of which the rows of a piece stand together; a forest only.

    within: whether a row's piece is one tile with itself; else only rows of different
    sides are compared. Rows are compared with the ones `step` places on, for every step;
    pairs that are joined already are left out.
    """
    table = np.bitwise_count(bits[:, None] ^ pivots()[None, :]).astype(np.int8)
    tree = np.arange(len(bits))
    found: list[tuple[int, int]] = []
    left, step = np.arange(len(bits)), 0
    while len(left):
        step += 1
        left = left[left + step < len(bits)]
        left = left[piece[left] == piece[left + step]]
        here = left[within[left] | (side[left] != side[left + step])]
        here = here[tree[here] != tree[here + step]]
        for pivot in range(PIVOTS):  # far pairs fall out after a few references
            if not len(here):
                break
            gap = np.abs(table[here, pivot] - table[here + step, pivot])
            here = here[gap <= DISTANCE]
        here = here[np.bitwise_count(bits[here] ^ bits[here + step]) <= DISTANCE]
        for i in here.tolist():
            a, b = i, i + step
            while tree[a] != a:
                a = tree[a]
            while tree[b] != b:
                b = tree[b]
            if a != b:
                tree[max(a, b)] = min(a, b)
                found.append((i, i + step))
        if len(here):
            while (tree != tree[tree]).any():
                tree = tree[tree]
    return found


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces stand together in a partition; one that a batch cuts is carried over."""
    key, rest = ["file", "low", "high"], None
    for frame in chain(frames, (None,)):
        if frame is None:
            whole = rest
        else:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            cut = (rest[key] == rest[key].iloc[-1]).all(axis=1).to_numpy()
            whole, rest = rest[~cut], rest[cut]
        if whole is None or not len(whole):
            continue
        bits = whole["bits"].to_numpy(np.int64)
        keys = whole[key].to_numpy()
        new = np.concatenate([[False], (keys[1:] != keys[:-1]).any(axis=1)])
        within = (whole["low"] == whole["high"]).to_numpy()
        side = whole["side"].to_numpy(bool)
        if found := linked_in(bits.view(np.uint64), np.cumsum(new), side, within):
            pairs = bits[np.array(found)]
            yield pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})


def links(prints: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints that join all that belong together."""
    pieces = pieces_to_compare(filed(prints.select("bits").distinct()))
    return (
        pieces.repartition("file", "low", "high")
        .sortWithinPartitions("file", "low", "high")
        .mapInPandas(_compare, "u long, v long")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, written: Callable, id_col: str = "doc_id", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, bits, *keep, component, root): every row with its fingerprint and its group.

    component is the group's smallest id. root tells groups apart, also those whose rows have
    no id, or the same one. keep names more columns of docs to hand on.

    written() stores the fingerprints, so that the texts are read once. Texts without words,
    null ones too, have fingerprint 0 and are linked like any other. Repeated rows belong
    together. Ids that are null do not count as smallest; a group of only such rows has a
    null component. An empty table gives an empty result.
    """
    scratch(docs.sparkSession)
    rows = written(
        fingerprints(docs.select(F.col(id_col).alias("id"), "text", *keep)).select(
            "id", F.col("simhash.bits").alias("bits"), *keep
        )
    )
    distinct = rows.groupBy("bits").agg(F.min("id").alias("smallest"))
    named = with_least(distinct, components(links(distinct)), "bits", "smallest")
    return rows.join(named.select("bits", "component", "root"), "bits")


def group_report(docs: DataFrame, written: Callable) -> DataFrame:
    """Per document its fingerprint in hexadecimal and its group's smallest doc_id."""
    return near_duplicates(docs, written).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
