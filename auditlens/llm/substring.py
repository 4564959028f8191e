"""Removal of repeated word passages with a count-min prefilter.

A window is 35 words in a row. Each window is represented by one of its 8-word grams, the
one with the smallest hash (the leftmost, where several are), so equal windows have equal
representatives, and neighbouring windows mostly share theirs. A first pass counts the
representatives in count-min sketches, one a partition, that are merged; the merged sketch
overestimates how often a window occurs and never misses one that repeats. A second pass
takes the windows estimated to repeat and groups them exactly: first as stretches (the
windows of one representative, which are equal wherever the stretch is), and the windows of
the stretches that stand alone then one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.common import content_key, in_parts

WINDOW, GRAM = 35, 8
GRAMS = WINDOW - GRAM + 1
#: The sketch: rows, and cells a row as a power of two; a cell counts to 2 in two bits.
#: 2 * 2**26 cells of two bits are 32 MB, whatever the input is.
DEPTH, CELL_BITS = 2, 26
#: A segment of the sketch is what one row of a merge holds.
SEGMENT_BITS = 20
#: Words that are worked on at a time.
BATCH = 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses modulo 2**64


def words_of(text: str) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ in UTF-8: bytes are split at just these characters."""
    return text.encode("utf-8", "surrogatepass").split()


class WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = value
        return value


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of words as polynomials modulo 2**64."""

    def __init__(self, hashes: np.ndarray, base: int):
        inverse = pow(base, -1, 1 << 64)
        self.lift = _powers(base, len(hashes) + 1)
        down = _powers(inverse, len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * down[:-1], out=self.sums[1:])

    def __call__(self, first: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[first + length] - self.sums[first]) * self.lift[first])


def _leftmost_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of `width` values from each place on; the first of equals."""
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        take = best[step:] < best[:-step]
        best = np.where(take, best[step:], best[:-step])
        at = np.where(take, at[step:], at[:-step])
        span += step
    return at


class Stretches:
    """The stretches of windows with one representative, in a batch of texts."""

    def __init__(self, texts: list[list[bytes]], known: WordHashes):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        words = [w for t in texts for w in t]
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.rolling = Rolling(hashes, BASES[0])
        self.second = Rolling(mixed(hashes), BASES[1])
        self.owner = np.zeros(0, np.int64)
        self.first = self.count = self.owner
        self.gram = np.zeros(0, np.uint64)
        if len(words) < WINDOW:
            return
        grams = self.rolling(np.arange(len(words) - GRAM + 1), GRAM)
        at = _leftmost_smallest(grams, GRAMS)
        place = np.arange(len(at))
        owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
        fits = place + WINDOW <= self.starts[owner + 1]
        place, at, owner = place[fits], at[fits], owner[fits]
        if not len(place):
            return
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
        begin = np.flatnonzero(new)
        self.owner, self.first = owner[begin], place[begin]
        self.count = np.diff(np.concatenate([begin, [len(place)]]))
        self.gram = grams[at[begin]]

    def key(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of a stretch's words and length."""
        length = self.count[which] + WINDOW - 1
        salt = mixed(length.astype(np.uint64))
        first = self.first[which]
        return self.rolling(first, length) ^ salt, self.second(first, length) ^ salt

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """128 bits of each window, one stretch after the other, and where each ends."""
        count = self.count[which]
        ends = np.cumsum(count)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
        first = np.repeat(self.first[which], count) + within
        return self.rolling(first, WINDOW), self.second(first, WINDOW), ends


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list]]:
    """Rows with their words, about BATCH words at a time."""
    for frame in frames:
        start, size, held = 0, 0, []
        for n, text in enumerate(frame["text"]):
            held.append(words_of(text or ""))
            size += len(held[-1])
            if size >= BATCH or n + 1 == len(frame):
                yield frame.iloc[start : n + 1], held
                start, size, held = n + 1, 0, []


def _cells(grams: np.ndarray) -> Iterator[np.ndarray]:
    """The cell of each gram in each row of the sketch, counted through all rows."""
    for row in range(DEPTH):
        yield (mixed(grams + np.uint64(row + 1)) >> np.uint64(64 - CELL_BITS)).astype(
            np.int64
        ) + (row << CELL_BITS)


def _partition_sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a partition counts: by segment, the cells met once and those met more often."""
    known, size = WordHashes(), DEPTH << CELL_BITS
    once, twice = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
    for _, texts in _batches(frames):
        grams = Stretches(texts, known).gram
        for cells in _cells(grams):
            cells, times = np.unique(cells, return_counts=True)
            byte, bit = cells >> 3, (1 << (cells & 7)).astype(np.uint8)
            again = (times > 1) | (once[byte] & bit > 0)
            np.bitwise_or.at(once, byte, bit)
            np.bitwise_or.at(twice, byte[again], bit[again])
    width = 1 << SEGMENT_BITS - 3
    for segment in range(size >> SEGMENT_BITS):
        part = slice(segment * width, (segment + 1) * width)
        if once[part].any():
            yield pd.DataFrame(
                {"segment": [segment], "once": [_packed(once[part])], "twice": [_packed(twice[part])]}
            )


def _packed(bits: np.ndarray) -> bytes:
    """A bitmap, or its set bits where they take less."""
    places = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    sparse = b"s" + places.astype("<u4").tobytes()
    return sparse if len(sparse) < len(bits) else b"d" + bits.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"d":
        return np.frombuffer(data, np.uint8, offset=1)
    bits = np.zeros(1 << SEGMENT_BITS, np.uint8)
    bits[np.frombuffer(data, "<u4", offset=1)] = 1
    return np.packbits(bits, bitorder="little")


def _merged_segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up the partitions' segments, of which those of a partition stand together."""
    for frame in frames:
        for segment, rows in frame.groupby("segment"):
            once = np.zeros(1 << SEGMENT_BITS - 3, np.uint8)
            twice = once.copy()
            for a, b in zip(rows["once"], rows["twice"], strict=True):
                one = _unpacked(a)
                twice |= _unpacked(b) | (once & one)
                once |= one
            yield pd.DataFrame(
                {"segment": [segment], "once": [_packed(once)], "twice": [_packed(twice)]}
            )


def sketch(docs: DataFrame) -> np.ndarray:
    """The merged sketch's bitmap of cells that were counted more than once.

    Its size is fixed. Partial sketches are merged as long as several are left of a segment,
    so that a task merges what it holds at a time, and only the merged one is collected.
    """
    schema = "segment int, once binary, twice binary"
    partial = docs.select("text").mapInPandas(_partition_sketch, schema)
    merged = (
        partial.repartition("segment")
        .mapInPandas(_merged_segments, schema)
        .groupBy("segment")
        .applyInPandas(lambda rows: next(_merged_segments(iter([rows]))), schema)
        .select("segment", "twice")
    )
    width = 1 << SEGMENT_BITS - 3
    out = np.zeros((DEPTH << CELL_BITS) // 8, np.uint8)
    for row in merged.toLocalIterator():
        out[row["segment"] * width : (row["segment"] + 1) * width] = _unpacked(row["twice"])
    return out


OCCURRENCES = "k1 long, k2 long, first int, count int, s1 long, s2 long, w1 array<long>, w2 array<int>"
#: Stretches whose windows a task remembers to have written.
SEEN = 1_000_000


def _occurrences(repeated: np.ndarray) -> Callable:
    """Stretches estimated to repeat: where they are, their key, and their windows' hashes.

    The windows are written once a task and stretch, as far as it remembers.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = WordHashes(), set()
        for frame, texts in _batches(frames):
            found = Stretches(texts, known)
            maybe = np.ones(len(found.gram), bool)
            for cells in _cells(found.gram):
                maybe &= repeated[cells >> 3] >> (cells & 7).astype(np.uint8) & 1 > 0
            which = np.flatnonzero(maybe)
            if not len(which):
                continue
            s1, s2 = (x.view(np.int64) for x in found.key(which))
            w1: list = [None] * len(which)
            w2: list = [None] * len(which)
            unseen = [n for n, s in enumerate(s1.tolist()) if not (s in seen or seen.add(s))]
            if len(seen) > SEEN:
                seen.clear()
            one, two, ends = found.windows(which[unseen])
            one, two = one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)
            for n, a, b in zip(unseen, np.concatenate([[0], ends[:-1]]), ends, strict=False):
                w1[n], w2[n] = one[a:b], two[a:b]
            owner = found.owner[which]
            yield pd.DataFrame(
                {
                    "k1": frame["_k1"].to_numpy()[owner],
                    "k2": frame["_k2"].to_numpy()[owner],
                    "first": (found.first[which] - found.starts[owner]).astype(np.int32),
                    "count": found.count[which].astype(np.int32),
                    "s1": s1,
                    "s2": s2,
                    "w1": w1,
                    "w2": w2,
                }
            )

    return run


def repeated_windows(occurrences: DataFrame) -> DataFrame:
    """(s1, s2, mask): which windows of a stretch, from the first on, occur elsewhere too.

    All of them where the stretch does (mask -1). Else a window does if it is in a stretch
    that does, or in two places of stretches that do not.
    """
    stretches = occurrences.groupBy("s1", "s2").agg(
        F.count("*").alias("n"),
        F.first("w1", ignorenulls=True).alias("w1"),
        F.first("w2", ignorenulls=True).alias("w2"),
    )
    places = stretches.select(
        "s1", "s2", "n", F.posexplode(F.arrays_zip("w1", "w2")).alias("place", "w")
    ).select("s1", "s2", "n", "place", "w.w1", "w.w2")
    again = places.groupBy("w1", "w2").agg(F.sum("n").alias("n")).filter("n > 1").drop("n")
    bit = F.expr("shiftleft(1L, place)")
    partly = (
        places.filter("n = 1")
        .join(again, ["w1", "w2"])
        .groupBy("s1", "s2")
        .agg(F.bit_or(bit).alias("mask"))
    )
    whole = stretches.filter("n > 1").select("s1", "s2", F.lit(-1).cast("bigint").alias("mask"))
    return partly.unionByName(whole)


def covers(occurrences: DataFrame, masks: DataFrame) -> DataFrame:
    """(_k1, _k2, covers): by text the windows to remove, as first * 2**28 + mask."""
    own = F.expr("mask & (shiftleft(1L, count) - 1)")
    return (
        occurrences.select("k1", "k2", "first", "count", "s1", "s2")
        .join(masks, ["s1", "s2"])
        .groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
        .agg(
            F.collect_set(
                F.shiftleft(F.col("first").cast("bigint"), GRAMS).bitwiseOR(own)
            ).alias("covers")
        )
    )


def covered(n_words: int, covers: np.ndarray) -> np.ndarray:
    """Which words the windows cover."""
    steps = np.zeros(n_words + WINDOW + 1, np.int64)
    for place in range(GRAMS):
        first = (covers[covers >> place & 1 > 0] >> GRAMS) + place
        np.add.at(steps, first, 1)
        np.add.at(steps, first + WINDOW, -1)
    return np.cumsum(steps)[:n_words] > 0


def _cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    columns = ["text", "n_words", "n_removed"]
    for texts, cuts in batches:
        places = iter(cuts)
        for part in in_parts(texts):
            out = []
            for text, cut in zip(part, places, strict=False):
                words, removed = words_of(text), 0
                kept = words
                if cut is not None and len(cut):
                    gone = covered(len(words), np.asarray(cut, np.int64))
                    removed = int(gone.sum())
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((b" ".join(kept).decode("utf-8", "surrogatepass"), len(words), removed))
            yield pd.DataFrame(out, columns=columns)


def without_repeats(docs: DataFrame, written: Callable, text: str = "text") -> DataFrame:
    """Adds `kept`: struct<text, n_words, n_removed> to every row, and keeps the rest.

    A word goes if a window that covers it has a sequence of words that also starts anywhere
    else, in another row or the same. All copies of a passage go. The kept words are joined
    by one space. Null and empty texts have no words; texts of fewer than 35 words lose none;
    repeated rows repeat each other's windows. written() stores what it is given in the
    shared folder. Columns `kept`, `_k1` and `_k2` of the input are replaced or dropped.
    """
    spark = docs.sparkSession
    keyed = docs.drop("kept", "_k1", "_k2").select(
        "*", *content_key(F.coalesce(F.col(text), F.lit("")))
    )
    texts = keyed.select("_k1", "_k2", F.col(text).alias("text"))
    repeated = spark.sparkContext.broadcast(sketch(texts))
    cut = F.pandas_udf("text string, n_words long, n_removed long")(_cut).asNondeterministic()

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _occurrences(repeated.value)(frames)

    occurrences = written(texts.mapInPandas(emit, OCCURRENCES))
    cuts = written(covers(occurrences, written(repeated_windows(occurrences))))
    return (
        keyed.join(cuts, ["_k1", "_k2"], "left")
        .withColumn("kept", cut(F.col(text), F.col("covers")))
        .drop("_k1", "_k2", "covers")
    )


def repeat_report(docs: DataFrame, written: Callable) -> DataFrame:
    """Per document its words, the removed ones, and the kept text's SHA-256."""
    return without_repeats(docs.select("doc_id", "text"), written).select(
        "doc_id",
        F.col("kept.n_words").alias("n_words"),
        F.col("kept.n_removed").alias("n_removed"),
        F.sha2(F.col("kept.text").cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i
  FROM (SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM r))),
k AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM g GROUP BY doc_id),
p AS (
  SELECT d.doc_id, unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS i FROM d),
t AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept
  FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i WHERE g.i IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""
