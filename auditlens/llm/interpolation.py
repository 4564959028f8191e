"""Deleted interpolation: an n-gram model whose orders are mixed by EM on held-out counts.

The probability of a token is mixed order by order, from an even one up:

    P0(w) = 1 / (V + 1)
    Pk(w | h) = l * c(h w) / c(h) + (1 - l) * Pk-1(w | shorter h),  l = weight[k, bucket of c(h)]

Buckets are powers of two of how often the context was seen. A part of the training
documents is deleted from the counts; the weights are learned by expectation-maximisation on
what the remaining counts give the deleted tokens, and are then used with all counts.

Texts are gathered into blocks of some million tokens, and everything that travels is counted
once a block: a block sends the distinct n-grams of each order as sorted 64-bit hashes, dealt
by hash (so an n-gram of any frequency is at most one entry a block and no hot key), and
gets totals back for those that other blocks hold as well. What is a number of distinct words
or n-grams is never collected or broadcast.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 2
#: One training document in so many is deleted from the counts that the weights are fitted on.
DELETED = 16
ROUNDS = 12
#: Buckets of context counts: 0, 1, 2-3, 4-7, ...
BUCKETS = 64
#: Tokens of a block, and n-grams that one merging task is meant to hold.
BLOCK, MERGED = 1_000_000, 1_000_000
#: Words of a text that are looked up at a time.
SLICE = 200_000
STARTED = 0.5

START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
STEP = np.uint64(0xD6E8FEB86659FD93)


# --- words and n-grams --------------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * STEP
    x = (x ^ (x >> np.uint64(32))) * STEP
    return x ^ (x >> np.uint64(32))


def grams(tokens: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1-, 2-, ... order-grams that end at each token of texts laid end to end.

    tokens: hashes; starts: where texts begin. Before a text lies one start mark.
    """
    found = [tokens]
    place = np.arange(len(tokens)) - np.repeat(
        starts, np.diff(np.append(starts, len(tokens)))
    )
    for k in range(2, order + 1):
        before = np.empty_like(tokens)
        before[1:] = found[-1][:-1]
        before[place == 0] = START
        key = mixed(mixed(before + np.uint64(k)) + tokens)
        found.append(np.where(place + 2 >= k, key, found[-1]))  # shorter history, shorter gram
    return found


def bucket(counts: np.ndarray) -> np.ndarray:
    """The length of counts in binary digits; 0 for 0."""
    return np.frexp(np.asarray(counts, np.float64))[1]


# --- blocks -------------------------------------------------------------------------------

BLOCK_DDL = (
    "block long, deleted boolean, ids array<string>, lengths binary, trained binary, "
    "words binary, tokens binary, n long, train_tokens long, train_docs long"
)
BLOCK_SCHEMA = pa.schema(
    [("block", pa.int64()), ("deleted", pa.bool_()), ("ids", pa.list_(pa.string()))]
    + [(c, pa.binary()) for c in ("lengths", "trained", "words", "tokens")]
    + [(c, pa.int64()) for c in ("n", "train_tokens", "train_docs")]
)


class Gathered:
    """Texts of one kind on their way to a block."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.trained = [], [], []
        self.at: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []
        self.n = 0

    def add(self, id_: str | None, words: list[bytes], trained: bool) -> None:
        at = self.at
        for i in range(0, len(words), SLICE):
            part = words[i : i + SLICE]
            try:
                ids = [at[w] for w in part]
            except KeyError:
                ids = [at.setdefault(w, len(at)) for w in part]
            self.tokens.append(np.array(ids, "<u4"))
        self.ids.append(id_)
        self.lengths.append(len(words))
        self.trained.append(trained)
        self.n += len(words) + 1

    def block(self, number: int, deleted: bool) -> pa.RecordBatch:
        lengths, trained = np.array(self.lengths, "<i8"), np.array(self.trained, bool)
        tokens = np.concatenate([*self.tokens, np.empty(0, "<u4")])
        words = np.fromiter(map(_hash, self.at), "<u8", len(self.at))
        # frequent words get small numbers, which pack better
        often = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), "<u4")
        rank[often] = np.arange(len(words), dtype="<u4")
        row = {
            "block": number,
            "deleted": deleted,
            "ids": self.ids,
            "lengths": lengths.tobytes(),
            "trained": trained.tobytes(),
            "words": words[often].tobytes(),
            "tokens": packed(rank[tokens]),
            "n": self.n,
            "train_tokens": int((lengths + 1)[trained].sum()),
            "train_docs": int(trained.sum()),
        }
        return pa.RecordBatch.from_pylist([row], BLOCK_SCHEMA)


def packed(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers compressed by byte planes: the low bytes of all, then the next ones, ...

    High bytes of small numbers, and of sorted ones, hardly change and pack to little.
    """
    size = np.dtype(kind).itemsize
    split = np.ascontiguousarray(numbers.astype(kind).view(np.uint8).reshape(-1, size).T)
    return zstandard.ZstdCompressor(level=1).compress(split.tobytes())


def unpacked(raw: bytes, kind: str = "<u4") -> np.ndarray:
    split = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    together = np.ascontiguousarray(split.reshape(size, len(split) // size).T)
    return together.reshape(-1).view(kind)


def _blocks(size: int) -> Callable:
    """(id, text, trained, deleted, task) rows to blocks; deleted texts have their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, number = {False: Gathered(), True: Gathered()}, None
        for batch in batches:
            for id_, text, trained, deleted, task in zip(*batch.columns, strict=True):
                kind, number = deleted.as_py(), number or task.as_py() << 33
                kinds[kind].add(id_.as_py(), words_of(text.as_py()), trained.as_py())
                if kinds[kind].n >= size:
                    yield kinds[kind].block(number, kind)
                    kinds[kind], number = Gathered(), number + 1
        for kind, held in kinds.items():
            if held.ids:
                yield held.block(number, kind)
                number += 1

    return run


class Block:
    """A block's tokens and their n-grams, rebuilt from its row."""

    def __init__(self, row: dict, order: int):
        self.ids = list(row["ids"])
        self.lengths = np.frombuffer(row["lengths"], "<i8") + 1
        self.trained = np.frombuffer(row["trained"], bool)
        self.deleted = row["deleted"]
        self.starts = np.cumsum(self.lengths) - self.lengths
        tokens = np.full(self.lengths.sum(), END, np.uint64)
        inside = np.ones(len(tokens), bool)
        inside[self.starts + self.lengths - 1] = False
        tokens[inside] = np.frombuffer(row["words"], "<u8")[unpacked(row["tokens"])]
        self.grams = grams(tokens, self.starts, order)
        self.counted = np.repeat(self.trained, self.lengths)

    def distinct(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k-grams in order of hash, each one's training count, and every token's place."""
        keys, places = np.unique(self.grams[k - 1], return_inverse=True)
        return keys, np.bincount(places[self.counted], minlength=len(keys)), places


# --- totals of n-grams --------------------------------------------------------------------

SENT_DDL = "part long, block long, k int, deleted boolean, keys binary, counts binary"
SENT_SCHEMA = pa.schema(
    [("part", pa.int64()), ("block", pa.int64()), ("k", pa.int32()), ("deleted", pa.bool_())]
    + [("keys", pa.binary()), ("counts", pa.binary())]
)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of the parts keys belong to, by their high bits; ascending as keys are."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _send(order: int, parts: int) -> Callable:
    """A block's distinct n-grams with their counts, cut by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, order)
                for k in range(1, order + 1):
                    keys, counts, _ = block.distinct(k)
                    cuts = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
                    counts = counts.astype("<u4")
                    sent = [
                        {
                            "part": (k - 1) * parts + i,
                            "block": row["block"],
                            "k": k,
                            "deleted": row["deleted"],
                            "keys": packed(keys[a:b], "<u8"),
                            "counts": packed(counts[a:b]),
                        }
                        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
                        if a < b
                    ]
                    yield pa.RecordBatch.from_pylist(sent, SENT_SCHEMA)

    return run


TOTAL_DDL = (
    "block long, deleted boolean, k int, part long, places binary, kept binary, gone binary, "
    "distinct long"
)
TOTAL_COLUMNS = ["block", "deleted", "k", "part", "places", "kept", "gone", "distinct"]


def _total(sent: pd.DataFrame) -> pd.DataFrame:
    """Totals over all blocks, for each block where they are not its own counts.

    One row without a block says how many n-grams of the part were trained on.
    """
    keys = [unpacked(k, "<u8") for k in sent["keys"]]
    counts = [unpacked(c).astype(np.int64) for c in sent["counts"]]
    if len(keys) == 1:
        known, places = keys[0], np.arange(len(keys[0]))
    else:
        known, places = np.unique(np.concatenate(keys), return_inverse=True)
    sizes = np.array([len(k) for k in keys])
    own = np.concatenate(counts)
    of_deleted = np.repeat(sent["deleted"].to_numpy(bool), sizes)
    kept, gone = (
        np.bincount(places, np.where(mask, own, 0), len(known)).astype(np.int64)
        for mask in (~of_deleted, of_deleted)
    )
    k, part = int(sent["k"].iloc[0]), int(sent["part"].iloc[0])
    trained = int(((kept + gone) > 0).sum())
    rows = [(None, None, k, part, None, None, None, trained)]
    at = 0
    for block, deleted, n in zip(sent["block"], sent["deleted"], sizes, strict=True):
        mine = places[at : at + n]
        differs = np.flatnonzero(kept[mine] + gone[mine] != own[at : at + n])
        where = mine[differs]
        step = packed(np.diff(differs, prepend=0))
        totals = (packed(total[where], "<u8") for total in (kept, gone))
        rows.append((block, deleted, k, part, step, *totals, n))
        at += n
    return pd.DataFrame(rows, columns=TOTAL_COLUMNS).astype(
        {"block": "Int64", "deleted": "boolean", "distinct": "Int64"}
    )


def counts_of(
    block: Block, answers: pd.DataFrame, order: int, without_deleted: bool = False
) -> list[np.ndarray]:
    """The count of the 1-, 2-, ... gram at every token, over all blocks.

    What the totals that came back do not name is only in this block.
    """
    found = []
    by_k = dict(list(answers.groupby("k")))
    for k in range(1, order + 1):
        _, counts, places = block.distinct(k)
        block.grams[k - 1] = None  # not needed any more
        if block.deleted and without_deleted:
            counts = np.zeros_like(counts)
        at = 0
        for part in by_k[k].sort_values("part").itertuples():
            where = at + np.cumsum(unpacked(part.places), dtype=np.int64)
            total = unpacked(part.kept, "<u8")
            counts[where] = total if without_deleted else total + unpacked(part.gone, "<u8")
            at += int(part.distinct)
        found.append(counts[places])
    return found


def _contexts(block: Block, counts: list[np.ndarray], tokens: int, docs: int) -> list[np.ndarray]:
    """How often the context of order 1, 2, ... was seen: all tokens, starts, shorter grams."""
    found = [np.full(len(counts[0]), tokens, np.int64)]
    for shorter in counts[:-1]:
        before = np.empty_like(shorter)
        before[1:] = shorter[:-1]
        before[block.starts] = docs
        found.append(before)
    return found


# --- weights ------------------------------------------------------------------------------


def mixtures(
    weights: np.ndarray, seen: list[np.ndarray], contexts: list[np.ndarray], even: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From order 1 up: what the order itself adds to a token's probability, and the mixture."""
    p = even
    for of_bucket, count, context in zip(weights, seen, contexts, strict=True):
        w = np.where(context > 0, of_bucket[bucket(context)], 0.0)
        own = w * (count / np.maximum(context, 1))
        p = own + (1 - w) * p
        yield own, p


def _expected(order: int, weights: list[list[float]], even: float) -> Callable:
    """For each order and bucket, how many tokens came down to it and how many stopped there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        came, stopped = np.zeros((2, order, BUCKETS + 1))
        for batch in batches:
            columns = [
                [batch[f"{x}{k}"].to_numpy(np.int64) for k in range(1, order + 1)] for x in "cn"
            ]
            steps = list(mixtures(np.array(weights), *columns, even))
            reach = batch["times"].to_numpy(np.float64)
            for k in reversed(range(order)):
                own, p = steps[k]
                stop, at = reach * own / p, bucket(columns[1][k])
                came[k] += np.bincount(at, reach, BUCKETS + 1)
                stopped[k] += np.bincount(at, stop, BUCKETS + 1)
                reach = reach - stop
        k, b = np.nonzero(came)
        yield pd.DataFrame({"k": k, "bucket": b, "came": came[k, b], "stopped": stopped[k, b]})

    return run


def fitted(events: DataFrame, order: int, even: float, rounds: int = ROUNDS) -> list[list[float]]:
    """weights[k][bucket] by expectation-maximisation; events: c1.., n1.., times.

    A round is one aggregation of the collapsed events, to at most a row an order and bucket.
    Buckets without events keep the weight they started with.
    """
    weights = [[STARTED] * (BUCKETS + 1) for _ in range(order)]
    for _ in range(rounds):
        sums = (
            events.mapInPandas(
                _expected(order, weights, even), "k int, bucket int, came double, stopped double"
            )
            .groupBy("k", "bucket")
            .agg(F.sum("came").alias("came"), F.sum("stopped").alias("stopped"))
            .filter("bucket > 0 AND came > 0")
        )
        for row in sums.collect():
            weights[row.k][row.bucket] = row.stopped / row.came
    return weights


def _events(order: int, tokens: int, docs: int) -> Callable:
    """Collapsed counts of a deleted block's tokens: (counts, contexts) and how many tokens."""

    def run(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = [f"{x}{k}" for x in "cn" for k in range(1, order + 1)]
        if blocks.empty:
            return pd.DataFrame(columns=[*names, "times"])
        block = Block(blocks.iloc[0].to_dict(), order)
        counts = counts_of(block, answers, order, without_deleted=True)
        found = pd.DataFrame(
            dict(zip(names, counts + _contexts(block, counts, tokens, docs), strict=True))
        )
        found = found[block.counted]
        return found.groupby(names, as_index=False).size().rename(columns={"size": "times"})

    return run


# --- scores -------------------------------------------------------------------------------

SCORE_DDL = (
    "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
)
SCORES = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]


def _scores(order: int, weights: list, tokens: int, docs: int, distinct: int) -> Callable:
    weights = np.array(weights)

    def run(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty:
            return pd.DataFrame(columns=SCORES)
        block = Block(blocks.iloc[0].to_dict(), order)
        counts = counts_of(block, answers, order)
        contexts = _contexts(block, counts, tokens, docs)
        for _, p in mixtures(weights, counts, contexts, 1 / (distinct + 1)):
            pass  # the last one is of the highest order
        add = lambda x: np.add.reduceat(x, block.starts)
        base = np.log10(counts[0] + 1) - math.log10(tokens + distinct + 1)
        return pd.DataFrame(
            dict(
                zip(
                    SCORES,
                    (
                        block.ids,
                        ~block.trained,
                        block.lengths,
                        add((counts[0] > 0).astype(np.int64)),
                        add(base),
                        add(np.log10(p)),
                    ),
                    strict=True,
                )
            )
        )

    return run


def _remainder(key: str, modulus: int, salt: str = "") -> Column:
    name = F.col(key).cast("string")
    return F.pmod(F.crc32(F.concat(name, F.lit(salt)) if salt else name), F.lit(modulus))


def _blocks_with(answers: DataFrame, blocks: DataFrame, work: Callable, ddl: str) -> DataFrame:
    return (
        blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(work, ddl)
    )


def score_report(
    docs: DataFrame,
    written: Callable[[DataFrame], DataFrame],
    order: int = ORDER,
    block: int = BLOCK,
    merged: int = MERGED,
    deleted: int = DELETED,
    key: str = "doc_id",
) -> DataFrame:
    """Every document's log10 probability under the model, and under add-one unigrams.

    Learned from the documents whose crc32 of the id, modulo 7, is not 2 (a null id's is not).
    Null and empty texts are one end token. Rows are independent of ids: repeated rows are
    counted and scored as often as they are there. An empty table gives an empty one; where
    nothing is learned, all tokens are equally likely. Words and n-grams are told apart by
    64-bit hashes. Texts of any length are taken whole; a text is never split over blocks, and
    a block is at least one text. Other columns of docs are ignored, whatever their names.
    """
    held = F.coalesce(_remainder(key, 7) == 2, F.lit(False))
    gone = F.coalesce(_remainder(key, deleted, " deleted") == 0, F.lit(False)) & ~held
    texts = docs.select(
        F.col(key).cast("string"), "text", ~held, gone.alias("deleted"), F.spark_partition_id()
    )
    blocks = written(texts.mapInArrow(_blocks(block), BLOCK_DDL))
    sums = blocks.groupBy("deleted").agg(
        F.sum("n").alias("n"), F.sum("train_tokens").alias("tokens"), F.sum("train_docs").alias("docs")
    )
    sums = {r.deleted: r for r in sums.collect()}
    every = lambda c: sum(r[c] for r in sums.values())
    parts = max(1, -(-every("n") // merged)) if sums else 1
    answers = written(
        blocks.mapInArrow(_send(order, parts), SENT_DDL)
        .groupBy("part")
        .applyInPandas(_total, TOTAL_DDL)
    )
    distinct = answers.filter("block IS NULL AND k = 1").agg(F.sum("distinct")).first()[0] or 0
    answers = answers.filter("block IS NOT NULL")
    names = [f"{x}{k}" for x in "cn" for k in range(1, order + 1)]
    kept = sums.get(False)
    events = written(
        _blocks_with(
            answers.filter("deleted"),
            blocks.filter("deleted"),
            _events(order, kept.tokens if kept else 0, kept.docs if kept else 0),
            ", ".join(f"{c} long" for c in [*names, "times"]),
        )
        .groupBy(*names)
        .agg(F.sum("times").alias("times"))
    )
    weights = fitted(events, order, 1 / (distinct + 1))
    tokens = every("tokens")
    scores = _blocks_with(
        answers, blocks, _scores(order, weights, tokens, every("docs"), distinct), SCORE_DDL
    )
    return scores.select(
        F.col("id").cast(docs.schema[key].dataType).alias("doc_id"),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
