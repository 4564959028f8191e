"""Alignment of two tokenizers' tokens by an associative monoid of fragments.

Both tokenizers cut the bytes of " " + text. Where a token of A and one of B end at the same
byte, a group ends and the two tokens are linked. A byte range of a text, seen alone, knows
neither where its first group began nor where its last one will end: its fragment is an
open prefix (up to the first common end), closed groups, and an open suffix. Fragments are
composed associatively, so ranges of a very long text are worked on by different tasks and
reduced as a tree.

Ranges end where both tokenizers start afresh: before a space after a character that is no
white space, or after a line feed. Texts of one range are worked on many at a time by array
operations on the places where tokens end.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Characters of a text that are one range; a range ends at the next border of a chunk.
RANGE = 1 << 16
#: Fragments that one step of the tree composes.
FAN = 8
#: Characters of texts that are worked on, and handed back, together.
TOGETHER = 1_000_000
#: The pattern that splits a text before the merges of a byte-level vocabulary.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


# --- the monoid ---------------------------------------------------------------------------


class Fragment(NamedTuple):
    """A byte range's groups. `cut`: whether any common end is in it; if not, all is prefix."""

    cut: bool
    prefix: tuple[list[int], list[int]]
    closed: str
    links: dict[tuple[int, int], int]
    suffix: tuple[list[int], list[int]]


NOTHING = Fragment(False, ([], []), "", {}, ([], []))


def group_text(a: list[int], b: list[int]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def fragment(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> Fragment:
    """The fragment of tokens given by ids and by the places where they end, both ascending."""
    groups, i, j, last = [], 0, 0, (0, 0)
    while i < len(a) and j < len(b):
        if a_ends[i] == b_ends[j]:
            i, j = i + 1, j + 1
            groups.append((a[last[0] : i], b[last[1] : j]))
            last = (i, j)
        elif a_ends[i] < b_ends[j]:
            i += 1
        else:
            j += 1
    if not groups:
        return Fragment(False, (a, b), "", {}, ([], []))
    links: dict[tuple[int, int], int] = {}
    for x, y in groups[1:]:
        links[x[-1], y[-1]] = links.get((x[-1], y[-1]), 0) + 1
    closed = ";".join(group_text(*g) for g in groups[1:])
    return Fragment(True, groups[0], closed, links, (a[last[0] :], b[last[1] :]))


def composed(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges. Associative, with NOTHING as its neutral."""
    if not left.cut:
        prefix = (left.prefix[0] + right.prefix[0], left.prefix[1] + right.prefix[1])
        return right._replace(prefix=prefix)
    if not right.cut:
        suffix = (left.suffix[0] + right.prefix[0], left.suffix[1] + right.prefix[1])
        return left._replace(suffix=suffix)
    a, b = left.suffix[0] + right.prefix[0], left.suffix[1] + right.prefix[1]
    links = left.links.copy()
    for pair, n in [*right.links.items(), ((a[-1], b[-1]), 1)]:
        links[pair] = links.get(pair, 0) + n
    parts = (left.closed, group_text(a, b), right.closed)
    return Fragment(True, left.prefix, ";".join(filter(None, parts)), links, right.suffix)


#: The border of a text: both tokenizers end there, before the first byte and after the last.
BORDER = Fragment(True, ([], []), "", {}, ([], []))


def whole(ranges: Fragment) -> Fragment:
    """A text's fragment with its first group closed, as nothing lies before it."""
    if not ranges.cut:
        return BORDER
    a, b = ranges.prefix
    links = ranges.links | {(a[-1], b[-1]): ranges.links.get((a[-1], b[-1]), 0) + 1}
    closed = ";".join(filter(None, (group_text(a, b), ranges.closed)))
    return Fragment(True, ([], []), closed, links, ranges.suffix)


# --- the two vocabularies -----------------------------------------------------------------

#: No border after these: white space, the marker, and what some tables count as white space.
NO_BORDER = r"[\s\u180e\u200b\ufeff\u2581]"
BEFORE = re.compile(f"(?:{NO_BORDER}|^) ")
OPEN_END = re.compile(f"{NO_BORDER}$")
BLANK = re.compile(NO_BORDER)


def chunks(text: str) -> list[str]:
    """Parts of a text, each without the space before it, that are encoded independently."""
    parts = text.split(" ")
    if not BEFORE.search(text):
        return parts
    found = parts[:1]
    for part in parts[1:]:
        before = found[-1]
        safe = bool(before) and not OPEN_END.search(before)
        if safe or (before[-1:] == "\n" and part and not BLANK.match(part)):
            found.append(part)
        else:
            found[-1] = f"{before} {part}"
    return found


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for code points from 256 on.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabularies(NamedTuple):
    """Contents of the two files, handed to the executors with the function."""

    a: str
    b: bytes

    @classmethod
    def read(cls, a_path: str, b_path: str) -> Vocabularies:
        return cls(Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes())


def ranks_of_a(a: str) -> dict[bytes, int]:
    """The entries' bytes with their ids, which have to be in the order of the merges."""
    alphabet, model = byte_alphabet(), json.loads(a)["model"]
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"][m] for m in merges]
    if ids != sorted(ids) or len(ids) + 256 != len(model["vocab"]):
        raise ValueError("the ids of this vocabulary are not in the order of its merges")
    return {bytes(alphabet[c] for c in piece): i for piece, i in model["vocab"].items()}


def bytes_of_a(a: str) -> list[bytes]:
    ranks = ranks_of_a(a)
    found = [b""] * (max(ranks.values()) + 1)
    for entry, i in ranks.items():
        found[i] = entry
    return found


def bytes_of_b(library: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    found = []
    for i in range(library.get_piece_size()):
        piece = library.id_to_piece(i)
        if library.is_control(i) or library.is_unknown(i):
            found.append(b"")
        elif library.is_byte(i):
            found.append(bytes([int(piece[3:-1], 16)]))
        else:
            found.append(piece.replace(MARK, " ").encode())
    return found


def most_pairs(vocabularies: Vocabularies) -> int:
    """A bound on the pairs of ids that can ever be linked, from the vocabularies alone.

    Linked tokens end together, so the bytes of one end with all the bytes of the other; an
    entry of n bytes has at most n such ends, each with at most as many ids as there are
    entries with these bytes.
    """
    a = bytes_of_a(vocabularies.a)
    b = bytes_of_b(sentencepiece.SentencePieceProcessor(model_proto=vocabularies.b))
    count: list[dict[bytes, int]] = [{}, {}]
    for side, entries in enumerate((a, b)):
        for e in entries:
            count[side][e] = count[side].get(e, 0) + 1
    ends = lambda e: (e[i:] for i in range(len(e)))
    return sum(count[1].get(x, 0) for e in a for x in ends(e)) + sum(
        count[0].get(x, 0) for e in b for x in ends(e)
    )


class Aligner:
    """Both tokenizers, and the groups of texts.

    A's ids are those of its merges in the order of its file; tiktoken applies them faster
    than the library the file is made for, and takes special tokens as plain text.
    """

    def __init__(self, vocabularies: Vocabularies):
        self.a = tiktoken.Encoding(
            "a", pat_str=WORDS, mergeable_ranks=ranks_of_a(vocabularies.a), special_tokens={}
        )
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.b)
        self.a_bytes, self.b_bytes = bytes_of_a(vocabularies.a), bytes_of_b(self.b)
        self.a_size, self.b_size = (
            np.array([len(e) for e in entries]) for entries in (self.a_bytes, self.b_bytes)
        )
        pieces = map(self.b.id_to_piece, range(len(self.b_bytes)))
        self.independent = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.lone = self.b.piece_to_id(MARK)
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.written = [f"{i}{end}" for i in range(most) for end in ",|;"]

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """The ids of A and B for each text; None where their bytes are not " " + text.

        An empty one is a range of one space, for which the library of B has no tokens.
        """
        found: list = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            a, raw = self.a.encode_ordinary(" " + text), b" " + text.encode()
            b = b if text else [self.lone]
            same = (
                b"".join(map(self.a_bytes.__getitem__, a)) == raw
                and b"".join(map(self.b_bytes.__getitem__, b)) == raw
            )
            found.append((a, b) if same else None)
        return found

    def aligned(self, texts: list[str]) -> list[dict | None]:
        """Each text's counts, groups as a text, and pairs; None where there are no tokens."""
        tokens = self.tokens(texts)
        good = [t for t in tokens if t is not None]
        if not good:
            return [None] * len(texts)
        sizes = np.array([(len(a), len(b)) for a, b in good])
        a, b = (
            np.fromiter(itertools.chain.from_iterable(t[i] for t in good), np.int64)
            for i in (0, 1)
        )
        # texts lie end to end with the same bytes on both sides, so they end together as well
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        at = np.searchsorted(b_ends, a_ends)
        a_last = b_ends[at] == a_ends
        a_cut, b_cut = np.flatnonzero(a_last), at[a_last]
        b_last = np.zeros(len(b), bool)
        b_last[b_cut] = True
        # a token's place among all: after its own side's, and the other side's of earlier groups
        out = np.empty(len(a) + len(b), np.int64)
        before = np.concatenate([[0], b_cut + 1])
        out[np.arange(len(a)) + before[np.cumsum(a_last) - a_last]] = a * 3 + a_last
        until = a_cut + 1
        out[np.arange(len(b)) + until[np.cumsum(b_last) - b_last]] = b * 3 + 2 * b_last
        borders = np.cumsum(sizes.sum(axis=1))
        groups = np.searchsorted(a_cut, np.cumsum(sizes[:, 0]))
        n_groups = np.diff(groups, prepend=0)
        of_text = np.repeat(np.arange(len(good)), n_groups) << 32
        pairs, counts = np.unique(
            of_text + a[a_cut] * len(self.b_bytes) + b[b_cut], return_counts=True
        )
        cuts = np.searchsorted(pairs >> 32, np.arange(len(good) + 1))
        pairs &= (1 << 32) - 1
        done, low = [], 0
        for i, (n_a, n_b) in enumerate(sizes.tolist()):
            codes = out[low : borders[i]].tolist()
            low = borders[i]
            done.append(
                {
                    "n_a": n_a,
                    "n_b": n_b,
                    "n_groups": int(n_groups[i]),
                    "groups": "".join(map(self.written.__getitem__, codes))[:-1],
                    "pairs": pairs[cuts[i] : cuts[i + 1]],
                    "counts": counts[cuts[i] : cuts[i + 1]],
                }
            )
        rest = iter(done)
        return [None if t is None else next(rest) for t in tokens]


@functools.lru_cache(maxsize=1)
def aligner(vocabularies: Vocabularies) -> Aligner:
    """One for each worker, which tasks share."""
    return Aligner(vocabularies)


# --- fragments as rows --------------------------------------------------------------------

FIELDS = (
    "ok boolean, cut boolean, prefix_a array<int>, prefix_b array<int>, closed string, "
    "suffix_a array<int>, suffix_b array<int>, n_a long, n_b long, n_groups long, "
    "pairs array<long>, counts array<long>"
)
INTS, LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
HEAD = "row long, idx long, raw string"
SCHEMA = pa.schema(
    [("row", pa.int64()), ("idx", pa.int64()), ("raw", pa.string())]
    + [("ok", pa.bool_()), ("cut", pa.bool_()), ("prefix_a", INTS), ("prefix_b", INTS)]
    + [("closed", pa.string()), ("suffix_a", INTS), ("suffix_b", INTS)]
    + [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64())]
    + [("pairs", LONGS), ("counts", LONGS)]
)
NONE = {
    "ok": True,
    "cut": True,
    **dict.fromkeys(("prefix_a", "prefix_b", "suffix_a", "suffix_b", "pairs", "counts"), ()),
    **dict.fromkeys(("n_a", "n_b", "n_groups"), 0),
    "closed": "",
}


def _digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def text_fragments(both: Aligner, texts: list[str | None], digest: bool) -> list[dict]:
    """The finished fragments of whole texts; `closed` is their groups, or the groups' hash."""
    filled = [t for t in texts if t]
    found = iter(both.aligned(filled) if filled else ())
    rows = []
    for text in texts:
        row = next(found) if text else None
        if row is None:
            rows.append(NONE)
            continue
        groups = row.pop("groups")
        rows.append(NONE | row | {"closed": _digest(groups) if digest else groups})
    return rows


def range_fragment(both: Aligner, text: str) -> dict:
    """The fragment of a range: its first group may have begun before, so it is a prefix."""
    (tokens,) = both.tokens([text])
    if tokens is None:
        return NONE | {"ok": False}
    a, b = tokens
    a_ends, b_ends = both.a_size[a].cumsum().tolist(), both.b_size[b].cumsum().tolist()
    found = fragment(a, a_ends, b, b_ends)
    return NONE | {
        "cut": found.cut,
        "prefix_a": found.prefix[0],
        "prefix_b": found.prefix[1],
        "closed": found.closed,
        "suffix_a": found.suffix[0],
        "suffix_b": found.suffix[1],
        "n_a": len(a),
        "n_b": len(b),
        "n_groups": sum(found.links.values()),
        "pairs": [x * len(both.b_bytes) + y for x, y in found.links],
        "counts": list(found.links.values()),
    }


def ranges(text: str, size: int) -> list[str]:
    """Ranges of about so many characters, each without the space before it."""
    found, part, length = [], [], 0
    for chunk in chunks(text):
        part.append(chunk)
        length += len(chunk) + 1
        if length >= size:
            found.append(" ".join(part))
            part, length = [], 0
    return found + [" ".join(part)] * bool(part)


def _in_batches(rows: Iterator[tuple[int, dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a bounded number of characters."""
    held, size = [], 0
    for length, row in rows:
        held.append(row)
        size += length + 200
        if size >= TOGETHER:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _scan(vocabularies: Vocabularies, schema: pa.Schema, size: int, digest: bool) -> Callable:
    """Texts of one range are finished at once; of others only the ranges are cut."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
        both = aligner(vocabularies)
        most = size if both.independent else None
        waiting: list[tuple[dict, str | None]] = []

        def done() -> Iterator[tuple[int, dict]]:
            found = text_fragments(both, [t for _, t in waiting], digest)
            for (common, _), row in zip(waiting, found, strict=True):
                yield len(row["closed"]) + 16 * len(row["pairs"]), row | common
            waiting.clear()

        length = 0
        for batch in batches:
            for key, row, text in zip(*batch.columns, strict=True):
                common, text = {"key": key.as_py(), "row": row.as_py()}, text.as_py()
                parts = ranges(text, most) if most and text and len(text) > most else [text]
                if len(parts) > 1:
                    for i, part in enumerate(parts):
                        yield len(part), common | {"idx": i, "raw": part}
                    continue
                waiting.append((common, text))
                length += len(text or "") + 200
                if length >= TOGETHER:
                    yield from done()
                    length = 0
        yield from done()

    return lambda batches: _in_batches(rows(batches), schema)


def _ranges(vocabularies: Vocabularies, schema: pa.Schema) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
        both = aligner(vocabularies)
        for batch in batches:
            for key, row, idx, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = range_fragment(both, raw)
                yield len(found["closed"]), found | {"key": key, "row": row, "idx": idx}

    return lambda batches: _in_batches(rows(batches), schema)


def _as_fragment(row: dict, b_size: int) -> Fragment:
    links = {divmod(p, b_size): n for p, n in zip(row["pairs"], row["counts"], strict=True)}
    return Fragment(
        row["cut"],
        (list(row["prefix_a"]), list(row["prefix_b"])),
        row["closed"],
        links,
        (list(row["suffix_a"]), list(row["suffix_b"])),
    )


def _composer(b_size: int, last: bool, digest: bool) -> Callable:
    """Composes some neighbouring fragments; the last step closes the text's first group."""

    def compose(parts):
        parts = sorted(parts, key=lambda p: p["idx"])
        ok, found = all(p["ok"] for p in parts), BORDER
        if ok:
            found = functools.reduce(composed, (_as_fragment(p, b_size) for p in parts), NOTHING)
        if ok and last:
            found = whole(found)
            if digest:
                found = found._replace(closed=_digest(found.closed))
        links = found.links
        return (
            ok,
            found.cut,
            *found.prefix,
            found.closed,
            *found.suffix,
            *(sum(p[n] for p in parts) if ok else 0 for n in ("n_a", "n_b")),
            sum(links.values()),
            [a * b_size + b for a, b in links],
            list(links.values()),
        )

    return compose


def align(
    docs: DataFrame,
    vocabularies: Vocabularies,
    written: Callable[[DataFrame], DataFrame],
    digest: bool = False,
    size: int = RANGE,
    key: str = "doc_id",
) -> DataFrame:
    """A row for every row of docs with the alignment of its text.

    Columns: key (the document's id), row (a number of the row), n_a, n_b, n_groups, `closed`
    (the groups as `a1,a2|b1;a3|b2`; with digest their SHA-256, '' where there are none), and
    pairs, counts: the linked ids as a * (size of B's vocabulary) + b, and how often. Texts that
    are null, empty, or whose tokens' bytes are not those of " " + text have no tokens.

    Rows are independent; ids may repeat or be null, other columns are ignored. Texts of any
    length are taken whole: what is longer than `size` characters goes to several tasks in
    ranges, whose fragments are composed FAN at a time. A stretch without a border (no
    spaces) is one range. An empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    b_size = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.b).get_piece_size()
    kind = docs.schema[key].dataType
    schema = SCHEMA.insert(0, pa.field("key", to_arrow_type(kind)))
    ddl = f"key {kind.simpleString()}, {HEAD}, {FIELDS}"
    scanned = written(
        docs.select(F.col(key).alias("key"), F.monotonically_increasing_id(), "text").mapInArrow(
            _scan(vocabularies, schema, size, digest), ddl
        )
    )
    long = scanned.filter("idx IS NOT NULL")
    names = ("key", "row", "n_a", "n_b", "n_groups", "closed", "pairs", "counts")
    finished = scanned.filter("idx IS NULL").select(*names)
    most = long.agg(F.max("idx")).first()[0]
    if most is None:
        return finished
    parts = (
        long.select("key", "row", "idx", "raw")
        .repartition("row", "idx")
        .mapInArrow(_ranges(vocabularies, schema), ddl)
    )
    fields = FIELDS.split(", ")
    struct = f"struct<{', '.join(f.replace(' ', ': ') for f in fields)}>"
    while most is not None:
        compose = F.udf(_composer(b_size, most < FAN, digest), struct)
        most = most // FAN if most >= FAN else None
        parts = (
            parts.groupBy("row", F.expr(f"idx div {FAN}").alias("idx"))
            .agg(
                F.first("key").alias("key"),
                F.collect_list(F.struct("idx", *(f.split()[0] for f in fields))).alias("parts"),
            )
            .select("key", "row", "idx", compose("parts").alias("c"))
            .select("key", "row", "idx", "c.*")
        )
    return finished.unionByName(written(parts.select(*names)))


# --- the report ---------------------------------------------------------------------------


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """pair, count, best: all linked pairs of ids, and whether no other A id has B's more often."""
    counts = (
        aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("l"))
        .groupBy(F.col("l.pairs").alias("pair"))
        .agg(F.sum("l.counts").alias("count"))
    )
    b = F.expr(f"pair % {b_size}")
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    return (
        counts.join(highest, b == F.col("b"))
        .select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    )


def alignment_report(
    docs: DataFrame,
    vocabularies: Vocabularies,
    written: Callable[[DataFrame], DataFrame],
    size: int = RANGE,
) -> DataFrame:
    """Per document counts of tokens, groups and links, and how common its links are.

    The table of pairs is broadcast: the vocabularies bound it (`most_pairs`), however
    large the corpus is.
    """
    b_size = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.b).get_piece_size()
    aligned = align(docs, vocabularies, written, True, size)
    pairs = F.broadcast(written(pair_counts(aligned, b_size)))
    first: Callable[[str], Column] = lambda c: F.first(c).alias(c)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return (
        aligned.select(
            "row",
            F.col("key").alias("doc_id"),
            "n_a",
            "n_b",
            "n_groups",
            F.col("closed").alias("groups_sha256"),
            F.explode_outer(F.arrays_zip("pairs", "counts")).alias("l"),
        )
        .join(pairs, F.col("l.pairs") == F.col("pair"), "left")
        .groupBy("row")
        .agg(
            *(first(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")),
            zero(F.col("l.counts")).alias("n_links"),
            zero(F.when(F.col("best"), F.col("l.counts"))).alias("n_best"),
            zero(F.col("count") * F.col("l.counts")).alias("count_sum"),
        )
        .drop("row")
    )
