"""Conversation structure repair by weighted CYK interval parsing.

A conversation's role initials have to read `(s?(ua)+)?`. The grammar, in Chomsky normal
form, has one nonterminal for every pair of places (p, q) in that pattern: it derives the
edits that lead from p to q. A turn alone derives "keep", "rerole" or "delete"; any span
also derives itself with turns inserted around it (the insertion closure); and (p, q) derives
(p, r)(r, q). Cells hold the least (cost, audit) of a span and a nonterminal, and are
combined bottom-up by span length. As the nonterminals are pairs of places, every way to
split a span in two gives the same cells, so each span is split once, in the middle.

The same combination works between tasks. Rows are dealt by ranges of (conversation, turn),
so a very long conversation lies in several tasks; each yields fragments of bounded size with
their cells, the cells are combined in order, and every fragment then replays its own
part of the cheapest audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places in the pattern `(s?(ua)+)?`: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
PLACES = range(4)
ACCEPTED = (START, ASSISTANT)
STEPS = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
ROLE = {"u": "user", "a": "assistant"}
RENAMED, DELETED, INSERTED, UNFINISHED = 3, 4, 3, 3

#: A fragment ends after so many rows, or so many characters of text.
MOST_ROWS, MOST_CHARS = 4096, 8_000_000
#: Characters of role and text that order rows of one turn; a hash decides among the rest.
ORDERED = 64

Cell = tuple[int, str]
Cells = dict[tuple[int, int], Cell]


# --- the chart ----------------------------------------------------------------------------


def product(left: Cells, right: Cells) -> Cells:
    """The rule (p, q) -> (p, r)(r, q) over two neighbouring spans."""
    found: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for q in PLACES:
            tail = right.get((r, q))
            if tail is not None:
                cell = (cost + tail[0], audit + tail[1])
                if (p, q) not in found or cell < found[p, q]:
                    found[p, q] = cell
    return found


def _insertions() -> Cells:
    """Only insertions: the least ways from place to place without any row."""
    least: Cells = {(p, p): (0, "") for p in PLACES}
    one = least | {(p, q): (INSERTED, "I") for (p, initial), q in STEPS.items() if initial in ROLE}
    while (more := product(least, one)) != least:
        least = more
    return least


EMPTY = _insertions()


def leaf(initial: str, fault: str) -> Cells:
    """The cells of one row, closed under insertions before and after it."""
    cells: Cells = {(p, p): (DELETED, "D") for p in PLACES}
    if fault not in ("blank", "duplicate"):
        extra = UNFINISHED if fault == "truncated" else 0
        for (p, step), q in STEPS.items():
            if step == initial:
                cells[p, q] = (extra, "K")
            elif step in ROLE:
                cells[p, q] = (RENAMED + extra, "R")
    return product(product(EMPTY, cells), EMPTY)


def combined(spans: list[Cells]) -> Cells:
    """The chart's top cells: spans of length 1, 2, 4, ... from the bottom up."""
    if not spans:
        return EMPTY
    while len(spans) > 1:
        pairs = [product(a, b) for a, b in zip(spans[::2], spans[1::2], strict=False)]
        spans = pairs + spans[len(spans) & ~1 :]
    return spans[0]


def best(cells: Cells) -> tuple[int, str, int]:
    """The least (cost, audit) that ends the pattern, and the place where it ends."""
    return min((*cells[START, q], q) for q in ACCEPTED if (START, q) in cells)


def replay(audit: str, rows: list[tuple[str, str]], place: int) -> tuple[list[tuple], int]:
    """The rows that an audit leaves from a place on, and the place it leads to."""
    kept, rest = [], iter(rows)
    for edit in audit:
        forced = "a" if place == USER else "u"
        if edit == "I":
            kept.append((ROLE[forced], ""))
            place = STEPS[place, forced]
            continue
        role, text = next(rest)
        if edit == "D":
            continue
        initial = forced if edit == "R" else role[:1]
        kept.append((ROLE[initial] if edit == "R" else role, text))
        place = STEPS[place, initial]
    return kept, place


# --- rows ---------------------------------------------------------------------------------

#: No class of regular expressions, so that all sides agree on what is blank.
SPACE = "\t\n\x0b\x0c\r "


def fault_of(role: str, text: str, again: bool) -> str:
    """The first fault of a row; again: whether its role and text were seen before."""
    stripped = text.rstrip(SPACE)
    if not stripped:
        return "blank"
    if again:
        return "duplicate"
    return "" if stripped[-1] in ".!?" else "truncated"


def spoken(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls of role and text as one space, and `lost` = false."""
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
        F.lit(False).alias("lost"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that the checksum of conversation and turn asks for.

    0 loses the row (it stays as a mark, `lost`, so that its conversation is not forgotten),
    1 empties its text, 2 takes out its ends of sentences, 3 repeats it, 4 makes it a user's.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = spoken(conversations).withColumn(
        "case", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    )
    case = F.col("case")
    return rows.select(
        "conv_id",
        "turn",
        F.when(case == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(case <= 1, "")
        .when(case == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (case == 0).alias("lost"),
        F.explode(F.array_repeat(F.lit(0), F.when(case == 3, 2).otherwise(1).cast("int"))).alias(
            "copy"
        ),
    ).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """The rows dealt and sorted by ranges of conversation and turn, nulls first.

    Rows of one turn are in the order of role and text (beyond 64 characters by a hash). No
    key is kept together, so a conversation of any length is spread over tasks; a row number
    splits rows that are equal throughout.
    """
    keys: list[Column] = [
        F.col("conv_id"),
        F.col("turn"),
        F.substring("role", 1, ORDERED).alias("_role"),
        F.substring("text", 1, ORDERED).alias("_text"),
        F.xxhash64("role", "text").alias("_rest"),
        F.monotonically_increasing_id().alias("_at"),
    ]
    names = ["conv_id", "turn", "_role", "_text", "_rest", "_at"]
    numbered = rows.select("*", *keys[2:])
    return (
        numbered.repartitionByRange(*names)
        .sortWithinPartitions(*names)
        .select("conv_id", "turn", "role", "text", "lost", F.spark_partition_id().alias("task"))
    )


# --- fragments ----------------------------------------------------------------------------

KEPT = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
FRAGMENT = pa.schema(
    [
        ("part", pa.int64()),
        ("whole", pa.bool_()),
        ("turns", pa.list_(pa.int64())),
        ("roles", pa.list_(pa.string())),
        ("texts", pa.list_(pa.string())),
        ("blank", pa.int64()),
        ("duplicate", pa.int64()),
        ("truncated", pa.int64()),
        ("illegal", pa.int64()),
        ("gaps", pa.int64()),
        ("cost", pa.int64()),
        ("audit", pa.string()),
        ("repaired", KEPT),
    ]
)
FRAGMENT_DDL = (
    "part long, whole boolean, turns array<long>, roles array<string>, texts array<string>, "
    "blank long, duplicate long, truncated long, illegal long, gaps long, cost long, "
    "audit string, repaired array<struct<role: string, text: string>>"
)
LEGAL = {"su", "ua", "au"}


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def finished(turns: list, rows: list[tuple[str, str]]) -> dict:
    """What a conversation that is all here comes to."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for row in rows:
        faults.append(fault_of(*row, row in seen))
        seen.add(row)
    spans = [leaf(r[:1], f) for (r, _), f in zip(rows, faults, strict=True)]
    cost, audit, _ = best(combined(spans))
    kept, _ = replay(audit, rows, START)
    return {
        "turns": [],
        "roles": [],
        "texts": [],
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": illegal_pairs([r[:1] for r, _ in rows]),
        "gaps": _gaps(turns),
        "cost": cost,
        "audit": audit,
        "repaired": [{"role": r, "text": t} for r, t in kept],
    }


def _fragments(id_type: pa.DataType, most_rows: int, most_chars: int) -> Callable:
    """Cuts a task's sorted rows into fragments, and finishes those that are all of theirs."""
    schema = FRAGMENT.insert(0, pa.field("conv_id", id_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, rows, chars, conv, part, cut = [], [], 0, None, None, True
        out, held = [], 0

        def close(whole: bool) -> dict:
            common = {"conv_id": conv, "part": part, "whole": whole}
            if whole:
                return common | finished(turns, rows)
            return common | {
                "turns": turns,
                "roles": [r for r, _ in rows],
                "texts": [t for _, t in rows],
            }

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for conv_id, turn, role, text, lost, task in zip(*columns, strict=True):
                if part is None:
                    conv, part = conv_id, task << 33
                full = len(rows) >= most_rows or chars >= most_chars
                if conv_id != conv or full:
                    # a task's first conversation may have begun in the task before
                    same = conv_id == conv
                    out.append(close(whole=not (cut or same)))
                    held += chars + 1000
                    cut = same
                    turns, rows, chars, conv, part = [], [], 0, conv_id, part + 1
                    if held >= MOST_CHARS:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                if not lost:
                    turns.append(turn)
                    rows.append((role, text))
                    chars += len(text)
        if part is not None:  # and its last one may go on in the next
            out.append(close(whole=False))
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _id_type(df: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def cut(rows: DataFrame, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS) -> DataFrame:
    """Fragments of conversations: whole ones finished, of others the rows in order."""
    ddl, arrow = _id_type(rows)
    return in_order(rows).mapInArrow(
        _fragments(arrow, most_rows, most_chars), f"conv_id {ddl}, {FRAGMENT_DDL}"
    )


# --- conversations in several fragments ---------------------------------------------------

CELL_DDL = "array<struct<p: int, q: int, cost: long, audit: string>>"


def _repeats(parts: DataFrame) -> DataFrame:
    """Which places of a fragment hold a role and text that was there earlier (again).

    Keys are 128 bits of role and text. Their first places are found by a minimum, which is
    merged before the shuffle, so that a text said any number of times is no hot group.
    """
    said = parts.select(
        "conv_id",
        "part",
        F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "said"),
    ).select(
        "conv_id",
        F.xxhash64("said.roles", "said.texts").alias("k1"),
        F.xxhash64(F.lit(1), "said.roles", "said.texts").alias("k2"),
        F.struct("part", "at").alias("place"),
    )
    key = ["k1", "k2"]
    firsts = said.groupBy("conv_id", *key).agg(F.min("place").alias("first"))
    same = reduce(
        lambda a, b: a & b, [F.col(f"s.{k}") == F.col(f"f.{k}") for k in key]
    ) & F.col("s.conv_id").eqNullSafe(F.col("f.conv_id"))
    return (
        said.alias("s")
        .join(firsts.alias("f"), same)
        .filter("s.place != f.first")
        .groupBy("s.conv_id", "s.place.part")
        .agg(F.collect_list("s.place.at").alias("again"))
    )


CHART_DDL = f"struct<blank: long, duplicate: long, truncated: long, cells: {CELL_DDL}>"
GUIDE_DDL = "array<struct<part: long, place: int, audit: string, cost: long>>"
KEPT_DDL = "array<struct<role: string, text: string>>"


def _charted(roles: list, texts: list, again: list | None) -> tuple:
    """A fragment's faults and cells. At most MOST_ROWS rows are in it."""
    seen = set(again or ())
    faults = [fault_of(r, t, i in seen) for i, (r, t) in enumerate(zip(roles, texts, strict=True))]
    cells = combined([leaf(r[:1], f) for r, f in zip(roles, faults, strict=True)])
    return (
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        [(p, q, cost, audit) for (p, q), (cost, audit) in cells.items()],
    )


def _guided(fragments: list) -> list:
    """Each fragment's share of the cheapest audit, and the place where it begins.

    The cells of the fragments are combined from the right, so that the place and the audit
    of every fragment can be read off from the left.
    """
    fragments = sorted(fragments, key=lambda f: f["part"])
    cells = [{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in f["cells"]} for f in fragments]
    after: list[dict[int, Cell]] = [{q: (0, "") for q in ACCEPTED}]
    for own in reversed(cells):
        ways: dict[int, Cell] = {}
        for (p, q), (cost, audit) in own.items():
            if q in after[-1]:
                way = (cost + after[-1][q][0], audit + after[-1][q][1])
                ways[p] = min(ways.get(p, way), way)
        after.append(ways)
    after.reverse()
    found, place = [], START
    for i, own in enumerate(cells):
        total = after[i][place]
        for q in PLACES:
            if (place, q) in own and q in after[i + 1]:
                cost, audit = own[place, q]
                if (cost + after[i + 1][q][0], audit + after[i + 1][q][1]) == total:
                    found.append((fragments[i]["part"], place, audit, cost))
                    place = q
                    break
    return found


def _replayed(audit: str, roles: list, texts: list, place: int) -> list:
    return replay(audit, list(zip(roles, texts, strict=True)), place)[0]


def _joined_fragments(parts: DataFrame) -> DataFrame:
    """Fragments of conversations that are in several, with faults, audit and repaired rows."""

    def on(right: DataFrame) -> tuple[DataFrame, Column]:
        held = right.withColumnsRenamed({"conv_id": "_conv", "part": "_part"})
        return held, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))

    again, same = on(_repeats(parts))
    charted = (
        parts.select("conv_id", "part", "turns", "roles", "texts")
        .join(again, same, "left")
        .withColumn("c", F.udf(_charted, CHART_DDL)("roles", "texts", "again"))
        .drop("_conv", "_part", "again")
    )
    guided, same = on(
        charted.select("conv_id", "part", F.col("c.cells").alias("cells"))
        .groupBy("conv_id")
        .agg(F.udf(_guided, GUIDE_DDL)(F.collect_list(F.struct("part", "cells"))).alias("g"))
        .select("conv_id", F.inline("g"))
    )
    return charted.join(guided, same).select(
        "conv_id",
        "part",
        "turns",
        F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials"),
        *(F.col(f"c.{f}").alias(f) for f in ("blank", "duplicate", "truncated")),
        "cost",
        "audit",
        F.udf(_replayed, KEPT_DDL)("audit", "roles", "texts", "place").alias("repaired"),
    )


def repaired(
    rows: DataFrame,
    written: Callable[[DataFrame], DataFrame],
    most_rows: int = MOST_ROWS,
    most_chars: int = MOST_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """The repair of every conversation: (whole ones, fragments of the others).

    rows: conv_id, turn, role, text, lost (as `spoken` or `damaged` make them; lost rows only
    name their conversation). Both results have conv_id, part, blank, duplicate, truncated,
    cost, audit and `repaired`, the rows that stay, as an array of (role, text); of a
    conversation in fragments these are its parts, in the order of `part`. Whole ones also have
    illegal and gaps, fragments their turns and initials.

    Null conversations are one conversation; turns that are null come first; rows of one turn
    are in the order of role and text; repeated rows are duplicates. A conversation without
    rows has no edits. Texts and conversations of any length are taken whole; only the audit
    of one conversation has to fit a row. An empty table gives empty results, and columns
    besides the four are ignored.
    """
    fragments = written(cut(rows, most_rows, most_chars))
    whole = fragments.filter("whole").drop("whole", "turns", "roles", "texts")
    return whole, _joined_fragments(fragments.filter("NOT whole"))


# --- the report ---------------------------------------------------------------------------


def _said(kept: str) -> Column:
    return F.array_join(
        F.transform(kept, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"
    )


def _hashed(arrow: pa.DataType) -> Callable:
    """One pass over sorted fragments: a conversation's hash needs all its text in order."""
    schema = pa.schema(
        [
            ("conv_id", arrow),
            *((c, pa.int64()) for c in COUNTS),
            ("audit", pa.string()),
            ("repaired_sha256", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def close() -> pa.RecordBatch:
            known = now["least"] is not None
            gaps = now["most"] - now["least"] + 1 - now["distinct"] if known else 0
            row = {"conv_id": now["conv_id"], "gaps": gaps, "audit": "".join(now["audit"])}
            row |= {c: now[c] for c in COUNTS if c != "gaps"}
            row["repaired_sha256"] = now["sha"].hexdigest()
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now["conv_id"]:
                    if now is not None:
                        yield close()
                    now = dict.fromkeys(COUNTS, 0) | {
                        "conv_id": row["conv_id"],
                        "audit": [],
                        "sha": hashlib.sha256(),
                        "last": None,
                        "any": False,
                        "least": None,
                        "most": None,
                        "distinct": 0,
                    }
                for c in ("blank", "duplicate", "truncated", "cost"):
                    now[c] += row[c]
                now["audit"].append(row["audit"])
                initials = row["initials"]
                if initials:
                    if now["last"] is not None:
                        now["illegal"] += illegal_pairs([now["last"], initials[0]])
                    now["illegal"] += illegal_pairs(initials)
                    now["last"] = initials[-1]
                turns = sorted({t for t in row["turns"] if t is not None})
                if turns:  # turns never decrease from fragment to fragment
                    now["distinct"] += len(turns) - (turns[0] == now["most"])
                    now["least"] = turns[0] if now["least"] is None else now["least"]
                    now["most"] = turns[-1]
                if row["kept"]:
                    now["sha"].update(b"\n" * now["any"] + row["said"].encode())
                    now["any"] = True
        if now is not None:
            yield close()

    return run


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_report(
    rows: DataFrame,
    written: Callable[[DataFrame], DataFrame],
    most_rows: int = MOST_ROWS,
    most_chars: int = MOST_CHARS,
) -> DataFrame:
    """Per conversation the counts of faults, the cost, the audit and a hash of the repair."""
    whole, parts = repaired(rows, written, most_rows, most_chars)
    ddl, arrow = _id_type(rows)
    counts = ", ".join(f"{c} long" for c in COUNTS)
    done = whole.select(
        "conv_id", *COUNTS, "audit", F.sha2(_said("repaired"), 256).alias("repaired_sha256")
    )
    pieces = (
        parts.select(
            "conv_id",
            "part",
            "turns",
            "initials",
            "blank",
            "duplicate",
            "truncated",
            "cost",
            "audit",
            F.size("repaired").alias("kept"),
            _said("repaired").alias("said"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part")
    )
    return done.unionByName(
        pieces.mapInArrow(
            _hashed(arrow), f"conv_id {ddl}, {counts}, audit string, repaired_sha256 string"
        )
    )
