"""JSON documents of any size, read by many tasks.

A document is cut at its closing braces, which the text reader finds in byte ranges of the
file. Whether a cut is inside a string, and how deep, follows from what every range does to the
two: the number of quotes, and the brackets for either case. These add up over the ranges of a
file, one row a range. A second scan knows where it starts and cuts out the listed objects;
those that cross ranges are put together from their pieces. What is left of a document, with
runs of objects as one mark each, is small, and is parsed as a whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlens.session import materialise
from auditlens.sources.ingest import is_object, parse_one

ESCAPE = re.compile(r"\\.", re.DOTALL)
STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|"|[{\[\]]', re.DOTALL)
BLANK = "\ufeff \t\r\n"

EFFECT = (
    "file string, block bigint, quotes int, outside bigint, inside bigint, bytes bigint, head string, "
    "file_size bigint"
)
PIECES = "file string, block bigint, kind string, run int, place bigint, text string"


def _after(value: str, quoted: int, depth: int) -> tuple[int, int]:
    """The state behind a piece of text and the brace that ended it."""
    parts = ESCAPE.sub("", value).split('"')
    for plain in parts[quoted::2]:
        depth += plain.count("{") + plain.count("[") - plain.count("]")
    quoted ^= (len(parts) - 1) & 1
    return quoted, depth - (not quoted)


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each range does to the state, for a start outside and inside of a string."""
    found: dict[tuple, list] = {}
    for batch in batches:
        for file, block, file_size, size, value in batch.itertuples(index=False):
            state = found.setdefault((file, block, file_size), [0, 0, 1, 0, 0, ""])
            state[0:2] = _after(value, *state[0:2])
            state[2:4] = _after(value, *state[2:4])
            state[4] += size + 1
            state[5] = state[5] or value.lstrip(BLANK)[:1]
    rows = [
        (file, block, quotes, outside, inside, size, head, file_size)
        for (file, block, file_size), (quotes, outside, _, inside, size, head) in found.items()
    ]
    if rows:
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in EFFECT.split(", ")])


class _Range:
    """Cuts the objects at one depth out of a range of a document."""

    def __init__(self, file: str, block: int, quoted: int, depth: int, level: int):
        self.key, self.level = (file, block), level
        self.quoted, self.depth = quoted, depth
        self.run, self.place = -1, 0
        self.text: list[str] = []
        self.between: list[str] = []
        # The objects a range begins within, or ends within, are pieces of one.
        self.open: list[str] | None = [] if depth > level else None
        self.kind = "end"

    def take(self, value: str) -> tuple | None:
        """A finished object, if the brace behind value ends one."""
        quoted, depth = _after(value, self.quoted, self.depth)
        if self.open is None:
            value = self._skeleton(value)
        self.quoted, self.depth = quoted, depth
        if self.open is None:
            return None
        self.open.append(value + "}")
        return self.close() if depth == self.level and not quoted else None

    def _skeleton(self, value: str) -> str:
        """Keeps what stands before the next object, which it opens; gives what is behind."""
        at, depth = 0, self.depth
        if self.quoted:
            end = STRING_END.match(value)
            at = end.end() if end else len(value)
        for token in TOKEN.finditer(value, at):
            mark = token.group()
            if mark == "{" and depth == self.level:
                between = "".join([*self.between, value[: token.start()]])
                if self.run >= 0 and between.strip(BLANK) == ",":
                    self.place += 1
                else:
                    self.run, self.place = self.run + 1, 0
                    self.text += [between, json.dumps({"run": f"{self.key[1]}:{self.run}"})]
                self.between, self.open, self.kind = [], [], "whole"
                return value[token.start() :]
            if mark == '"':
                break
            depth += -1 if mark == "]" else mark in "{["
        self.between.append(value + "}")
        return ""

    def close(self) -> tuple:
        text, self.open = "".join(self.open), None
        return (*self.key, self.kind, self.run, self.place, text)

    def last(self) -> Iterator[tuple]:
        if self.open is not None:
            self.kind = {"whole": "start", "end": "middle"}[self.kind]
            yield self.close()
        yield (*self.key, "skeleton", -1, -1, "".join(self.text + self.between))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, now = [c.split()[0] for c in PIECES.split(", ")], None
    for batch in batches:
        out = []
        for file, block, value, quoted, depth, level in batch.itertuples(index=False):
            if now is None or now.key != (file, block):
                out += now.last() if now else ()
                now = _Range(file, block, quoted, depth, level)
            if (piece := now.take(value)) is not None:
                out.append(piece)
        if out:
            yield pd.DataFrame(out, columns=names)
    if now:
        yield pd.DataFrame(list(now.last()), columns=names)


def _ranges(text: DataFrame) -> DataFrame:
    """One row per byte range: the state it starts in, the depth of listed objects."""
    effects = text.select("file", "block", "file_size", "size", "value").mapInPandas(_effects, EFFECT)
    order = Window.partitionBy("file").orderBy("block")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    quoted = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    change = F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside"))
    head = F.first(F.when(F.col("head") != "", F.col("head")), ignorenulls=True)
    return (
        effects.withColumn("quoted", quoted.cast("int"))
        .withColumn("change", change)
        .withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
        .withColumn("read", F.sum("bytes").over(whole))
        .withColumn(
            "level",
            F.when(
                head.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                == "[",
                1,
            ).otherwise(2),
        )
        .select("file", "block", "quoted", "depth", "level", "read", "file_size")
    )


def read_large_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, other files) of JSON files that hold a list of objects each.

    events: file, row, event (variant), as read_json_documents gives them for exports
    ({"Records": [...]}) and arrays; members that are no objects are left out but counted.
    other: (file, reason) of files that hold no list, which are read_json_documents' work
    ("no list"), or no JSON ("not JSON"): one broken member breaks its file, as it does there.
    Empty files are no rows. Bytes that are no UTF-8 are replaced. Files must not be compressed.

    A row a byte range is broadcast: some 100 bytes for spark.sql.files.maxPartitionBytes of
    input. What stands outside of the listed objects is put together by file.
    """
    scan = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.octet_length("value").alias("size"),
        F.make_valid_utf8("value").alias("value"),
    )
    ranges = materialise(_ranges(scan), "ranges")
    # Both scans must cut a file alike: a range without its state would be lost silently.
    known = F.when(F.col("depth").isNull(), F.raise_error(F.lit("files changed while read")))
    started = scan.join(F.broadcast(ranges.drop("read", "file_size")), ["file", "block"], "left").select(
        "file", "block", "value", "quoted", F.coalesce(known, "depth").alias("depth"), "level"
    )
    pieces = materialise(started.mapInPandas(_cut, PIECES), "pieces")

    by_block = Window.partitionBy("file").orderBy("block", "rank")
    owner = F.last(F.when(F.col("kind") == "start", F.col("block")), ignorenulls=True)
    owner_run, owner_place = (
        F.last(F.when(F.col("kind") == "start", F.col(c)), ignorenulls=True) for c in ("run", "place")
    )
    ordered = (
        pieces.filter(F.col("kind").isin("start", "middle", "end"))
        .withColumn("rank", (F.col("kind") == "start").cast("int"))
        .select(
            "file", "kind", "text", "block", "rank", F.lag("kind").over(by_block).alias("before"),
            owner.over(by_block).alias("own"), owner_run.over(by_block).alias("run"),
            owner_place.over(by_block).alias("place"),
        )
    )
    # What goes on without having begun is deeper than any list of objects.
    deeper = ordered.filter(
        (F.col("kind") != "start") & F.coalesce(F.col("before") == "end", F.lit(True))
    )
    crossing = (
        ordered.groupBy("file", F.col("own").alias("block"), "run", "place")
        .agg(F.array_sort(F.collect_list(F.struct("block", "rank", "text"))).alias("parts"))
        .select("file", "block", "run", "place", F.array_join("parts.text", "").alias("text"))
    )
    objects = (
        pieces.filter("kind = 'whole'")
        .select("file", "block", "run", "place", "text")
        .unionByName(crossing)
        .select(
            "file", F.concat_ws(":", "block", "run").alias("run"), "place",
            parse_one(F.col("text")).alias("event"),
        )
    )
    objects = materialise(objects, "objects")
    sizes = objects.groupBy("file", "run").agg(
        F.max("place").alias("last"),
        F.bool_or(F.col("event").isNull()).alias("broken"),
    )

    read = ranges.select("file", "file_size", "read").distinct()
    # The last piece of a file that does not end in a brace was given one.
    joined = F.array_join(F.transform(F.array_sort("parts"), lambda p: p["text"]), "")
    ended = (F.col("file_size") - F.col("read")).isin(0, 3)
    text = F.when(ended, F.col("joined")).otherwise(
        F.substring("joined", F.lit(1), F.length("joined") - 1)
    )
    skeletons = (
        pieces.filter("kind = 'skeleton'")
        .groupBy("file")
        .agg(F.collect_list(F.struct("block", "text")).alias("parts"))
        .withColumn("joined", joined)
        .join(read, "file")
        .select("file", parse_one(F.ltrim(F.regexp_replace(text, "^\\uFEFF", ""))).alias("doc"))
    )
    broken = sizes.groupBy("file").agg(F.bool_or("broken").alias("broken"))
    records = F.try_variant_get("doc", "$.Records", "variant")
    list_of = F.when(F.schema_of_variant("doc").startswith("ARRAY"), F.col("doc")).when(
        F.schema_of_variant(records).startswith("ARRAY"), records
    )
    deep = deeper.select("file", F.lit("no list").alias("deep")).distinct()
    files = materialise(
        skeletons.join(broken, "file", "left").join(deep, "file", "left").select(
            "file",
            F.when(F.col("deep").isNotNull(), F.col("deep"))
            .when(F.col("doc").isNull() | F.coalesce("broken", F.lit(False)), "not JSON")
            .when(list_of.isNull(), "no list")
            .alias("reason"),
            F.try_variant_get(list_of, "$", "array<variant>").alias("members"),
        ),
        "files",
    )
    members = (
        files.filter("reason IS NULL")
        .select("file", F.posexplode("members").alias("at", "member"))
        .withColumn("run", F.when(is_object(F.col("member")), F.try_variant_get("member", "$.run", "string")))
        .join(sizes, ["file", "run"], "left")
        .withColumn("n", F.coalesce(F.col("last") + 1, F.lit(1)))
    )
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    runs = members.select(
        "file", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    ).filter("run IS NOT NULL")
    events = objects.join(runs, ["file", "run"]).select(
        "file", (F.col("before") + F.col("place") + 1).alias("row"), "event"
    )
    return events, files.filter("reason IS NOT NULL").select("file", "reason")
