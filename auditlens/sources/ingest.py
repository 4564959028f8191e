"""Event files: JSON exports, arrays, single and wrapped events, JSON Lines, CSV.

Every reader gives the same event columns, a `row` (the position in the file)
or a line order to work it out from, and an `error` where the event cannot be
analysed. Lines and cells that are no events go to the quarantine frame
instead of failing the job or vanishing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions import times
from auditlens.session import materialise

# Cells that stay text even if they look like numbers.
TEXT_FIELDS = (
    "eventVersion", "eventTime", "eventName", "eventSource", "sourceIPAddress", "userAgent",
    "errorCode", "accountId", "recipientAccountId",
)
IDENTITY_FIELDS = ("type", "principalId", "arn", "accountId", "userName", "mfaAuthenticated")
MAX_FILE_BYTES = 8 * 1024 * 1024


def _variant_text(v: Column, path: str) -> Column:
    """The field if it is a JSON string; a JSON true is not the string 'true'."""
    field = F.try_variant_get(v, path, "variant")
    return F.when(
        F.schema_of_variant(field) == "STRING", F.try_variant_get(v, path, "string")
    )


def _variant_number(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "double")


def _is_present(v: Column, path: str) -> Column:
    """Neither absent nor a JSON null."""
    field = F.try_variant_get(v, path, "variant")
    return field.isNotNull() & ~F.is_variant_null(field)


def parse_one(text: Column) -> Column:
    """The one JSON value of a text; null where it holds none or anything after it.

    The parser stops after the first value, so the text is read as the only member of a
    list: lines of JSON taken for a document are no document, instead of its first line.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    values = F.try_variant_get(listed, "$", "array<variant>")
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Adds columns that are worked out once a row, whatever reads them.

    Filters and columns above a projection are rewritten in terms of what is below it, so a
    parsed text would be parsed again for each field; nothing is moved below a generator.
    """
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in values]
    return df.select(*kept, F.inline(F.array(row)))


def with_parsed(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the one JSON value of a text, as parse_one, parsed once a row."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    read = once(df, _values=F.try_variant_get(listed, "$", "array<variant>"))
    one = F.when(F.size("_values") == 1, F.get("_values", F.lit(0)))
    return read.withColumn(name, one).drop("_values")


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def with_event_columns(df: DataFrame, v: str, ingest_time: str | None = None) -> DataFrame:
    """Event columns of a variant column that holds one event object per row.

    An event without a time gets ingest_time (wall clock, fixed by the caller so
    that a replay gives the same result); without one, with a time that cannot be
    read, or with a number field that is no number, the row gets an error instead of
    a verdict.
    """
    event = F.col(v)
    resources = F.try_variant_get(event, "$.accessed_resources", "variant")
    texts = {f: F.try_variant_get(event, f"$.{f}", "string") for f in TEXT_FIELDS}
    mfa = "$.userIdentity.mfaAuthenticated"
    identity = F.struct(
        *[
            F.try_variant_get(event, f"$.userIdentity.{f}", "string").alias(f)
            for f in IDENTITY_FIELDS[:-1]
        ],
        _variant_text(event, mfa).alias("mfaAuthenticated"),
    )
    numbers = {f: _variant_number(event, f) for f in K.PASS_THROUGH_DEFAULTS}
    bad_numbers = F.filter(
        F.array(
            *[
                F.when(number.isNull() & _is_present(event, f"$.{f}"), F.lit(f))
                for f, number in numbers.items()
            ]
        ),
        lambda x: x.isNotNull(),
    )
    read = df.withColumns(
        {
            **texts,
            "userIdentity": identity,
            **numbers,
            "accessed_resources": F.when(
                F.schema_of_variant(resources) == "STRING",
                F.array(F.try_variant_get(event, "$.accessed_resources", "string")),
            ).otherwise(F.try_variant_get(event, "$.accessed_resources", "array<string>")),
            "_has_time": _is_present(event, "$.eventTime"),
            "_bad_numbers": bad_numbers,
        }
    )
    return _with_time_and_error(read, ingest_time)


def _with_time_and_error(read: DataFrame, ingest_time: str | None) -> DataFrame:
    default = F.lit(ingest_time).cast("timestamp_ntz")
    timed = read.withColumns(
        {
            "event_time": F.when(F.col("_has_time"), times.wall_clock(F.col("eventTime")))
            .otherwise(default),
            "event_instant": F.when(F.col("_has_time"), times.instant(F.col("eventTime")))
            .otherwise(default.cast("timestamp")),
        }
    )
    absent = F.col("event_time").isNull()
    error = F.when(~F.col("_has_time") & absent, "no event time and no ingest time").when(
        absent, "unparsable event time"
    ).when(
        F.size("_bad_numbers") > 0,
        F.concat(F.lit("non-numeric: "), F.array_join("_bad_numbers", ", ")),
    )
    return once(timed, error=error).drop("_has_time", "_bad_numbers")


# --- JSON documents ----------------------------------------------------------


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per object in JSON files: file, row, event (variant).

    A file holds an export ({"Records": [...]}), an array, one event, or one
    wrapped event ({"audit_log": {...}}). A JSON document cannot be split, so one
    file is one task; members that are no objects are left out.
    """
    return expand_documents(_documents(spark, path))


def _within(files: DataFrame, max_file_bytes: int | None) -> DataFrame:
    """Rows of files up to a size; the files above it are for too_large()."""
    if max_file_bytes is None:
        return files
    return files.filter(F.col("_metadata.file_size") <= max_file_bytes)


def _documents(spark: SparkSession, path: str, max_file_bytes: int | None = None) -> DataFrame:
    whole = _within(spark.read.text(path, wholetext=True), max_file_bytes)
    named = whole.select(F.col("_metadata.file_path").alias("file"), "value")
    return with_parsed(named, F.col("value"), "doc").select("file", "doc")


def read_json_document_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same for files with one whole document per line, which Spark can split.

    What is no document is in rejected_documents of the same lines.
    """
    return expand_documents(document_lines(spark, path))


def document_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, doc) of the lines that are not blank; doc is null for a broken one."""
    lines = read_lines(spark, path).filter(F.trim("value") != "")
    return with_parsed(lines.select("file", "value"), F.col("value"), "doc")


def rejected_documents(documents: DataFrame) -> DataFrame:
    """(file, reason) of documents, and of members of documents, that hold no event."""
    broken = documents.filter(F.col("doc").isNull()).select("file", F.lit("not JSON").alias("reason"))
    members = _members(documents.filter(F.col("doc").isNotNull()))
    whole = members.filter(F.size("events") == 0).select("file", F.lit("no event").alias("reason"))
    parts = members.select("file", F.explode("events").alias("event"))
    return broken.unionByName(whole).unionByName(
        parts.filter(~F.coalesce(is_object(F.col("event")), F.lit(False))).select(
            "file", F.lit("not an object").alias("reason")
        )
    )


def expand_documents(documents: DataFrame) -> DataFrame:
    """Event objects of JSON documents (file, doc)."""
    return (
        _members(documents.filter(F.col("doc").isNotNull()))
        .select("file", F.posexplode("events").alias("pos", "event"))
        .filter(is_object(F.col("event")))
        .select("file", (F.col("pos") + 1).cast("bigint").alias("row"), "event")
    )


def _members(documents: DataFrame) -> DataFrame:
    """(file, events): what each document holds as a list."""
    # Whether it is a list is asked by reading it as one: a list's schema reads all its members.
    members = F.coalesce(
        F.try_variant_get("doc", "$", "array<variant>"),
        F.try_variant_get("doc", "$.Records", "array<variant>"),
    )
    wrapped = F.try_variant_get("doc", "$.audit_log", "variant")
    is_wrapped = F.coalesce(is_object(wrapped), F.lit(False))
    single = F.when(is_wrapped, wrapped).otherwise(F.col("doc"))
    return once(documents, events=F.coalesce(members, F.array(single))).select("file", "events")


def read_json_events(spark: SparkSession, path: str, ingest_time: str | None = None) -> DataFrame:
    return with_event_columns(read_json_documents(spark, path), "event", ingest_time)


# --- JSON Lines --------------------------------------------------------------


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with the place they come from; files are split between tasks."""
    return _placed(spark.read.text(path))


def _placed(text: DataFrame) -> DataFrame:
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_order"),
        "value",
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Adds the 1-based `row` of each line in its file.

    The lines are first written to the shared folder, which fixes line_order.
    Inside a block it is consecutive, so a line's number is its distance from the
    block's first line plus the lines of the file's earlier blocks; only one row
    per block is windowed.
    """
    fixed = materialise(lines, "lines")
    blocks = fixed.groupBy("file", "block").agg(
        F.min("line_order").alias("_first"), F.count("*").alias("_n")
    )
    earlier = (
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return (
        fixed.join(starts, ["file", "block"])
        .withColumn("row", F.col("line_order") - F.col("_first") + F.col("_before") + 1)
        .drop("_first", "_n", "_before", "line_order", "block")
    )


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of text lines; blank lines are skipped."""
    parsed = with_parsed(lines.filter(F.trim("value") != ""), F.col("value"), "event")
    # A text that parses and begins with a brace is an object; the variant's schema is dear.
    good = F.col("event").isNotNull() & F.ltrim("value").startswith("{")
    reason = F.when(F.col("event").isNull(), "not JSON").otherwise("not an object")
    return (
        parsed.filter(good).drop("value"),
        parsed.filter(~good).withColumn("reason", reason).drop("event"),
    )


def read_jsonl_events(
    spark: SparkSession, path: str, ingest_time: str | None = None
) -> tuple[DataFrame, DataFrame]:
    events, quarantine = parse_lines(read_lines(spark, path))
    return with_event_columns(events, "event", ingest_time), quarantine


# --- CSV ---------------------------------------------------------------------


def unflatten(df: DataFrame) -> DataFrame:
    """Dotted columns to nested structs; a name that is both stays a flat column."""
    plain = [c for c in df.columns if "." not in c]
    nested: dict[str, list[str]] = {}
    for c in df.columns:
        if "." in c:
            nested.setdefault(c.split(".")[0], []).append(c)
    flat = [c for root, cols in nested.items() if root in plain for c in cols]

    def build(prefix: str, cols: list[str]) -> Column:
        leaves, deeper = [], {}
        for c in cols:
            rest = c[len(prefix) + 1:]
            if "." in rest:
                deeper.setdefault(rest.split(".")[0], []).append(c)
            else:
                leaves.append(F.col(f"`{c}`").alias(rest))
        subs = [build(f"{prefix}.{k}", v).alias(k) for k, v in deeper.items()]
        return F.struct(*leaves, *subs)

    return df.select(
        *[F.col(f"`{c}`") for c in [*plain, *flat]],
        *[build(root, cols).alias(root) for root, cols in nested.items() if root not in plain],
    )


def coerce_cell(cell: Column) -> Column:
    """What a text cell holds, as a variant: integer, float, or the stripped text."""
    text = F.trim(cell)
    digits = F.regexp_replace(text, "^-+", "").rlike(r"^\d+$")
    whole = F.when(digits, text.try_cast("bigint"))
    real = text.try_cast("double")
    return F.coalesce(
        whole.cast("variant"), real.cast("variant"), text.cast("variant")
    )


def read_csv_events(
    spark: SparkSession,
    path: str,
    ingest_time: str | None = None,
    names: str = "*",
    max_file_bytes: int | None = None,
) -> DataFrame:
    """CSV with a header; every cell is read as text and cast per declared field.

    Types are never inferred: an account id must keep its leading zeros. Files
    read together must have the same header; one that differs is an error.
    """
    raw = spark.read.option("pathGlobFilter", names).csv(
        path, header=True, inferSchema=False, mode="PERMISSIVE", enforceSchema=False
    )
    named = _within(raw, max_file_bytes).withColumn("file", F.col("_metadata.file_path"))
    cells = unflatten(named.select("file", *[F.col(f"`{c}`") for c in raw.columns]))
    have = set(cells.columns)

    def text(name: str) -> Column:
        return F.trim(F.col(name)) if name in have else F.lit(None).cast("string")

    def identity(field: str) -> Column:
        inside = "userIdentity" in have and field in cells.schema["userIdentity"].dataType.names
        return F.trim(F.col(f"userIdentity.{field}")) if inside else F.lit(None).cast("string")

    numbers = {f: text(f).try_cast("double") for f in K.PASS_THROUGH_DEFAULTS}
    bad_numbers = F.filter(
        F.array(
            *[
                F.when(text(f).isNotNull() & number.isNull(), F.lit(f))
                for f, number in numbers.items()
            ]
        ),
        lambda x: x.isNotNull(),
    )
    known = {*TEXT_FIELDS, *K.PASS_THROUGH_DEFAULTS, "userIdentity", "accessed_resources"}
    others = [F.col(f"`{c}`") for c in cells.columns if c not in known]
    resource = text("accessed_resources")
    read = cells.select(
        *others,
        *[text(f).alias(f) for f in TEXT_FIELDS],
        F.struct(*[identity(f).alias(f) for f in IDENTITY_FIELDS]).alias("userIdentity"),
        *[n.alias(f) for f, n in numbers.items()],
        F.when(resource != "", F.array(resource)).alias("accessed_resources"),
        text("eventTime").isNotNull().alias("_has_time"),
        bad_numbers.alias("_bad_numbers"),
    )
    return _with_time_and_error(read, ingest_time)


# --- choice of format, size bounds -------------------------------------------


LINES_GLOB = "*.{[jJ][sS][oO][nN][lL],[nN][dD][jJ][sS][oO][nN]}"
CSV_GLOB = "*.[cC][sS][vV]"
OTHER_NAMES = r"\.(jsonl|ndjson|csv)$"


def format_of(name: str) -> str:
    """The format a file name stands for."""
    lower = name.lower()
    if lower.endswith(".csv"):
        return "csv"
    return "jsonl" if re.search(r"\.(jsonl|ndjson)$", lower) else "json"


def _with_broken(good: DataFrame, bad: DataFrame, keep: bool) -> DataFrame:
    """Adds what holds no event as rows that have only a file and an error."""
    if not keep:
        return good
    rows = bad.select("file", F.col("reason").alias("error"))
    return good.unionByName(rows, allowMissingColumns=True)


def read_events(
    spark: SparkSession,
    path: str,
    fmt: str = "auto",
    ingest_time: str | None = None,
    keep_broken: bool = False,
    max_file_bytes: int | None = None,
) -> DataFrame:
    """Events of files of one format, or by extension of mixed files in a folder.

    With fmt='auto' every format reads only the files it stands for; file names
    are matched while listing, so no name list passes through the driver. With
    keep_broken lines and documents that hold no event are error rows; else they are
    left out, and only parse_lines and rejected_documents show them. Files above
    max_file_bytes are not read, and each is an error row in any case.
    """
    if max_file_bytes is not None:
        inside, large = split_by_size(list_files(spark, path), max_file_bytes)
        size = F.format_string(f"file of %d bytes is over {max_file_bytes}", "length")
        skipped = large.select(F.col("path").alias("file"), size.alias("reason"))
        if inside.isEmpty():
            return skipped.withColumnRenamed("reason", "error")
    else:
        skipped = None

    def done(events: DataFrame) -> DataFrame:
        return events if skipped is None else _with_broken(events, skipped, True)

    if fmt == "csv":
        return done(read_csv_events(spark, path, ingest_time, max_file_bytes=max_file_bytes))

    def from_documents(docs: DataFrame) -> DataFrame:
        events = with_event_columns(expand_documents(docs), "event", ingest_time)
        return _with_broken(events, rejected_documents(docs), keep_broken)

    def from_lines(lines: DataFrame) -> DataFrame:
        good, bad = parse_lines(lines)
        return _with_broken(with_event_columns(good, "event", ingest_time), bad, keep_broken)

    if fmt == "json":
        return done(from_documents(_documents(spark, path, max_file_bytes)))
    if fmt == "jsonl":
        return done(from_lines(_placed(_within(spark.read.text(path), max_file_bytes))))
    lines = spark.read.option("pathGlobFilter", LINES_GLOB).text(path)
    others = _documents(spark, path, max_file_bytes).filter(~F.lower("file").rlike(OTHER_NAMES))
    frames = [from_documents(others), from_lines(_placed(_within(lines, max_file_bytes)))]
    if not spark.read.format("binaryFile").option("pathGlobFilter", CSV_GLOB).load(path).select(
        "path"
    ).isEmpty():
        frames.append(read_csv_events(spark, path, ingest_time, CSV_GLOB, max_file_bytes))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return done(out)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and length of the files; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def with_fallback(spark: SparkSession, path: str, fmt: str = "auto",
                  allow_csv: bool = False, ingest_time: str | None = None) -> DataFrame:
    """The chosen format first, then json, then jsonl; the first with events wins.

    CSV as a last resort turns broken JSON into rows of nonsense, so it has to be
    asked for.
    """
    first = format_of(path) if fmt == "auto" else fmt
    order = [first] + [f for f in ("json", "jsonl") if f != first]
    if allow_csv and "csv" not in order:
        order.append("csv")
    for kind in order:
        events = read_events(spark, path, kind, ingest_time)
        if not events.isEmpty():
            return events
    raise ValueError(f"no events in {path} as {', '.join(order)}")


def split_by_size(files: DataFrame, limit: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(within the limit, too large); the second is reported, not dropped in silence."""
    return files.filter(F.col("length") <= limit), files.filter(F.col("length") > limit)


def look_back(
    events: DataFrame, time: str, now: Column, minutes: int = 60, limit: int | None = None,
    tie: str = "event_id",
) -> DataFrame:
    """Events of the last `minutes` (at least 1) before now, newest first.

    With a limit Spark keeps that many rows per task and merges them.
    """
    recent = events.filter(
        (F.col(time) >= now - F.make_dt_interval(mins=F.lit(max(1, minutes))))
        & (F.col(time) <= now)
    )
    if limit is None:
        return recent
    return recent.orderBy(F.desc(time), F.desc(tie)).limit(limit)


def poll_records(records: DataFrame, payload: str = "CloudTrailEvent") -> DataFrame:
    """Events out of JSON text payloads; empty and broken payloads are skipped."""
    return with_parsed(records, F.col(payload), "event").filter(
        F.coalesce(is_object(F.col("event")), F.lit(False))
    )
