"""Registered queries: ingest, sinks, incident storage and streams, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.operators import campaigns as CA
from auditlens.functions import text as X
from auditlens.functions import times
from auditlens.operators import metrics as ME
from auditlens.operators import models as MO
from auditlens.operators import triage as TR
from auditlens.plans import frames as FR
from auditlens.session import materialise, scratch_path
from auditlens.sources import incidents as ST
from auditlens.sources import ingest as IN
from auditlens.sources import labelled as LD
from auditlens.sources import sinks
from auditlens.sources import split_json
from auditlens.sources.adapter import audit_events
from auditlens.streaming import jobs, suppression
from auditlens.streaming.admission import admit

NUMBERS = ("login_freq_1h", "geo_anomaly_score", "api_burst_rate", "data_exfil_volume_mb",
           "lateral_movement_score")
PER_DOCUMENT = 1000
PER_LARGE_DOCUMENT = 20_000
#: The most bytes of a file that file_size_cap reads; 100 events are less.
FILE_CAP = 200_000


def _log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log would carry them: the time as text, label and id as extras."""
    wall = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return audit_events(spark, sf_dir).select(
        "event_id", wall.alias("eventTime"), "eventName", "eventSource", "userIdentity",
        "sourceIPAddress", "userAgent", "errorCode", "accountId", "recipientAccountId",
        *NUMBERS, "label",
    )


def _read_back(events: DataFrame, event_id, label) -> DataFrame:
    """What the features are made of, as it came out of the files."""
    return events.filter(F.col("error").isNull()).select(
        event_id.alias("event_id"),
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time"),
        F.col("eventName").alias("event_name"),
        X.principal().alias("principal"),
        F.coalesce("userIdentity.mfaAuthenticated", F.lit("")).alias("mfa"),
        F.coalesce("userAgent", F.lit("")).alias("user_agent"),
        F.coalesce("accountId", F.lit("")).alias("account_id"),
        "recipientAccountId",
        *[F.round(n, 6).alias(n) for n in NUMBERS],
        label.alias("label"),
    ).withColumnRenamed("recipientAccountId", "recipient_account_id")


def _from_variant(events: DataFrame) -> DataFrame:
    return _read_back(
        events,
        F.try_variant_get("event", "$.event_id", "bigint"),
        F.try_variant_get("event", "$.label", "int"),
    )


def ingest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of up to 1000 events each, one document per line."""
    path = scratch_path(spark, "exports")
    events = _log_events(spark, sf_dir)
    number = F.floor(F.col("event_id") / PER_DOCUMENT)
    record = F.struct(*[F.col(c) for c in events.columns])
    documents = events.groupBy(number.alias("number")).agg(F.collect_list(record).alias("Records"))
    documents.select(F.to_json(F.struct("Records"))).write.text(path)
    found = IN.read_json_document_lines(spark, path)
    return _from_variant(IN.with_event_columns(found, "event"))


def _write_large_exports(events: DataFrame, path: str, per_document: int) -> None:
    """Files of one export each, of the events of up to per_document ids; a line an event.

    A document is sorted and written row by row, so a task holds none of them as a whole.
    """
    number = F.floor(F.col("event_id") / per_document)
    record = F.struct(*[F.col(c) for c in events.columns])
    texts = events.select(number.alias("number"), "event_id", F.to_json(record).alias("text"))
    order = Window.partitionBy("number").orderBy("event_id")
    placed = texts.select(
        "number",
        F.row_number().over(order).alias("place"),
        F.lead(F.lit(False), 1, True).over(order).alias("last"),
        "text",
    )
    head = F.when(F.col("place") == 1, '{"Records":[').otherwise(",")
    line = F.concat(head, F.col("text"), F.when(F.col("last"), "]}").otherwise(""))
    # The order that the writer keeps: by document, and in it by place.
    lines = placed.select("number", "place", line.alias("value")).sortWithinPartitions(
        "number", "place"
    )
    lines.select("number", "value").write.partitionBy("number").text(path)


def ingest_large_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one export of up to 20,000 events each, read in byte ranges."""
    path = scratch_path(spark, "large")
    _write_large_exports(_log_events(spark, sf_dir), path, PER_LARGE_DOCUMENT)
    found, _ = split_json.read_large_documents(spark, path)
    return _from_variant(IN.with_event_columns(found, "event"))


def _shaped_documents(events: DataFrame) -> DataFrame:
    """(value): events as exports, arrays, single events and wrapped events, by their id."""
    record = F.struct(*[F.col(c) for c in events.columns])
    shape = F.col("event_id") % 4
    lists = (
        events.filter(shape < 2)
        .groupBy(shape.alias("shape"), F.floor(F.col("event_id") / PER_DOCUMENT).alias("number"))
        .agg(F.collect_list(record).alias("Records"))
    )
    export = F.to_json(F.struct("Records"))
    one, wrapped = F.to_json(record), F.to_json(F.struct(record.alias("audit_log")))
    return (
        lists.select(F.when(F.col("shape") == 0, export).otherwise(F.to_json("Records")).alias("value"))
        .unionByName(events.filter(shape == 2).select(one.alias("value")))
        .unionByName(events.filter(shape == 3).select(wrapped.alias("value")))
    )


def ingest_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all four shapes, one per line."""
    path = scratch_path(spark, "shapes")
    _shaped_documents(_log_events(spark, sf_dir)).write.text(path)
    found = IN.read_json_document_lines(spark, path)
    return _from_variant(IN.with_event_columns(found, "event"))


def ingest_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of JSON documents, one per file, and CSV files, told apart by name."""
    path = scratch_path(spark, "mixed")
    events = _log_events(spark, sf_dir)
    lists = events.filter("event_id % 2 = 0")
    record = F.struct(*[F.col(c) for c in events.columns])
    number = F.floor(F.col("event_id") / PER_DOCUMENT)
    documents = lists.groupBy(number.alias("number")).agg(F.collect_list(record).alias("Records"))
    documents.select(F.to_json(F.struct("Records"))).write.option("maxRecordsPerFile", 1).text(path)
    _flat_csv(events.filter("event_id % 2 = 1")).write.mode("append").csv(path, header=True)
    rows = IN.read_events(spark, path)
    return _read_back(
        rows,
        F.coalesce(
            F.col("event_id").cast("bigint"), F.try_variant_get("event", "$.event_id", "bigint")
        ),
        F.coalesce(F.col("label").cast("int"), F.try_variant_get("event", "$.label", "int")),
    )


def ingest_documents_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which some are broken: what was read and what was set aside."""
    path = scratch_path(spark, "documents")
    events = _log_events(spark, sf_dir)
    one = F.to_json(F.struct(*[F.col(c) for c in events.columns]))
    value = (
        F.when(F.col("eventName") == "ListBuckets", F.substring(one, 1, 20))
        .when(F.col("eventName") == "PutObject", F.lit('[17, "x"]'))
        .when(F.col("eventName") == "Decrypt", F.lit('{"Records": []}'))
        .otherwise(one)
    )
    events.select(value.alias("value")).write.text(path)
    documents = IN.document_lines(spark, path)
    counted = IN.expand_documents(documents).select(F.lit("event").alias("kind")).unionByName(
        IN.rejected_documents(documents).select(F.col("reason").alias("kind"))
    )
    return counted.groupBy("kind").agg(F.count("*").alias("n"))


def ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose time or numbers cannot be read: what the reader says of each."""
    path = scratch_path(spark, "errors")
    events = _log_events(spark, sf_dir).withColumns(
        {
            "eventTime": F.when(F.col("eventName") == "ListBuckets", F.lit("yesterday")).otherwise(
                F.col("eventTime")
            ),
            "geo_anomaly_score": F.when(
                F.col("eventName") == "Decrypt", F.lit("high")
            ).otherwise(F.col("geo_anomaly_score").cast("string")),
        }
    )
    events.write.json(path)
    found, _ = IN.read_jsonl_events(spark, path)
    return found.filter(F.col("error").isNotNull()).select(
        F.try_variant_get("event", "$.event_id", "bigint").alias("event_id"), "error"
    )


def _labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with label cells of mixed types under two names, written and read back."""
    path = scratch_path(spark, "labelled")
    events = _log_events(spark, sf_dir)
    body = F.to_json(F.struct(*[F.col(c) for c in events.columns if c != "label"]))
    cell = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('"C'), F.col("label"), F.lit('"')))
        .when(F.col("event_id") % 5 == 1, F.concat(F.col("label"), F.lit(".2")))
        .when(F.col("event_id") % 5 == 2, F.lit("true"))
        .otherwise(F.col("label").cast("string"))
    )
    key = F.when(F.col("event_id") % 3 == 0, F.lit("threat_class")).otherwise(F.lit("label"))
    line = F.concat(F.lit('{"'), key, F.lit('": '), cell, F.lit(", "), F.substr(body, F.lit(2)))
    broken = F.when(F.col("eventName") == "ListBuckets", F.lit("{broken")).otherwise(line)
    events.select(broken.alias("value")).write.text(path)
    rows = LD.read(spark, path, "jsonl")
    return rows.withColumn("event_id", F.try_variant_get("event", "$.event_id", "bigint"))


def labelled_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report and check of a labelled file."""
    return LD.check(LD.report(_labelled_lines(spark, sf_dir), "event_id"))


def labelled_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled file up to a trained model, and how that does on its own rows."""
    rows = materialise(
        LD.load(_labelled_lines(spark, sf_dir), "event_id").select("label", *K.FEATURES), "usable"
    )
    scored = MO.train(rows, MO.Recipe()).score(rows).select("label", "predicted_class")
    return ME.against_always_benign(ME.confusion_cells(scored))


def ingest_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    _log_events(spark, sf_dir).write.json(path)
    events, _ = IN.read_jsonl_events(spark, path)
    return _from_variant(events)


def _flat_csv(events: DataFrame) -> DataFrame:
    flat = [F.col(c) for c in events.columns if c != "userIdentity"]
    identity = [
        F.col(f"userIdentity.{f}").alias(f"userIdentity.{f}")
        for f in events.schema["userIdentity"].dataType.names
    ]
    return events.select(*flat, *identity)


def ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted headers; every cell is text until the declared type is applied."""
    path = scratch_path(spark, "csv")
    _flat_csv(_log_events(spark, sf_dir)).write.csv(path, header=True)
    rows = IN.read_csv_events(spark, path)
    return _read_back(rows, F.col("event_id").cast("bigint"), F.col("label").cast("int"))


def ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which some are broken: what was read and what was set aside."""
    path = scratch_path(spark, "broken")
    events = _log_events(spark, sf_dir)
    line = F.to_json(F.struct(*[F.col(c) for c in events.columns]))
    broken = (
        F.when(F.col("eventName") == "ListBuckets", F.substring(line, 1, 20))
        .when(F.col("eventName") == "PutObject", F.lit("17"))
        .when(F.col("eventName") == "Decrypt", F.lit(""))
        .otherwise(line)
    )
    events.select(broken.alias("value")).write.text(path)
    good, bad = IN.parse_lines(IN.read_lines(spark, path))
    counted = good.select(F.lit("event").alias("kind")).unionByName(
        bad.select(F.col("reason").alias("kind"))
    )
    return counted.groupBy("kind").agg(F.count("*").alias("n"))


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: lines and the range of their numbers, which must be 1..n."""
    path = scratch_path(spark, "numbered")
    _log_events(spark, sf_dir).write.json(path)
    numbered = IN.number_lines(IN.read_lines(spark, path))
    per_file = numbered.groupBy("file").agg(
        F.count("*").alias("n"), F.min("row").alias("lo"), F.max("row").alias("hi"),
        F.count_distinct("row").alias("different"),
    )
    return per_file.agg(
        F.sum("n").alias("lines"),
        F.count_if((F.col("lo") != 1) | (F.col("hi") != F.col("n"))
                   | (F.col("different") != F.col("n"))).alias("bad_files"),
    )


def ingest_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not what they are taken for, and what they are read as in the end.

    Lines of events and tables of events are both said to be JSON documents. A folder without
    any event is an error that names the formats tried.
    """
    events = _log_events(spark, sf_dir)
    lines, table, blank = (scratch_path(spark, n) for n in ("lines", "table", "blank"))
    odd = F.col("event_id") % 2 == 1
    events.filter(odd).write.option("maxRecordsPerFile", PER_DOCUMENT).json(lines)
    _flat_csv(events.filter(~odd)).write.option("maxRecordsPerFile", PER_DOCUMENT).csv(
        table, header=True
    )
    events.filter("event_id IS NULL").select(F.lit("").alias("value")).write.text(blank)
    as_lines = _from_variant(IN.with_fallback(spark, lines, "json"))
    as_table = _read_back(
        IN.with_fallback(spark, table, "json", allow_csv=True),
        F.col("event_id").cast("bigint"),
        F.col("label").cast("int"),
    )
    try:
        error = f"{IN.with_fallback(spark, blank, 'json').count()} events"
    except ValueError as none:
        error = str(none).replace(blank, "the folder")
    found = as_lines.withColumn("read_as", F.lit("jsonl")).unionByName(
        as_table.withColumn("read_as", F.lit("csv"))
    )
    return found.withColumn("blank", F.lit(error))


def file_size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 100 events, every second one too large: events read, files reported."""
    path = scratch_path(spark, "sizes")
    events = _log_events(spark, sf_dir)
    record = F.struct(*[F.col(c) for c in events.columns])
    documents = events.groupBy(F.floor(F.col("event_id") / 100).alias("number")).agg(
        F.collect_list(record).alias("Records"),
    )
    note = F.when(F.col("number") % 2 == 1, F.repeat(F.lit("x"), FILE_CAP))
    one = F.to_json(F.struct("Records", note.alias("note")))
    documents.select(one).write.option("maxRecordsPerFile", 1).text(path)
    found = IN.read_events(spark, path, "json", max_file_bytes=FILE_CAP)
    large = F.col("error").endswith(f"is over {FILE_CAP}")
    return found.select(
        F.try_variant_get("event", "$.event_id", "bigint").alias("event_id"),
        F.coalesce(large, F.lit(False)).cast("int").alias("too_large"),
    ).groupBy("event_id", "too_large").agg(F.count("*").alias("n"))


def poll_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-up records whose event is JSON text; broken payloads are skipped."""
    events = _log_events(spark, sf_dir)
    payload = F.to_json(F.struct(*[F.col(c) for c in events.columns]))
    path = scratch_path(spark, "records")
    events.select(
        F.when(F.col("eventName") == "PutObject", F.lit("{broken"))
        .when(F.col("eventName") != "Decrypt", payload)
        .alias("CloudTrailEvent")
    ).write.parquet(path)
    records = spark.read.parquet(path)
    return _from_variant(IN.with_event_columns(IN.poll_records(records), "event"))


# --- sinks ---------------------------------------------------------------------


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export")
    sinks.write_csv(FR.triage_rows(spark, sf_dir), path)
    return spark.read.csv(path, header=True, escape='"')


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export")
    rows = FR.triage_rows(spark, sf_dir)
    sinks.write_json(TR.summary(rows), TR.result_rows(rows), path)
    schema = "row bigint, principal string, confidence double, action string, " \
             "probabilities map<string,double>, raw_log string"
    back = spark.read.schema(schema).json(f"{path}/results")
    raw_source = F.get_json_object("raw_log", "$.eventSource").alias("raw_source")
    return back.select("row", "principal", "confidence", "action", raw_source, *[
        F.col("probabilities")[K.CLASS_LABELS[c]].alias(f"p{c}") for c in K.CLASS_IDS
    ])


def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary beside the exported results, read back."""
    path = scratch_path(spark, "export")
    rows = FR.triage_rows(spark, sf_dir)
    summary = TR.summary(rows)
    sinks.write_json(summary, TR.result_rows(rows), path)
    return spark.read.schema(summary.schema).json(f"{path}/summary")


def append_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threats and benign verdicts appended one after the other, read back."""
    path = scratch_path(spark, "incidents")
    rows = FR.incidents(spark, sf_dir)
    ST.append(rows.filter(F.col("predicted_class") != 0), path)
    ST.append(rows.filter(F.col("predicted_class") == 0), path)
    stored = ST.read(spark, path)
    schema = audit_events(spark, sf_dir).schema
    event = F.from_json("raw_log", schema, ST.RAW_OPTIONS)
    return stored.withColumn("event", event).select(
        "id", "user_id", "source", "event_name", "principal", "predicted_class", "confidence",
        "action_status", F.coalesce("rollback", F.lit("")).alias("rollback"),
        F.col("event.eventSource").alias("raw_source"),
        F.coalesce("event.accountId", F.lit("")).alias("raw_account"),
        F.date_format("event.event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("raw_time"),
        F.col("event.api_burst_rate").alias("raw_rate"),
        F.coalesce(F.array_join("event.accessed_resources", ","), F.lit("")).alias("raw_resources"),
    )


def cleared_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after the busiest owner cleared their history, with the count removed."""
    path = scratch_path(spark, "incidents")
    ST.append(FR.incidents(spark, sf_dir), path)
    owner = (
        ST.read(spark, path).groupBy("user_id").count()
        .orderBy(F.desc("count"), "user_id").first().user_id
    )
    gone = ST.remove_owner(spark, path, owner)
    return ST.read(spark, path).agg(
        F.lit(owner).cast("bigint").alias("user_id"), F.lit(gone).cast("bigint").alias("cleared"),
        F.count("*").alias("left"),
        F.count_if(F.col("user_id") == owner).alias("left_of_owner"),
    )


def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every incident's event as a nested object, with what its verdict sets merged into it."""
    rows = FR.incidents(spark, sf_dir)
    base = F.to_json(
        F.struct(
            F.struct(F.col("event_name").alias("name"), F.lit("seen").alias("kind")).alias("event"),
            F.array(*map(F.lit, "abc")).alias("tags"),
            F.struct(
                F.col("principal").alias("name"),
                F.struct(F.lit("no").alias("used"), F.lit("d1").alias("device")).alias("mfa"),
            ).alias("actor"),
        )
    )
    override = F.to_json(
        F.struct(
            F.struct(F.col("class_label").alias("kind")).alias("event"),
            F.array("source").alias("tags"),
            F.struct(F.struct(F.lit("yes").alias("used")).alias("mfa")).alias("actor"),
        )
    )
    merged = CA.deep_merged(base, F.when(F.col("predicted_class") != 0, override))
    value = lambda path: F.get_json_object("m", f"$.{path}")
    return rows.select("id", merged.alias("m")).select(
        "id", value("event.name").alias("name"), value("event.kind").alias("kind"),
        value("actor.name").alias("actor"), value("actor.mfa.used").alias("mfa"),
        value("actor.mfa.device").alias("device"),
        F.json_array_length(value("tags")).alias("tags"),
    )


def removed_then_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All owners' incidents by class after the busiest owner's removal and a late delivery.

    The late rows, every third of the owner's, have ids below removed ones. The owner's bucket
    is then compacted.
    """
    path = scratch_path(spark, "incidents")
    rows = FR.incidents(spark, sf_dir)
    ST.append(rows, path)
    owner = (
        ST.read(spark, path).groupBy("user_id").count()
        .orderBy(F.desc("count"), "user_id").first().user_id
    )
    ST.remove_owner(spark, path, owner)
    ST.append(rows.filter((F.col("user_id") == owner) & (F.col("id") % 3 == 0)), path)
    ST.compact(spark, path, owner)
    return (
        ST.read(spark, path)
        .groupBy((F.col("user_id") == owner).cast("int").alias("of_owner"), "predicted_class")
        .agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    )


def incident_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored incident by owner and id: only the owner's bucket is read."""
    path = scratch_path(spark, "incidents")
    ST.append(FR.incidents(spark, sf_dir), path)
    first = audit_events(spark, sf_dir).agg(F.min(F.struct("user_id", "event_id")).alias("k")).first().k
    found = ST.read(spark, path, first.user_id).filter(F.col("id") == first.event_id)
    return found.select("id", "user_id", "event_name", "principal", "predicted_class", "confidence")


def cached_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability out of a parquet copy that is made once and then reused."""
    table = f"{sf_dir}/events.parquet"

    def build() -> DataFrame:
        return audit_events(spark, sf_dir).select("event_id", "label")

    LD.cached_copy(spark, table, {"labels": "label"}, build)
    return LD.availability(LD.cached_copy(spark, table, {"labels": "label"}, build))


# --- streams ---------------------------------------------------------------------


#: Minutes that a delivery may lie behind the latest event before it, two days.
DELIVERY_LOOK_BACK = 2 * 24 * 60
#: Files of one micro-batch, which bounds what a stateful task holds at a time.
FILES_PER_BATCH = 64


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.audit_stream(spark, f"{sf_dir}/events.parquet", FILES_PER_BATCH)


def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = jobs.score(_stream(spark, sf_dir)).select(
        "event_id", "predicted_class", "confidence", "action_status"
    )
    return spark.read.parquet(jobs.run_to_table(scored, "scored"))


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered twice and scored once."""
    events = _stream(spark, sf_dir)
    once = jobs.without_duplicates(events.unionByName(_stream(spark, sf_dir)))
    scored = jobs.score(once).select("event_id", "predicted_class", "confidence")
    return spark.read.parquet(jobs.run_to_table(scored, "deduped"))


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in four deliveries, some twice, some a delivery later, some only then.

    The stream stops and goes on between deliveries. Every delivery is scored, a duplicate or
    late; only what is scored has a class.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    first = F.least(F.lit(3), F.floor((F.dayofmonth("ts") - 1) / 8))
    after, number = F.least(F.lit(3), first + 1), F.col("event_id")
    arrivals = F.filter(
        F.array(
            F.when(number % 11 == 0, after).otherwise(first),
            F.when(number % 5 == 0, first),
            F.when(number % 7 == 0, after),
        ),
        lambda a: a.isNotNull(),
    )
    delivered = events.withColumn("arrival", F.explode(arrivals))
    inbox, path = scratch_path(spark, "inbox"), scratch_path(spark, "settled")
    for arrival in range(4):
        delivered.filter(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(inbox)
        arriving = jobs.audit_stream(spark, inbox)
        suppression.run(arriving, path, DELIVERY_LOOK_BACK)
    settled = suppression.deliveries(spark, path, arriving)
    outcome = settled.groupBy("event_id", "outcome").agg(F.sum("deliveries").alias("deliveries"))
    once = jobs.score(settled.filter(F.col("outcome") == suppression.SCORED))
    scored = once.select("event_id", F.col("outcome"), "predicted_class")
    return outcome.join(scored, ["event_id", "outcome"], "left").select(
        "event_id", "outcome", "deliveries", F.coalesce("predicted_class", F.lit(-1)).alias("predicted_class")
    )


def stream_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of all gated verdicts, five per tenant and ten minutes."""
    gated = jobs.score(_stream(spark, sf_dir)).filter("gated")
    confirmations = gated.select(
        F.col("recipientAccountId").alias("tenant"), "event_id",
        times.micros(F.col("event_time")).alias("time_us"),
    )
    decided = spark.read.parquet(jobs.run_to_table(admit(confirmations), "admitted"))
    return decided.withColumns({c: F.col(c).cast("int") for c in ("admitted", "late")})


def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents stored by one stream, their confirmations and reversals by another."""

    def arriving() -> DataFrame:
        scored = jobs.score(_stream(spark, sf_dir)).withColumn("principal", X.principal())
        return ST.from_verdicts(scored, FR.incident_source())

    path = jobs.store_incidents(arriving())
    jobs.store_changes(FR.changes_of(arriving()), path)
    state = ST.latest_state(ST.read(spark, path), ST.read_changes(spark, path))
    return state.select(
        "id", "user_id", "action_status", F.coalesce("rollback", F.lit("")).alias("rollback")
    )


QUERIES = {
    f.__name__: f
    for f in (
        ingest_json, ingest_large_exports, ingest_shapes, ingest_mixed, ingest_documents_quarantine, ingest_errors,
        labelled_file, labelled_training, ingest_jsonl, ingest_csv, ingest_quarantine, line_numbers, poll_payloads,
        ingest_fallback, file_size_cap,
        export_csv, export_json, export_summary, append_incidents, cleared_incidents,
        removed_then_stored, merged_events, incident_lookup,
        cached_dataset,
        stream_scoring, stream_dedupe, stream_late, stream_cap, stream_lifecycle,
    )
}
