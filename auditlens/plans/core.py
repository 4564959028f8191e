"""Registered queries: features, lookups, verdicts, gates, triage, incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions import labels as L
from auditlens.functions import scoring as S
from auditlens.functions import text as X
from auditlens.functions import times
from auditlens.functions.features import with_features
from auditlens.operators import admission as AD
from auditlens.operators import attributions as AT
from auditlens.operators import campaigns as CP
from auditlens.operators import gate as G
from auditlens.operators import triage as TR
from auditlens.operators.ranking import samples_per_class
from auditlens.plans import frames as FR
from auditlens.session import materialise, scratch_path
from auditlens.sources import incidents as ST
from auditlens.sources import ingest as IN
from auditlens.sources import labelled as LD
from auditlens.sources.adapter import audit_events

FLAGS = [
    f
    for f in K.FEATURES
    if f not in K.PASS_THROUGH_DEFAULTS
    and f not in ("resource_entropy", "anomaly_aggregate_score")
]


def features_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.round(F.col(f), 6).alias(f) for f in K.PASS_THROUGH_DEFAULTS]
    return FR.featured(spark, sf_dir).select("event_id", *cols)


def features_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.featured(spark, sf_dir).select(
        "event_id", *[F.col(f).cast("int").alias(f) for f in FLAGS]
    )


def features_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.featured(spark, sf_dir).select(
        "event_id", F.round("anomaly_aggregate_score", 6).alias("anomaly_aggregate_score")
    )


def resource_entropy_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.featured(spark, sf_dir).select(
        "event_id", F.round("resource_entropy", 6).alias("resource_entropy")
    )


def resource_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the event names of every user, by two partial aggregations."""
    counts = audit_events(spark, sf_dir).groupBy("user_id", "eventName").agg(
        F.count("*").cast("double").alias("n")
    )
    # -sum(p log2(p + e)) over p = n/total needs total first: one row per user and name.
    total = counts.groupBy("user_id").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return (
        counts.join(total, "user_id")
        .groupBy("user_id")
        .agg(F.round(F.sum(-share * F.log2(share + F.lit(1e-10))), 6).alias("resource_entropy"))
    )


def principal_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_events(spark, sf_dir).select("event_id", X.principal().alias("principal"))


def arn_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_events(spark, sf_dir).select(
        "event_id", X.strip_arn(F.col("userIdentity.arn")).alias("username")
    )


LABEL_CELLS = ("0", "4", "2", "C2", "C2: Vertical Escalation", " c 3", "2.7", "12", "C5", "2_x",
               "benign", "", " 1 ")


def label_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label cells of several shapes, chosen by what the event holds."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    cell = X.lookup(k % len(LABEL_CELLS), dict(enumerate(LABEL_CELLS)))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        cell.alias("label"),
        F.when(F.col("event_type") == "view", F.col("value") / 2).alias("threat_class"),
        F.when(F.col("event_type") == "click", F.col("user_id") % 7).alias("class"),
        (F.col("event_type") == "error").alias("y"),
    )
    return L.with_label(rows).select(
        "event_id",
        F.coalesce("label", F.lit(-1)).alias("label"),
        F.coalesce("label_key", F.lit("")).alias("label_key"),
    )


def class_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_events(spark, sf_dir).select(
        "event_id", "label", X.class_label(F.col("label")).alias("class_label")
    )


def severity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_events(spark, sf_dir).select(
        "event_id", X.severity(F.col("label")).alias("severity")
    )


def linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.verdicts(spark, sf_dir).select(
        "event_id", *S.PROBABILITIES, "predicted_class", "confidence"
    )


def threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        FR.verdicts(spark, sf_dir)
        .filter(F.col("predicted_class") != 0)
        .select("event_id", "predicted_class", "confidence")
    )


def auto_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        FR.verdicts(spark, sf_dir)
        .filter("gated")
        .select("event_id", "predicted_class", "confidence", "action_status")
    )


def rolling_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containments of the tenant in the last 600 s and the room left, per containment."""
    log = FR.containments(FR.verdicts(spark, sf_dir))
    contained = log.filter("admitted").select("event_id", "tenant", "time_us")
    return AD.with_room(contained, log, include_current=True).select(
        "event_id", "tenant", "recent_containments", "room"
    )


def containment_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every confirmation, whether the cap admitted it, and the room it found."""
    return FR.containments(FR.verdicts(spark, sf_dir)).select(
        "event_id", "tenant", F.col("admitted").cast("int").alias("admitted"), "room"
    )


def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = FR.judged(spark, sf_dir)
    return FR.decisions(rows, FR.containments(rows)).select(
        "event_id",
        "status",
        F.col("protected").cast("int").alias("protected"),
        F.col("blast_capped").cast("int").alias("blast_capped"),
        "recent_containments",
        "room",
        "reason",
    )


def protected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every protected name with the number of events of its principal."""
    names = G.protected_names(["u1", " U2 ", ""])
    table = spark.createDataFrame([(n,) for n in names], "name string")
    name = F.lower(X.strip_arn(X.principal()))
    seen = (
        audit_events(spark, sf_dir)
        .filter(G.is_protected(X.principal(), names))
        .groupBy(name.alias("name"))
        .agg(F.count("*").alias("n"))
    )
    return table.join(seen, "name", "left").select(
        "name", F.coalesce("n", F.lit(0)).alias("events")
    )


def manual_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    refusal = G.manual_refusal()
    return FR.verdicts(spark, sf_dir).select(
        "event_id",
        F.when(refusal.isNull(), 1).otherwise(0).alias("containment_triggered"),
        F.coalesce(refusal, F.lit("")).alias("refusal"),
    )


def confirm_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending verdicts when they are to be carried out, some minutes later.

    The containments admitted since count, so what was pending may be refused now.
    """
    rows = FR.judged(spark, sf_dir)
    log = FR.containments(rows)
    pending = FR.decisions(rows, log).filter(F.col("status") == "pending")
    later = F.col("time_us") + K.CONFIRMATION_DELAY_SECONDS * 1_000_000
    again = AD.with_room(
        pending.select(
            "event_id", "tenant", "principal", "predicted_class", "confidence",
            later.alias("at_us"),
        ),
        log,
        at_us="at_us",
    )
    return G.with_decision(again, G.protected_names()).select(
        "event_id", "room", (F.col("status") == "pending").cast("int").alias("confirmed")
    )


def action_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        FR.verdicts(spark, sf_dir)
        .groupBy("action_status", "predicted_class")
        .agg(F.count("*").alias("n"))
    )


def live_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row labels by state and decision, and what is still to be decided.

    The state is that of the containment table: what it admitted is contained or, where
    an analyst took it back, reversed.
    """
    judged = FR.judged(spark, sf_dir)
    log = FR.containments(judged)
    admitted = log.filter("admitted").select("event_id", F.lit(True).alias("_admitted"))
    state = F.when(F.col("_admitted"), X.lookup(F.col("userAgent"), FR.ANALYST))
    rows = (
        FR.decisions(judged, log)
        .join(admitted, "event_id", "left")
        .withColumn("state", F.coalesce(state, F.lit("")))
    )
    unresolved = (F.col("status") == "pending") & ~F.col("state").isin("contained", "reversed")
    return rows.select(
        "event_id", G.live_label().alias("live_label"), unresolved.cast("int").alias("unresolved")
    )


def containment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = G.containment_plan(FR.verdicts(spark, sf_dir).filter("gated"))
    return plan.withColumns(
        {c: F.coalesce(c, F.lit("")) for c in ("token_issued_before", "egress")}
    )


# --- triage -------------------------------------------------------------------


def triage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.summary(FR.triage_rows(spark, sf_dir))


def capped_summary(spark: SparkSession, sf_dir: str, max_rows: int = K.MAX_ROWS) -> DataFrame:
    """Totals where only the first rows are analysed, and whether any were left out."""
    return TR.summary(FR.triage_rows(spark, sf_dir), max_rows)


def upload_summaries(
    spark: SparkSession, sf_dir: str, incident_cap: int = K.INCIDENTS_PER_UPLOAD
) -> DataFrame:
    """Threats found per daily upload, and how many of them are stored as incidents."""
    rows = FR.triage_rows(spark, sf_dir)
    threats = F.count_if(F.col("error").isNull() & (F.col("predicted_class") != 0))
    found = rows.groupBy("upload").agg(
        F.count("*").alias("analyzed"), threats.alias("threats_detected")
    )
    stored = (
        TR.capped_threats(rows, "upload", cap=incident_cap)
        .groupBy("upload")
        .agg(F.count("*").alias("incidents_recorded"))
    )
    return found.join(stored, "upload", "left").withColumn(
        "incidents_recorded", F.coalesce("incidents_recorded", F.lit(0))
    )


def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.class_distribution(FR.triage_rows(spark, sf_dir)).select(
        "class_id", "class_label", "n", F.round("share", 6).alias("share")
    )


def triage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TR.result_rows(FR.triage_rows(spark, sf_dir))
    label = K.CLASS_LABELS
    return rows.select(
        "row",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        "event_name", "principal", "source_ip", "predicted_class", "class_label", "confidence",
        *[F.col("probabilities")[label[c]].alias(f"p{c}") for c in K.CLASS_IDS],
        "action",
    )


def triage_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lambda path: F.get_json_object("raw_log", path)
    return TR.error_rows(FR.triage_rows(spark, sf_dir)).select(
        "row", "error", raw("$.eventName").alias("raw_event"), raw("$.errorCode").alias("raw_code")
    )


def capped_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.capped_threats(FR.triage_rows(spark, sf_dir), "upload").select(
        "upload", "row", "position", "predicted_class"
    )


def top3_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = FR.verdicts(spark, sf_dir).select(
        "event_id", F.posexplode_outer(S.top_probabilities(3)).alias("pos", "t")
    )
    return ranked.select(
        "event_id",
        (F.col("pos") + 1).cast("bigint").alias("place"),
        F.col("t.class_id").alias("class_id"),
        F.col("t.probability").alias("probability"),
    )


# --- explanations -------------------------------------------------------------


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only gated rows are explained: the filter comes before the attributions."""
    return AT.with_linear_attributions(FR.verdicts(spark, sf_dir).filter("gated"))


def top_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The outer form: for the plain one Spark adds a filter on the array's size,
    # which works the attributions out once more.
    rows = _explained(spark, sf_dir).select("event_id", F.posexplode_outer("top").alias("pos", "t"))
    return rows.select("event_id", (F.col("pos") + 1).cast("bigint").alias("place"), "t.*")


def risk_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explained(spark, sf_dir).select("event_id", AT.driver_phrases().alias("drivers"))


def incident_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of all verdicts; a containment time is known for contained ones."""
    explained = AT.with_linear_attributions(FR.verdicts(spark, sf_dir))
    seconds = F.when(F.col("gated"), F.lit("0.25"))
    return explained.select("event_id", AT.summary_text(seconds).alias("summary"))


# --- incidents ----------------------------------------------------------------


def _flat_incidents(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "user_id",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"),
        "source", "event_name", "principal", "source_ip", "predicted_class", "class_label",
        "confidence", "action_status",
    )


def incident_list(
    spark: SparkSession, sf_dir: str, limit: int = K.INCIDENT_LIST_LIMIT
) -> DataFrame:
    return _flat_incidents(ST.newest(FR.incidents(spark, sf_dir), limit))


def incident_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first incident of every owner, in one aggregation."""
    rows = _flat_incidents(FR.incidents(spark, sf_dir))
    first = rows.groupBy("user_id").agg(F.min_by(F.struct("*"), "id").alias("first"))
    return first.select("first.*")


def incident_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored incidents with the stored changes applied."""
    path = scratch_path(spark, "incidents")
    ST.append(FR.incidents(spark, sf_dir), path)
    stored = ST.read(spark, path)
    ST.append_changes(FR.changes_of(stored), path)
    state = ST.latest_state(stored, ST.read_changes(spark, path))
    return state.select(
        "id", "user_id", "action_status", F.coalesce("rollback", F.lit("")).alias("rollback")
    )


def incident_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = ST.cards(FR.incidents(spark, sf_dir))
    return cards.withColumns(
        {
            c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
            for c in ("newest", "oldest")
        }
    )


def incident_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.distribution(FR.incidents(spark, sf_dir))


def incident_report(
    spark: SparkSession, sf_dir: str, limit: int = K.INCIDENT_LIST_LIMIT
) -> DataFrame:
    rows = ST.report_rows(ST.newest(FR.incidents(spark, sf_dir), limit))
    return rows.withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


def rescored_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events read back from their JSON, scored again beside the stored class."""
    schema = audit_events(spark, sf_dir).schema
    events = ST.stored_events(FR.incidents(spark, sf_dir), schema)
    again = S.linear_verdicts(with_features(events))
    return again.select("id", "stored_class", "predicted_class", "confidence", "action_status")


# --- labelled data -------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with label cells of which some cannot be used and some rows fail."""
    events = audit_events(spark, sf_dir)
    cells = events.withColumns(
        {
            "threat_class": F.when(F.col("eventName") != "ConsoleLogin", F.col("label")),
            "label": F.when(
                F.col("eventName") == "ListBuckets", F.lit("C0: Benign")
            ).otherwise(F.lit("n/a")),
            "event_time": F.when(
                ~F.col("userAgent").eqNullSafe(F.lit("")) | (F.col("eventName") != "PutObject"),
                F.col("event_time"),
            ),
        }
    )
    return LD.featurise(L.with_label(cells))


def class_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LD.availability(audit_events(spark, sf_dir))


def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LD.report(_labelled(spark, sf_dir), "event_id")


def dataset_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a set whose halves are raw events and ready feature rows."""
    raw = audit_events(spark, sf_dir).filter("event_id % 2 = 0")
    ready = FR.featured(spark, sf_dir).filter("event_id % 2 = 1").select(
        "event_id", "label", *K.FEATURES
    )
    parts = [
        LD.featurise(L.with_label(part)).select("event_id", "label", "label_key", "shape", "error")
        for part in (raw, ready)
    ]
    return LD.report(parts[0].unionByName(parts[1]), "event_id")


def dataset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of the whole set and of every user's rows taken as a set."""
    rows = _labelled(spark, sf_dir)
    used = F.col("label").isNotNull() & F.col("error").isNull()
    per_user = rows.groupBy("user_id").agg(
        F.count_if(used).alias("rows_used"),
        *[F.count_if(used & (F.col("label") == c)).alias(f"class_{c}") for c in K.CLASS_IDS],
    )
    return LD.check(per_user).select("user_id", "rows_used", "problem")


def training_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = LD.check(LD.report(_labelled(spark, sf_dir), "event_id"))
    usable = F.col("problem") == ""
    return report.select(
        F.lit("real").alias("requested_mode"),
        F.when(usable, "real").otherwise("none").alias("effective_mode"),
        F.col("problem").alias("fallback_reason"),
        "rows_total", "rows_used", "rows_skipped", "label_key", "shape",
        F.lit(f"damped class weights alpha={K.SERVED_ALPHA:g} (no SMOTE)").alias(
            "imbalance_strategy"
        ),
    )


# --- polls, limits ---------------------------------------------------------------


def _last_time(events: DataFrame):
    """The newest time of the log stands for 'now'; one aggregate, one value."""
    return F.lit(events.agg(F.max("event_time")).first()[0]).cast("timestamp_ntz")


def poll_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hour's newest 50 events with their decisions, summed up.

    All verdicts of a poll see one room: the one that the containments before it leave.
    Only the look-back time is scored; the room comes from the containment table.
    """
    log = FR.containments(FR.verdicts(spark, sf_dir))
    now = _last_time(audit_events(spark, sf_dir))
    polled = IN.look_back(
        FR.verdicts(spark, sf_dir), "event_time", now, minutes=60, limit=K.POLL_LIMIT
    )
    at_poll = AD.with_room(
        polled.withColumn("poll_us", times.micros(now)), log, at_us="poll_us", include_current=True
    )
    return G.with_decision(at_poll, G.protected_names()).agg(
        F.count("*").alias("events_seen"),
        F.count_if(F.col("status") == "pending").alias("pending_count"),
        F.coalesce(F.min("room"), F.lit(K.CONTAINMENT_CAP)).alias("blast_room"),
    )


def first_n_events(spark: SparkSession, sf_dir: str, limit: int = 100) -> DataFrame:
    """The first events by id; 0 means all."""
    rows = FR.verdicts(spark, sf_dir).select(
        "event_id", "predicted_class", "confidence", "action_status"
    )
    return rows.orderBy("event_id").limit(limit) if limit else rows


def terminal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.verdicts(spark, sf_dir).agg(
        F.count("*").alias("analyzed"),
        F.count("*").alias("total"),
        F.count_if(F.col("predicted_class") != 0).alias("threats"),
        F.count_if(F.col("predicted_class") == 0).alias("benign"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
    )


def latest_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        FR.verdicts(spark, sf_dir)
        .orderBy(F.desc("event_time"), F.desc("event_id"))
        .limit(20)
        .select("event_id", "predicted_class", "confidence")
    )


def action_set_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events semi-joined with the action sets kept as a table."""
    sets = [
        *[("sensitive", a) for a in K.SENSITIVE_PRIVILEGE_ACTIONS],
        *[("credential", a) for a in K.CREDENTIAL_ACCESS_ACTIONS],
        *[("lateral", a) for a in K.LATERAL_MOVEMENT_ACTIONS],
        *[("privileged", a) for a in K.PRIVILEGED_CALLS],
    ]
    table = F.broadcast(spark.createDataFrame(sets, "action_set string, eventName string"))
    return (
        audit_events(spark, sf_dir)
        .join(table, "eventName")
        .groupBy("action_set", F.col("eventName").alias("event_name"))
        .agg(F.count("*").alias("n"))
    )


# --- campaigns ---------------------------------------------------------------------


BASE_SEED, REPLAY_SEED = 42, 7


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event a class and seed, ten rows at most, fetched from the log once."""
    chosen = samples_per_class(
        audit_events(spark, sf_dir), "label", "event_id", (BASE_SEED, REPLAY_SEED)
    )
    return materialise(chosen.drop("event_id", "user_id"), "samples")


def _of_seed(samples: DataFrame, seed: int) -> DataFrame:
    return samples.filter(F.col("seed") == seed).drop("seed")


def _step_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _of_seed(_samples(spark, sf_dir), BASE_SEED)
    return CP.step_events(CP.steps(CP.catalogue(spark)), base)


def _campaign_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _step_events(spark, sf_dir).withColumns(
        {"truth": F.lit(None).cast("int"), "step_source": F.lit("synthetic")}
    )
    return CP.timeline(events)


def _replay_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay with a real event for every class but 3, which plays the catalogue."""
    samples = _samples(spark, sf_dir)
    replayed = _of_seed(samples, REPLAY_SEED).filter(F.col("label") != 3)
    base = _of_seed(samples, BASE_SEED)
    return CP.timeline(CP.replay_events(CP.steps(CP.catalogue(spark)), replayed, base))


def campaign_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first campaign of the catalogue, with the log's events of its actions."""
    campaign = CP.by_id(CP.catalogue(spark), K.CAMPAIGNS[0][0])
    names = F.broadcast(CP.steps(campaign).select(F.col("event_name").alias("eventName")).distinct())
    return (
        audit_events(spark, sf_dir)
        .join(names, "eventName")
        .groupBy(F.lit(K.CAMPAIGNS[0][0]).alias("campaign_id"), F.col("eventName").alias("event_name"))
        .agg(F.count("*").alias("n"))
    )


def campaign_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows with how many events of the log show each campaign's actions."""
    campaigns = CP.catalogue(spark)
    actions = campaigns.select(
        "campaign_id", F.explode(F.array_distinct("steps.event_name")).alias("eventName")
    )
    seen = (
        audit_events(spark, sf_dir)
        .join(F.broadcast(actions), "eventName")
        .groupBy("campaign_id")
        .agg(F.count("*").alias("matching_events"))
    )
    return CP.listing(campaigns).join(seen, "campaign_id", "left").select(
        "campaign_id", "name", "tactic", "step_count",
        F.array_join("techniques", ",").alias("techniques"),
        F.coalesce("matching_events", F.lit(0)).alias("matching_events"),
    )


def campaign_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _step_events(spark, sf_dir).select(
        "campaign_id", "step", "name", "technique_id", "seed_class",
        F.col("eventName").alias("event_name"), F.col("eventSource").alias("event_source"),
        X.principal().alias("principal"),
        F.col("userIdentity.userName").alias("user_name"),
        F.coalesce("userIdentity.mfaAuthenticated", F.lit("")).alias("mfa"),
        F.col("sourceIPAddress").alias("source_ip"),
        F.col("recipientAccountId").alias("recipient"),
    )


def campaign_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    explained = AT.with_linear_attributions(_campaign_verdicts(spark, sf_dir))
    return explained.select(
        "campaign_id", "step", F.col("eventName").alias("event_name"), "predicted_class",
        "class_label", "confidence", "action_status", "step_source",
        AT.summary_text().alias("summary"),
    )


def campaign_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CP.rollup(_replay_verdicts(spark, sf_dir))


def replay_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replay_verdicts(spark, sf_dir).select(
        "campaign_id", "step", F.col("eventName").alias("event_name"), "predicted_class",
        F.coalesce("truth", F.lit(-1)).alias("truth"),
        F.col("correct").cast("int").alias("correct"), "step_source",
    )


def replay_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CP.replay_accuracy(_replay_verdicts(spark, sf_dir))


def attack_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CP.attack_paths(FR.verdicts(spark, sf_dir).select("event_id", "predicted_class"))


QUERIES = {
    f.__name__: f
    for f in (
        features_core, features_flags, features_aggregate, resource_entropy,
        resource_entropy_list, principal_extract, arn_strip, label_coerce, class_lookup,
        severity_lookup, linear_scores, threats, auto_contained, rolling_cap, containment_admission, gate_decisions,
        protected_names, manual_gate, confirm_recheck, action_status, live_labels,
        containment_plan, triage_summary, capped_summary, upload_summaries, class_distribution, triage_rows, triage_errors,
        capped_threats, top3_probabilities, top_attributions, risk_drivers, incident_summaries,
        incident_list, incident_point, incident_latest_state, incident_cards,
        incident_distribution, incident_report, rescored_incidents, class_availability,
        dataset_report, dataset_mixed, dataset_checks, training_provenance, poll_summary, first_n_events,
        terminal_summary, latest_20, action_set_match, campaign_listing, campaign_by_id, campaign_steps,
        campaign_timeline, campaign_rollup, replay_timeline, replay_accuracy, attack_path,
    )
}
