"""From raw documents to token ids: five stages, each written before the next reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlens.llm import decontam, language, pieces, pii, simhash
from auditlens.llm.common import content_key, held_out, table
from auditlens.llm.queries import vocabulary, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (null texts, texts without letters) go."""
    known = language.learn(docs, ~held_out("doc_id"))
    found = language.identify(docs.select(*COLUMNS), known)
    return found.filter(F.col("found.language") != language.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, the one with the smallest doc_id.

    Rows without a doc_id come last, so one of them stays only if no row of their group has
    an id. Different texts under one doc_id are different rows: each group decides on its own.
    Among rows with the same id the text's hash decides, then lang and source.
    """
    keyed = docs.select(*COLUMNS, *content_key(F.struct("doc_id", "text")))
    groups = simhash.near_duplicates(keyed, written("prints"), keep=("_k1", "_k2"))
    row = F.struct(F.col("id").isNull().alias("none"), "id", "_k1", "_k2")
    first = groups.groupBy("root").agg(F.min(row).alias("row")).select("row._k1", "row._k2")
    one = Window.partitionBy("_k1", "_k2").orderBy("lang", "source")
    return (
        keyed.join(first, ["_k1", "_k2"], "left_semi")
        .withColumn("_n", F.row_number().over(one))
        .filter("_n = 1")
        .select(*COLUMNS)
    )


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    found = decontam.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks.hits") == 0).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars is the new length."""
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (packed, 32 bits each), and whether they decode to it."""
    encoded = pieces.encode_and_decode(docs.select(*COLUMNS), vocabulary())
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.col("pieces.n_tokens").alias("n_tokens"),
        F.col("pieces.ids").alias("ids"),
        (F.col("pieces.decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language identification", language_identification),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(f"stage{number}")(stage(spark, docs, sf_dir))
    return docs


#: Fingerprints and fitted prototypes cannot be expressed in SQL.
ORACLE_SQL = None
