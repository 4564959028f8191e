"""The registered queries of this folder: thin calls of the operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from auditlens.llm import (
    alignment,
    conversations,
    decontam,
    embed_dedup,
    html_blocks,
    interpolation,
    language,
    pieces,
    pii,
    quality,
    sharding,
    simhash,
    substring,
)
from auditlens.llm.common import table
from auditlens.session import materialise

VOCABULARY = "piece_bpe_32k.model"


def vocabulary(path: str | None = None) -> bytes:
    return pieces.read_model(path or public_tokenizers.path(VOCABULARY))


def written(name: str) -> Callable[[DataFrame], DataFrame]:
    """Stores what it is given as a table in the shared folder and reads it back."""
    return lambda df: materialise(df, name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.page_texts(table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_report(table(spark, sf_dir, "embeddings"), written("vectors"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), vocabulary())


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeat_report(table(spark, sf_dir, "documents"), written("stretches"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), written("measured")
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_report(table(spark, sf_dir, "documents"), written("prints"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repair_report(rows, written("fragments"))


def op12_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score_report(table(spark, sf_dir, "documents"), written("counted"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    both = alignment.Vocabularies.read(path("byte_bpe_50k.json"), path(VOCABULARY))
    return alignment.alignment_report(table(spark, sf_dir, "documents"), both, written("aligned"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_html_extraction,
        op2_sharding,
        op3_decontamination,
        op4_personal_data,
        op5_embedding_dedup,
        op6_pieces,
        op7_substring_dedup,
        op8_quality,
        op9_language,
        op10_simhash_dedup,
        op11_conversation_repair,
        op12_interpolation,
        op13_alignment,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": decontam.ORACLE,
    "op5_embedding_dedup": embed_dedup.ORACLE,
    "op7_substring_dedup": substring.ORACLE,
}
