"""The registered queries against their SQL, and against one another."""

import duckdb
import pytest

import __spark_entry__
from auditlens.llm import queries

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same(spark, sf_dir, name):
    with duckdb.connect() as db:
        for table in TABLES:
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        result = db.sql(queries.ORACLE_SQL[name])
        columns = result.columns
        expected = sorted(result.fetchall())
    found = queries.QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, found)) == expected


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op11_conversation_repair"}))
def test_a_row_for_every_row(spark, sf_dir, name):
    table = {"op1_html_extraction": "pages", "op5_embedding_dedup": "embeddings"}.get(
        name, "documents"
    )
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    expected = rows.count()
    assert queries.QUERIES[name](spark, sf_dir).count() == expected
