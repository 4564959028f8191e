"""Every registered query with SQL against DuckDB, and plan properties."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry_point

QUERIES = entry_point.queries()
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is None, v if v is not None else 0) for v in r])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    plan = _plan(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    columns = sorted(df.columns)
    got = _sorted([tuple(_plain(r[c]) for c in columns) for r in df.collect()])
    result = duck.sql(SQL[name])
    assert sorted(result.columns) == columns
    order = [list(result.columns).index(c) for c in columns]
    want = _sorted([tuple(_plain(r[i]) for i in order) for r in result.fetchall()])
    assert got == want


def test_entry(spark):
    assert entry_point.entry(spark).count() == 5


def test_scan_reads_only_what_the_query_needs(spark, sf_dir):
    plan = _plan(QUERIES["class_lookup"](spark, sf_dir))
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "value" not in schema and "ts:" not in schema


def test_verdicts_need_no_shuffle(spark, sf_dir):
    plan = _plan(QUERIES["auto_contained"](spark, sf_dir))
    assert "Exchange" not in plan and len(plan) < 60_000


@pytest.mark.parametrize("name", ["capped_threats", "incident_list", "incident_report"])
def test_limits_per_group_are_cut_before_the_shuffle(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert "WindowGroupLimit" in plan.split("Exchange")[-1]


@pytest.mark.parametrize("name", ["latest_20", "first_n_events"])
def test_limits_do_not_sort_everything(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in _plan(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize(
    ("name", "scans"),
    [("cv_summary", 2), ("recipe_delta", 1), ("pooled_class_f1", 2), ("protected_names", 1),
     ("campaign_rollup", 0), ("replay_timeline", 0), ("gate_decisions", 1), ("poll_summary", 1)],
)
def test_events_are_scanned_once(spark, sf_dir, name, scans):
    """Samples and containments are tables of their own by then."""
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert plan.count("events.parquet]") <= scans


def test_look_ups_prune_to_the_owner_bucket(spark, sf_dir):
    plan = _plan(QUERIES["incident_lookup"](spark, sf_dir))
    assert "PartitionFilters: [isnotnull(owner_bucket" in plan
