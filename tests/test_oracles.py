"""Every registered query against its DuckDB twin."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as contract
from driftlog.plans.oracles import ORACLES
from driftlog.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
# Ordered operators whose chunk borders must not show in the result.
CHUNKED = [
    "validate_timeline", "validate_spool", "validate_records", "validate_for_summary", "schema_audit",
    "append_admission", "live_continuity", "resume_plan", "matched_edits", "assembled_timeline",
    "operation_chain", "path_history", "debounce_with_commands", "latency_statistics", "timeline_scan",
    "timeline_export",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for file in os.listdir(SMALL):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SMALL}/{file}'")
    return con


def compare(spark, duck, name):
    df = contract.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    result = duck.sql(contract.oracle_sql()[name])
    names = list(result.columns)
    assert sorted(names) == columns
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", CHUNKED)
def test_query_with_small_chunks(spark, duck, small_chunks, name):
    compare(spark, duck, name)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
