"""A part of the registered queries against their SQL at the smallest scale (tools/check_oracle.py runs all of them)."""

import os

import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, rows

SF = "/root/testdata/sf0.001"
QUICK = ["profile_orders", "row_hash_multiset_orders", "table_fingerprints", "totals_rows_planted", "duplicates_split_orders", "quantiles_lineitem",
         "aggregate_tool", "scalars_orders", "line_blocks_documents", "postings_documents", "read_window", "budgeted_sources", "mentions_planted",
         "count_rules_lineitem", "repairs_planted", "row_difference_lineitem", "lineage_formulas", "sql_views", "sql_functions", "capped_read",
         "inventory_documents", "incremental_reuse", "runlog_root_cause", "grid_values"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("the given tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark, duck):
    assert entry.entry(spark).count() == 6


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names) and got == rows(names, cur.fetchall())
