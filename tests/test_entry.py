"""Registered queries on the smallest tables against their SQL."""

import collections
import os

import duckdb
import pytest

import __spark_entry__
from graphselect.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return collections.Counter(tuple(str(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", ["by_name_params", "nested_filters", "set_union", "hinted_flags", "virtual_edges", "compute_call_paths", "coarse_critical", "scc_membership", "common_caller", "common_caller_partial", "inline_compensation", "scope_gate", "trace_values", "address_asof", "json_filter_lines", "dot_lines", "recorded_within", "windowed_calls", "call_tree_log", "gnu_callbacks", "region_registrations", "set_dump", "symbol_sets", "mapped_symbols", "resolved_symbols"])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
