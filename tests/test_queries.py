"""Every core query over the smallest tables: against its SQL where it has one, else that it runs and has its columns."""

import importlib
import re
from pathlib import Path

import pytest
from conftest import same_as_sql

from tallyrill.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.sql()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    if name in SQL:
        same_as_sql(df, SQL[name], data)
    else:
        df.collect()


def test_sql_belongs_to_queries():
    assert SQL.keys() <= QUERIES.keys()


def test_entry(spark, data):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).columns == ["source", "pattern_name", "severity", "verdict", "n_documents"]
    assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().keys() <= entry.queries().keys()


def test_core_stands_alone():
    """Nothing outside the subpackage imports it."""
    root = Path(__file__).parents[1] / "tallyrill"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"tallyrill\.llm|from \.+llm", path.read_text()), path


def test_heavy_query_moves_blocks_only(spark, data):
    plan = QUERIES["p3_found"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange ") == 2 and "Broadcast" not in plan and "ReadSchema: struct<session_id:string,line_no:bigint,server_name:string,tool_name:string>" in plan
