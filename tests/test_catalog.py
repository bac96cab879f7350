import pytest

import __spark_entry__ as entry
from ledgerflow.plans import catalog
from tests.compare import rows_of_duckdb, rows_of_spark


#: Queries that read or write bytes in Python.
IN_PYTHON = {"event_codecs", "job_log_source"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, data, name):
    found = catalog.QUERIES[name](spark, data)
    assert rows_of_spark(found) == rows_of_duckdb(catalog.ORACLE[name], data)
    if name not in IN_PYTHON:  # hot paths stay in the JVM
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, data):
    plan = catalog.QUERIES["job_count_filtered"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan
    plan = catalog.QUERIES["job_claim_topk"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_credits_limit_rows_before_the_shuffle(spark, data):
    plan = catalog.QUERIES["credit_limited"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
