"""Every registered query against its SQL, and the shape of the plans."""

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect
from slotledger.plans import fixtures as X
from slotledger.plans.catalog import QUERIES
from slotledger.plans.oracle import SQL


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, small, name):
    assert compare(spark, con, name, QUERIES[name], SQL[name], small) > 0


@pytest.mark.parametrize("name", ["commands", "commands_raw", "bookings", "bookings_raw", "employees", "config_cmds", "employee_cmds", "add_requests", "feedback_cmds"])
def test_inputs_match_sql(spark, con, small, name):
    from slotledger.plans.oracle import with_views

    compare(spark, con, name, getattr(X, name), with_views(f"select * from {name}", name), small)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 9


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", [n for n in QUERIES if "stream" not in n and "live" not in n])
def test_no_query_crosses_or_loops(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["bookings_flatten", "day_image"])
def test_nesting_reads_once(spark, small, name):
    text = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 2 and text.count("Join") == 1  # lineitem and its orders, in the fixture
    assert "ExistingRDD" not in text


def test_report_bounds_reach_the_scan(spark, small):
    text = plan(QUERIES["summary_month"](spark, small))
    scan = next(line for line in text.splitlines() if "PushedFilters" in line and "l_shipdate" in line)
    assert "GreaterThanOrEqual(l_shipdate,1998-02-01T00:00)" in scan and "LessThan(l_shipdate,1998-03-01T00:00)" in scan
    read = next(line for line in text.splitlines() if "ReadSchema" in line and "l_shipdate" in line)
    assert "l_extendedprice" not in read and "l_quantity" not in read


def test_stored_bookings_are_pruned_by_date(spark, small, tmp_path):
    from slotledger.operators import utilization as U
    from slotledger.schemas import Settings
    from slotledger.sinks.state import write_days

    write_days(X.bookings(spark, small), str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/version=0/bookings")
    text = plan(U.daily_means(stored, Settings(), "1998-02-10"))
    scan = next(line for line in text.splitlines() if "PartitionFilters" in line)
    assert "1998-02-01" in scan and "1998-02-28" in scan
    assert text.count("Exchange") < 12 and "Join" not in text


@pytest.mark.parametrize("name", ["bookings_applicable", "day_grid", "util_shift", "presence_matrix_month"])
def test_counting_hashes_rather_than_sorts(spark, small, name):
    assert "SortAggregate" not in plan(QUERIES[name](spark, small))
