"""Ordered outputs read file by file, and many report requests against one report at a time."""

import datetime as dt

from pyspark.sql import functions as F

from slotledger.functions.periods import resolve_period
from slotledger.operators import report_requests, spots
from slotledger.operators import utilization as U
from slotledger.operators.feedback import current_feedback
from slotledger.plans import fixtures as X
from slotledger.schemas import SHIFTS, Settings
from slotledger.sinks import ordered

import pyarrow.parquet as pq


def in_file_order(path, *columns):
    files = sorted(path.glob("part-*.parquet"))
    return len(files), [tuple(r[c] for c in columns) for f in files for r in pq.read_table(f).to_pylist()]


def test_spots_feedback_and_shifts_are_written_in_order(spark, small, tmp_path):
    shown = spots.slot_status(spots.client_state(spots.spot_updates(X.commands(spark, small))), "e_7")
    odd = spark.createDataFrame([("desks", "x", "free", "", None), ("desks", "007", "free", "", 7)], shown.schema)
    ordered.write_spots(shown.unionByName(odd), str(tmp_path / "spots"), files=5)
    n, found = in_file_order(tmp_path / "spots", "type", "id", "position")
    key = lambda r: (r[0], r[2] is None, r[2] or 0, r[1])
    assert n > 1 and found == sorted(found, key=key) and len(found) == shown.count() + 2

    left = current_feedback(X.feedback_cmds(spark, small))
    ordered.write_feedback(left, str(tmp_path / "feedback"), files=4)
    n, found = in_file_order(tmp_path / "feedback", "seq")
    assert n > 1 and found == sorted(tuple(r) for r in left.select("seq").collect())

    held = X.bookings(spark, small)
    start, end = resolve_period("month", "1998-02-10")
    daily = U.shift_utilization(U.period_counts(held, start, end), Settings())
    ordered.write_shifts(daily, str(tmp_path / "shifts"), files=3)
    n, found = in_file_order(tmp_path / "shifts", "date", "shift")
    assert n > 1 and found == sorted(found, key=lambda r: (r[0], SHIFTS.index(r[1])))
    ordered.write_employees(X.employees(spark, small), str(tmp_path / "people"), files=3)
    _, found = in_file_order(tmp_path / "people", "ordinal")
    assert found == sorted(found)


def test_many_requests_give_what_single_reports_give(spark, small):
    held = X.bookings(spark, small).cache()
    asked = [("week", "1998-02-11"), ("month", "1998-02-10"), ("quarter", "1995-01-03"), ("year", "2001-06-01"), ("week", "1960-01-01"), ("month", "2030-05-05")]
    asked.append(asked[0])
    requests = spark.createDataFrame(asked, "period string, ref string")
    found = {(r.period, r.ref): r for r in report_requests.request_summaries(held, requests, Settings(28, 0)).collect()}
    assert len(found) == len(set(asked))
    for period, ref in set(asked):
        one = {r.metric: r.value_num for r in U.summary(held, held.limit(0), Settings(28, 0), period, ref).collect()}
        r = found[period, ref]
        assert (r.desks, r.parking, r.desk_util, r.parking_util) == (
            one["Desk bookings"], one["Parking bookings"], one["Avg desk utilization"], one["Avg parking utilization"],
        )
    assert report_requests.request_summaries(held, requests, Settings()).count() == len(asked)


def test_shifts_are_counted_by_arithmetic(spark):
    days = [dt.date(1969, 12, 1) + dt.timedelta(days=k) for k in range(60)]
    table = spark.createDataFrame([(d,) for d in days], "date date").select("date", report_requests.shifts_before(F.col("date")).alias("n"))
    found = {r.date: r.n for r in table.collect()}
    for a, b in zip(days, days[1:]):
        assert found[b] - found[a] == (1 if a.weekday() >= 5 else 3)
    assert found[report_requests.MONDAY] == 0
