import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from slotledger.functions.periods import resolve_period
from slotledger.operators import bookings as B
from slotledger.operators import calendar as C
from slotledger.operators import presence as P
from slotledger.operators import utilization as U
from slotledger.plans.reports import report_sheets
from slotledger.schemas import BOOKING, Settings
from slotledger.sinks.report import export_report

D = dt.date
TODAY = D(2026, 5, 5)
BOUNDS = [
    ("week", "2026-01-01", D(2025, 12, 29), D(2026, 1, 4)),
    ("month", "2026-12-15", D(2026, 12, 1), D(2026, 12, 31)),
    ("month", "2028-2-3", D(2028, 2, 1), D(2028, 2, 29)),
    ("quarter", "2026-11-05", D(2026, 10, 1), D(2026, 12, 31)),
    ("quarter", "2026-03-31", D(2026, 1, 1), D(2026, 3, 31)),
    ("Week", "2026-05-05", D(2026, 1, 1), D(2026, 12, 31)),
    ("foo", "2026-05-05", D(2026, 1, 1), D(2026, 12, 31)),
    ("week", "junk", D(2026, 5, 4), D(2026, 5, 10)),
    ("week", "", D(2026, 5, 4), D(2026, 5, 10)),
    ("week", "2026-02-30", D(2026, 5, 4), D(2026, 5, 10)),
    ("month", "2026-05-05x", D(2026, 5, 1), D(2026, 5, 31)),
    ("month", None, D(2026, 5, 1), D(2026, 5, 31)),
]


@pytest.mark.parametrize("period, ref, start, end", BOUNDS)
def test_period_bounds(period, ref, start, end):
    assert resolve_period(period, ref, TODAY) == (start, end)


def test_period_bounds_in_columns(spark):
    requests = spark.createDataFrame([b[:2] for b in BOUNDS], "period string, ref string")
    got = C.resolve_periods(requests, F.lit(TODAY))
    assert rows(got) == sorted(BOUNDS, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_calendar_sizes(spark):
    assert C.shift_calendar(spark, D(2026, 1, 5), D(2026, 1, 11)).count() == 17
    assert C.shift_calendar(spark, D(2026, 1, 1), D(2026, 12, 31)).count() == 887


@pytest.fixture(scope="module")
def office(spark):
    """A week with the odd cases: a slot past capacity, an unknown user, bookings on shifts not worked that day."""
    held = [
        (D(2026, 1, 5), "day", "desks", "1", "a"),
        (D(2026, 1, 5), "day", "desks", "99", "ghost"),
        (D(2026, 1, 5), "day", "parking", "1", "a"),
        (D(2026, 1, 6), "weekend", "desks", "1", "a"),
        (D(2026, 1, 6), "night", "parking", "2", "b"),
        (D(2026, 1, 10), "day", "desks", "1", "b"),
        (D(2026, 1, 10), "weekend", "desks", "1", "b"),
        (D(2026, 2, 2), "day", "desks", "1", "b"),
    ]
    people = [("a", 0, "Ann", "day", None), ("b", 1, "Bo", None, 3), ("c", 2, "Cy", "night", 0)]
    return (
        spark.createDataFrame(held, BOOKING),
        spark.createDataFrame(people, "id string, ordinal bigint, name string, shift string, target_days bigint"),
    )


def test_summary(office):
    got = {r["metric"]: (r["value_text"], r["value_num"]) for r in U.summary(*office, Settings(), "week", "2026-01-05").collect()}
    assert got == {
        "Period": ("Week", None),
        "Range": ("2026-01-05 to 2026-01-11", None),
        "Total desks": (None, 28.0),
        "Total parking": (None, 10.0),
        "Employees": (None, 3.0),
        "Desk bookings": (None, 3.0),
        "Parking bookings": (None, 2.0),
        "Avg desk utilization": (None, round(3 / 476, 6)),
        "Avg parking utilization": (None, round(2 / 170, 6)),
    }


def test_daily_rows_and_rollups_agree(office):
    held = office[0]
    daily = U.daily_by_shift(held, Settings(desks=1, parking=10), "2026-01-07").collect()
    assert len(daily) == 17
    monday = {r["shift"]: r for r in daily if r["date"] == D(2026, 1, 5)}
    assert monday["day"]["desk_util"] == 2.0 and monday["day"]["hours"] == "09:00-18:00" and monday["day"]["day"] == "Mon"
    weekly = rows(U.weekly_means(held, Settings(), "2026-01-15"))
    assert [r[:2] for r in weekly] == [(f"Week {n + 1}", D(2025, 12, 29) + dt.timedelta(days=7 * n)) for n in range(5)]
    assert weekly[1][2] == round(3 / 28 / 17, 6)
    monthly = rows(U.monthly_means(held, Settings(), "quarter", "2026-02-01"))
    assert [r[0] for r in monthly] == ["February 2026", "January 2026", "March 2026"]
    total = U.period_counts(held, D(2026, 1, 1), D(2026, 3, 31)).agg(F.sum("desks"), F.sum("parking")).first()
    assert tuple(total) == (4, 2)


def test_zero_capacity_gives_zero(office):
    empty = Settings(desks=0, parking=0)
    assert {tuple(r)[4:] for r in U.daily_by_shift(office[0], empty, "2026-01-05").collect()} == {(0.0, 0.0)}
    got = {r["metric"]: r["value_num"] for r in U.summary(*office, empty, "week", "2026-01-05").collect()}
    assert got["Avg desk utilization"] == got["Avg parking utilization"] == 0.0


def test_presence(office):
    held, people = office
    week = B.within(held, D(2026, 1, 5), D(2026, 1, 11))
    assert rows(P.presence_days(week, people), "id", "days_present") == [("a", 1), ("b", 2), ("c", 0)]
    matrix = P.presence_matrix(held, people, Settings(), "week", "2026-01-05").orderBy("ordinal").collect()
    assert [r["d_20260105"] for r in matrix] == ["X", "", ""]
    assert [(r["shift"], r["total"], r["target"], r["met"]) for r in matrix] == [
        ("day", 1, 2, "No"),
        ("", 2, 3, "No"),
        ("night", 0, 0, "Yes"),
    ]
    assert P.target_weeks("month", D(2026, 2, 1), D(2026, 2, 28)) == 4
    assert P.target_weeks("month", D(2028, 2, 1), D(2028, 2, 29)) == 5
    long = P.presence_long(held, people, D(2026, 1, 5), D(2026, 1, 11))
    assert long.count() == 21 and rows(long.where("mark = 'X'"), "id", "date") == [
        ("a", D(2026, 1, 5)),
        ("b", D(2026, 1, 6)),
        ("b", D(2026, 1, 10)),
    ]
    assert rows(B.dangling(held, people), "user_id") == [("ghost",)]


def test_nesting_round_trip_and_grid(office):
    held = office[0].withColumn("date_raw", F.when(F.col("user_id") == "ghost", "2026-1-7").otherwise(F.date_format("date", "yyyy-MM-dd")))
    held = held.withColumn("date", F.when(F.col("user_id") != "ghost", F.col("date")))
    columns = ("date", "date_raw", "shift", "kind", "slot", "user_id")
    for parts in (1, 3):
        assert rows(B.with_dates(B.flatten_bookings(B.nest_bookings(held, parts))), *columns) == rows(held, *columns)
    held = office[0]
    crowd = held.sparkSession.range(500).select(
        F.lit(D(2026, 1, 5)).alias("date"),
        F.lit("day").alias("shift"),
        F.lit("desks").alias("kind"),
        F.col("id").cast("string").alias("slot"),
        F.concat(F.lit("u"), "id").alias("user_id"),
    )
    for size in (5, 500):  # the shape depends on the argument, not on the number of slots
        assert B.nest_bookings(crowd.limit(size)).count() == 1 and B.day_image(crowd.limit(size)).count() == 1
    days = B.nest_bookings(crowd, 10)
    assert days.count() == 10 and rows(B.with_dates(B.flatten_bookings(days)).drop("date_raw")) == rows(crowd)
    assert B.day_image(crowd, 10).agg(F.sum(F.size("slots"))).first()[0] == 500
    dates = held.sparkSession.createDataFrame([(D(2027, 1, 1),)], "date date")
    grid = B.day_grid(held, dates)
    assert grid.count() == 8 * 5 and grid.agg(F.sum("held")).first()[0] == held.count()
    assert rows(B.day_image(held).where("kind = 'desks' and shift = 'day' and day = '2026-01-05'"), "image") == [
        ("1=a,99=ghost",)
    ]


def test_sheets_per_period(spark, office, tmp_path):
    expected = {
        "week": ["summary", "daily", "presence"],
        "month": ["summary", "weekly_agg", "daily", "presence"],
        "quarter": ["summary", "monthly_agg"],
        "year": ["summary", "monthly_agg"],
        "foo": ["summary", "monthly_agg"],
    }
    for period, names in expected.items():
        assert list(report_sheets(*office, Settings(), period, "2026-01-05")) == names
    folder = export_report(*office, Settings(), "week", "2026-01-07", str(tmp_path), "csv")
    assert folder.endswith("report-week-2026-01-05")
    assert export_report(*office, Settings(), "../x", "2026-01-07", f"{tmp_path}/in").endswith("/in/report-..%2Fx-2026-01-01")
    sheet = spark.read.option("header", True).csv(f"{folder}/presence")
    assert sheet.columns == ["Employee", "Shift", "Mon 05", "Tue 06", "Wed 07", "Thu 08", "Fri 09", "Sat 10", "Sun 11", "Total", "Target", "Met?"]
    daily = spark.read.option("header", True).csv(f"{folder}/daily").collect()
    assert [tuple(r)[:3] for r in daily[:2]] == [("2026-01-05", "Mon", "day"), ("2026-01-05", "Mon", "evening")]
    month = export_report(*office, Settings(), "month", "2026-01-07", str(tmp_path))
    assert spark.read.parquet(f"{month}/presence").columns[:2] == ["Employee", "01"]
    assert spark.read.parquet(f"{month}/summary").where("Metric = 'Desk bookings'").first()["Value"] == "3"
