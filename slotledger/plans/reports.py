"""The period report: which sheets it has, with the headings they are shown under."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.functions.periods import resolve_period
from slotledger.operators import utilization as U
from slotledger.operators.bookings import within
from slotledger.operators.presence import mark_columns, presence_matrix
from slotledger.schemas import Settings

_MEANS = {"desk_util": "Avg Desk Util", "parking_util": "Avg Parking Util"}
_HEADINGS = {
    "summary": {"metric": "Metric", "value": "Value"},
    "daily_week": {
        "date": "Date", "day": "Day", "shift": "Shift", "hours": "Hours",
        "desk_util": "Desk Util", "parking_util": "Parking Util",
    },
    "daily_month": {"date": "Date", "day": "Day", **_MEANS},
    "weekly_agg": {"week": "Week", "week_start": "Starting", **_MEANS},
    "monthly_agg": {"month": "Month", **_MEANS},
}


def _shown(sheet: DataFrame, headings: dict[str, str]) -> DataFrame:
    return sheet.select(*(F.col(name).alias(heading) for name, heading in headings.items()))


def _summary_sheet(bookings: DataFrame, employees: DataFrame, settings: Settings, period: str, ref: str) -> DataFrame:
    rows = U.summary(bookings, employees, settings, period, ref).orderBy("ordinal")
    number = F.col("value_num")
    written = F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    value = F.coalesce("value_text", written)
    return _shown(rows.withColumn("value", value), _HEADINGS["summary"])


def _presence_sheet(bookings: DataFrame, employees: DataFrame, settings: Settings, period: str, ref: str) -> DataFrame:
    rows = presence_matrix(bookings, employees, settings, period, ref).orderBy("ordinal")
    label = "%a %d" if period == "week" else "%d"
    headings = {"name": "Employee"}
    if period == "week":
        headings["shift"] = "Shift"
    headings |= {name: day.strftime(label) for name, day in mark_columns(*resolve_period(period, ref)).items()}
    return _shown(rows, {**headings, "total": "Total", "target": "Target", "met": "Met?"})


def report_sheets(
    bookings: DataFrame, employees: DataFrame, settings: Settings, period: str, ref: str
) -> dict[str, DataFrame]:
    """The sheets of a period report, in order. Week and month list people; other periods only months."""
    kept = within(bookings, *resolve_period(period, ref))
    sheets = {"summary": _summary_sheet(kept, employees, settings, period, ref)}
    if period == "week":
        daily = U.in_report_order(U.daily_by_shift(kept, settings, ref))
        sheets["daily"] = _shown(daily, _HEADINGS["daily_week"])
    elif period == "month":
        weekly = U.in_report_order(U.weekly_means(kept, settings, ref))
        sheets["weekly_agg"] = _shown(weekly, _HEADINGS["weekly_agg"])
        daily = U.in_report_order(U.daily_means(kept, settings, ref))
        sheets["daily"] = _shown(daily, _HEADINGS["daily_month"])
    else:
        monthly = U.in_report_order(U.monthly_means(kept, settings, period, ref))
        sheets["monthly_agg"] = _shown(monthly, _HEADINGS["monthly_agg"])
        return sheets
    sheets["presence"] = _presence_sheet(kept, employees, settings, period, ref)
    return sheets
