"""Report periods: which dates they span, and which shifts are worked on a date."""

from __future__ import annotations

import datetime as dt
from calendar import monthrange

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotledger.schemas import SHIFTS, WEEKDAY_SHIFTS, WEEKEND_SHIFTS

# Length in months of each calendar period. Any other name than these and "week" means the calendar year.
MONTHS = {"month": 1, "quarter": 3}
YEAR_MONTHS = 12


def parse_date(text: Column, today: Column | None = None) -> Column:
    """An ISO date, zero padding optional; today where it does not parse."""
    parsed = F.when(text.rlike(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), F.try_to_date(text, "yyyy-M-d"))
    return F.coalesce(parsed, F.current_date() if today is None else today)


def period_start(period: Column, ref: Column) -> Column:
    """First date of the period holding ``ref``. Period names are case-sensitive."""
    return (
        F.when(period == "week", F.date_sub(ref, F.weekday(ref)))
        .when(period == "month", F.trunc(ref, "MM").cast("date"))
        .when(period == "quarter", F.trunc(ref, "QUARTER").cast("date"))
        .otherwise(F.trunc(ref, "YEAR").cast("date"))
    )


def period_end(period: Column, ref: Column) -> Column:
    """Last date of the period holding ``ref``."""
    start = period_start(period, ref)
    months = F.when(period == "month", MONTHS["month"]).when(period == "quarter", MONTHS["quarter"])
    last_month = F.add_months(start, F.coalesce(months, F.lit(YEAR_MONTHS)) - 1)
    return F.when(period == "week", F.date_add(start, 6)).otherwise(F.last_day(last_month))


def resolve_period(period: str, ref: str | None, today: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """The same bounds as plain dates, so that a report can put literal bounds into its scan."""
    year, month, day = _date_parts(ref) or (today or dt.date.today()).timetuple()[:3]
    if period == "week":
        ref_day = dt.date(year, month, day)
        monday = ref_day - dt.timedelta(days=ref_day.isoweekday() - 1)
        return monday, monday + dt.timedelta(days=6)
    span = MONTHS.get(period, YEAR_MONTHS)
    first = month - (month - 1) % span
    last = first + span - 1
    return dt.date(year, first, 1), dt.date(year, last, monthrange(year, last)[1])


def _date_parts(ref: str | None) -> tuple[int, int, int] | None:
    pieces = (ref or "").split("-")
    sizes = [len(piece) for piece in pieces]
    if len(pieces) != 3 or sizes[0] != 4 or not 1 <= sizes[1] <= 2 or not 1 <= sizes[2] <= 2:
        return None
    if not all(piece.isascii() and piece.isdigit() for piece in pieces):
        return None
    year, month, day = map(int, pieces)
    if year < 1 or not 1 <= month <= 12 or not 1 <= day <= monthrange(year, month)[1]:
        return None
    return year, month, day


def worked_shifts(date: Column) -> Column:
    """The shifts worked on a date, as an array in display order."""
    weekend = F.array(*map(F.lit, WEEKEND_SHIFTS))
    weekday = F.array(*map(F.lit, WEEKDAY_SHIFTS))
    return F.when(F.weekday(date) >= 5, weekend).otherwise(weekday)


def is_worked(date: Column, shift: Column) -> Column:
    """Whether reports count this shift on this date."""
    return F.when(F.weekday(date) >= 5, shift.isin(*WEEKEND_SHIFTS)).otherwise(shift.isin(*WEEKDAY_SHIFTS))


def shift_order(shift: Column) -> Column:
    """Position of a shift in display order."""
    return F.array_position(F.array(*map(F.lit, SHIFTS)), shift)
