"""Utilization of desks and parking, from shift level up to months.

Everything rolls up from integer counts per date and shift. The mean of fractions that share one capacity equals the
summed counts over capacity times shift-days, so each report divides once and does not depend on the order of addition.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.functions.periods import resolve_period, shift_order
from slotledger.operators.bookings import applicable, within
from slotledger.operators.calendar import shift_calendar
from slotledger.schemas import KINDS, SHIFT_HOURS, Settings

DIGITS = 6


def complete_counts(bookings: DataFrame, calendar: DataFrame) -> DataFrame:
    """Desks and parking spots held per (date, shift) of a calendar, zero where nothing is held.

    The calendar's cells are added as zeros to the bookings themselves, so the grid is complete after one aggregate:
    partial counts in every task, then a single shuffle of at most a row per task and cell.
    """
    zero = F.lit(0).cast("bigint")
    held = applicable(bookings).select(
        "date", "shift", *((F.col("kind") == kind).cast("bigint").alias(kind) for kind in KINDS)
    )
    cells = calendar.select("date", "shift", *(zero.alias(kind) for kind in KINDS))
    return held.unionByName(cells).groupBy("date", "shift").agg(*(F.sum(kind).alias(kind) for kind in KINDS))


def period_counts(bookings: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """``complete_counts`` of one report period."""
    return complete_counts(within(bookings, start, end), shift_calendar(bookings.sparkSession, start, end))


def share(held: Column, capacity: int, cells: Column) -> Column:
    """Part of the capacity that is held over so many shifts; zero where there is no capacity."""
    if not capacity:
        return F.lit(0.0)
    return F.round(held.cast("double") / (F.lit(capacity) * cells).cast("double"), DIGITS)


def _shares(settings: Settings, cells: Column) -> list[Column]:
    return [
        share(F.col("desks"), settings.desks, cells).alias("desk_util"),
        share(F.col("parking"), settings.parking, cells).alias("parking_util"),
    ]


def shift_utilization(counts: DataFrame, settings: Settings) -> DataFrame:
    """Utilization of each worked shift, empty ones included."""
    return counts.select("date", "shift", *_shares(settings, F.lit(1)))


def rollup_utilization(counts: DataFrame, settings: Settings, *by: Column | str) -> DataFrame:
    """Mean utilization over the shift-days of each bucket, and their number."""
    sums = counts.groupBy(*by).agg(
        F.sum("desks").alias("desks"), F.sum("parking").alias("parking"), F.count("*").alias("shift_days")
    )
    kept = [c for c in sums.columns if c not in ("desks", "parking", "shift_days")]
    return sums.select(*kept, "shift_days", *_shares(settings, F.col("shift_days")))


def daily_by_shift(bookings: DataFrame, settings: Settings, ref: str) -> DataFrame:
    """Week report: a row per date and worked shift."""
    start, end = resolve_period("week", ref)
    hours = F.create_map(*(F.lit(part) for pair in SHIFT_HOURS.items() for part in pair))
    return shift_utilization(period_counts(bookings, start, end), settings).select(
        "date",
        F.date_format("date", "EEE").alias("day"),
        "shift",
        hours[F.col("shift")].alias("hours"),
        "desk_util",
        "parking_util",
    )


def daily_means(bookings: DataFrame, settings: Settings, ref: str) -> DataFrame:
    """Month report: a row per date, averaged over its shifts."""
    start, end = resolve_period("month", ref)
    daily = rollup_utilization(period_counts(bookings, start, end), settings, "date")
    return daily.select("date", F.date_format("date", "EEE").alias("day"), "desk_util", "parking_util")


def weekly_means(bookings: DataFrame, settings: Settings, ref: str) -> DataFrame:
    """Month report: Monday weeks that touch the month, averaged over the part of them inside it."""
    start, end = resolve_period("month", ref)
    first_week = start - dt.timedelta(days=start.weekday())
    monday = F.date_sub("date", F.weekday("date"))
    weekly = rollup_utilization(period_counts(bookings, start, end), settings, monday.alias("week_start"))
    number = (F.datediff("week_start", F.lit(first_week)) / 7).cast("int") + 1
    return weekly.select(
        F.concat(F.lit("Week "), number.cast("string")).alias("week"), "week_start", "desk_util", "parking_util"
    )


def monthly_means(bookings: DataFrame, settings: Settings, period: str, ref: str) -> DataFrame:
    """Quarter and year report: a row per month."""
    start, end = resolve_period(period, ref)
    first = F.trunc("date", "MM").cast("date").alias("month_start")
    monthly = rollup_utilization(period_counts(bookings, start, end), settings, first)
    return monthly.select(
        F.date_format("month_start", "MMMM yyyy").alias("month"), "month_start", "desk_util", "parking_util"
    )


def in_report_order(rows: DataFrame) -> DataFrame:
    """Order a report sheet by date and, where it has one, by shift in display order."""
    date = next(c for c in ("date", "week_start", "month_start") if c in rows.columns)
    shift = [shift_order(F.col("shift"))] if "shift" in rows.columns else []
    return rows.orderBy(date, *shift)


def summary(bookings: DataFrame, employees: DataFrame, settings: Settings, period: str, ref: str) -> DataFrame:
    """The nine headline figures of a period, as ``(metric, value_text, value_num)``.

    Bookings and employees are reduced to partial counts side by side and merged in a single row. Capacity counts
    every worked shift of the period, booked or not.
    """
    start, end = resolve_period(period, ref)
    held = applicable(within(bookings, start, end)).select(
        (F.col("kind") == "desks").cast("bigint").alias("desks"),
        (F.col("kind") == "parking").cast("bigint").alias("parking"),
        F.lit(0).cast("bigint").alias("people"),
        F.lit(0).cast("bigint").alias("cells"),
    )
    people = _tally(employees, "people")
    cells = _tally(shift_calendar(bookings.sparkSession, start, end), "cells")
    totals = (
        held.unionByName(people)
        .unionByName(cells)
        .agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("desks", "parking", "people", "cells")))
    )

    def row(ordinal: int, metric: str, text: str | None = None, number: Column | None = None) -> Column:
        return F.struct(
            F.lit(ordinal).alias("ordinal"),
            F.lit(metric).alias("metric"),
            F.lit(text).cast("string").alias("value_text"),
            (F.lit(None) if number is None else number).cast("double").alias("value_num"),
        )

    rows = [
        row(1, "Period", text=period.capitalize()),
        row(2, "Range", text=f"{start.isoformat()} to {end.isoformat()}"),
        row(3, "Total desks", number=F.lit(settings.desks)),
        row(4, "Total parking", number=F.lit(settings.parking)),
        row(5, "Employees", number=F.col("people")),
        row(6, "Desk bookings", number=F.col("desks")),
        row(7, "Parking bookings", number=F.col("parking")),
        row(8, "Avg desk utilization", number=share(F.col("desks"), settings.desks, F.col("cells"))),
        row(9, "Avg parking utilization", number=share(F.col("parking"), settings.parking, F.col("cells"))),
    ]
    return totals.select(F.inline(F.array(*rows)))


def _tally(rows: DataFrame, column: str) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return rows.select(
        *(
            (F.lit(1).cast("bigint") if name == column else zero).alias(name)
            for name in ("desks", "parking", "people", "cells")
        )
    )
