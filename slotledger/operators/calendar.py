"""The calendar side of every report: dates, and the shifts worked on them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.functions.periods import parse_date, period_end, period_start, worked_shifts


def date_series(spark: SparkSession, start: dt.date | Column, end: dt.date | Column) -> DataFrame:
    """Every date from start to end, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))


def with_worked_shifts(dates: DataFrame) -> DataFrame:
    """One row per date and shift worked on it."""
    return dates.select("date", F.explode(worked_shifts(F.col("date"))).alias("shift"))


def shift_calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """The date and shift cells a report over this period has, at most three per day."""
    return with_worked_shifts(date_series(spark, start, end))


def span_calendar(facts: DataFrame, column: str = "date") -> DataFrame:
    """The date and shift cells from the first to the last date present in a table."""
    span = facts.agg(F.min(column).cast("date").alias("lo"), F.max(column).cast("date").alias("hi"))
    return with_worked_shifts(
        span.where(F.col("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi")).alias("date"))
    )


def resolve_periods(requests: DataFrame, today: Column | None = None) -> DataFrame:
    """Add start_date and end_date to report requests ``(period, ref)``; a bad ref means today."""
    ref = parse_date(F.col("ref"), today)
    return requests.select(
        "*",
        period_start(F.col("period"), ref).alias("start_date"),
        period_end(F.col("period"), ref).alias("end_date"),
    )
