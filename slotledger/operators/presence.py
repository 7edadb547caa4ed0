"""Who was in: presence days per employee, the matrix of marks, and target attainment."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.functions.periods import resolve_period
from slotledger.operators.bookings import applicable, within
from slotledger.schemas import KINDS, Settings

MARK = "X"


def presence_marks(bookings: DataFrame) -> DataFrame:
    """Distinct (user_id, date) with a desk or a parking spot on a worked shift.

    The two kinds are united and made distinct. Both come from one table, so the union is its kind filter.
    """
    kept = applicable(bookings).where(F.col("kind").isin(*KINDS))
    return kept.select("user_id", "date").distinct()


def presence_of_employees(bookings: DataFrame, employees: DataFrame) -> DataFrame:
    """Marks of users who are employees. Marks are at most one per user and day before they meet the employees."""
    ids = employees.select(F.col("id").alias("user_id"))
    return presence_marks(bookings).join(ids, "user_id", "left_semi")


def presence_days(bookings: DataFrame, employees: DataFrame) -> DataFrame:
    """Days present per employee; an employee without any keeps zero."""
    days = presence_marks(bookings).groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("days_present"))
    return employees.join(days, "id", "left").withColumn("days_present", F.coalesce("days_present", F.lit(0)))


def presence_long(bookings: DataFrame, employees: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """A row per employee and date of the period with its mark, ``X`` or blank.

    Each employee carries the set of days present, at most one per day of the period, and is spread over the
    period's dates in place, so the dense grid needs no cross join.
    """
    kept = applicable(within(bookings, start, end)).where(F.col("kind").isin(*KINDS))
    held = kept.groupBy(F.col("user_id").alias("id")).agg(F.collect_set("date").alias("held"))
    dates = F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date")
    mark = F.when(F.array_contains("held", F.col("date")), MARK).otherwise("")
    return (
        employees.join(held, "id", "left")
        .select("id", "ordinal", "name", "held", dates)
        .select("id", "ordinal", "name", "date", mark.alias("mark"))
    )


def mark_columns(start: dt.date, end: dt.date) -> dict[str, dt.date]:
    """The matrix columns of a period, one per date."""
    days = (start + dt.timedelta(days=n) for n in range((end - start).days + 1))
    return {f"d_{day:%Y%m%d}": day for day in days}


def target_weeks(period: str, start: dt.date, end: dt.date) -> int:
    """How many weekly targets a period asks for."""
    return 1 if period == "week" else max(1, (end - start).days // 7 + 1)


def effective_target(settings: Settings) -> Column:
    """The employee's own weekly target, else the configured one."""
    return F.coalesce(F.col("target_days"), F.lit(settings.target_days).cast("bigint"))


def _attainment(total: Column, settings: Settings, weeks: int) -> list[Column]:
    target = effective_target(settings) * weeks
    return [
        total.alias("total"),
        target.alias("target"),
        F.when(total >= target, "Yes").otherwise("No").alias("met"),
    ]


def _days_as_bits(bookings: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Per user of a week or month, the days present as bits of one number, the first date being bit 0.

    One hash aggregate does it. Its partial step leaves a single number per user and task, so neither the marks nor
    a busy user's bookings are shuffled one by one.
    """
    if (end - start).days >= 63:
        raise ValueError("the presence matrix is for weeks and months")
    kept = applicable(within(bookings, start, end)).where(F.col("kind").isin(*KINDS))
    # A shift by a column needs SQL: the function takes a constant number of bits only.
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.datediff("date", F.lit(start)))
    return kept.groupBy(F.col("user_id").alias("id")).agg(F.bit_or(bit).alias("days"))


def _people_with_days(bookings: DataFrame, employees: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    joined = employees.join(_days_as_bits(bookings, start, end), "id", "left")
    return joined.withColumn("days", F.coalesce("days", F.lit(0).cast("bigint")))


def attainment(bookings: DataFrame, employees: DataFrame, settings: Settings, period: str, ref: str) -> DataFrame:
    """Days present against the target, per employee.

    Days are counted as distinct (user, date) pairs, whatever the length of the period; only the matrix needs the bits.
    """
    start, end = resolve_period(period, ref)
    kept = applicable(within(bookings, start, end)).where(F.col("kind").isin(*KINDS))
    days = kept.select(F.col("user_id").alias("id"), "date").distinct().groupBy("id").agg(F.count("*").alias("days"))
    total = F.coalesce("days", F.lit(0).cast("bigint"))
    return employees.join(days, "id", "left").select(
        "id", "ordinal", "name", *_attainment(total, settings, target_weeks(period, start, end))
    )


def presence_matrix(bookings: DataFrame, employees: DataFrame, settings: Settings, period: str, ref: str) -> DataFrame:
    """One row per employee, one column per date of the week or month, then total, target and whether it is met."""
    start, end = resolve_period(period, ref)
    marks = [
        F.when(F.col("days").bitwiseAND(1 << number) != 0, MARK).otherwise("").alias(name)
        for number, name in enumerate(mark_columns(start, end))
    ]
    shift = [F.coalesce(F.col("shift"), F.lit("")).alias("shift")] if period == "week" else []
    total = F.bit_count("days").cast("bigint")
    return _people_with_days(bookings, employees, start, end).select(
        "id", "ordinal", "name", *shift, *marks, *_attainment(total, settings, target_weeks(period, start, end))
    )
