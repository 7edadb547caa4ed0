"""Headline figures for a table of report requests at once, however many and however long their periods.

Bookings are counted once per date, and the counts are summed up along the dates. A period's figures are the difference of two
sums: the last at or before its end, and the last before its start. So a request is two lookups, whatever its period holds, and bookings
are gone through once for all requests. Shifts in a period follow from its bounds by arithmetic.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotledger.operators.bookings import applicable
from slotledger.operators.calendar import resolve_periods
from slotledger.operators.scan import as_of
from slotledger.operators.utilization import share
from slotledger.schemas import KINDS, WEEKDAY_SHIFTS, WEEKEND_SHIFTS, Settings
from slotledger.session import checkpoint

# Any Monday.
MONDAY = dt.date(1970, 1, 5)


def shifts_before(date: Column) -> Column:
    """How many shifts are worked from a fixed Monday up to a date, the date left out; negative before that Monday."""
    days = F.datediff(date, F.lit(MONDAY))
    weeks = F.floor(days / 7)
    rest = days - 7 * weeks  # 0 to 6 days of a week that began on a Monday
    weekday, weekend = len(WEEKDAY_SHIFTS), len(WEEKEND_SHIFTS)
    return weeks * (5 * weekday + 2 * weekend) + F.least(rest, F.lit(5)) * weekday + F.greatest(rest - 5, F.lit(0)) * weekend


def counts_to_date(bookings: DataFrame) -> DataFrame:
    """``day`` (days since 1970) and ``held``: all bookings of each kind in worked shifts up to and including that day.

    Partial counts come before the shuffle, and the running sum is over a row per date.
    """
    counted = applicable(bookings).where("date is not null").groupBy("date")
    daily = counted.agg(*(F.count_if(F.col("kind") == kind).alias(kind) for kind in KINDS))
    along = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = F.struct(*(F.sum(kind).over(along).alias(kind) for kind in KINDS))
    return daily.select(F.unix_date("date").cast("bigint").alias("day"), sums.alias("held"))


def request_totals(bookings: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (period, ref) with their bounds, worked shifts (cells) and bookings of both kinds. Repeated requests stay."""
    numbered = checkpoint(resolve_periods(requests).withColumn("request", F.monotonically_increasing_id()))
    ends = F.array(
        F.struct((F.unix_date("start_date") - 1).cast("bigint").alias("day"), F.lit(-1).alias("sign")),
        F.struct(F.unix_date("end_date").cast("bigint").alias("day"), F.lit(1).alias("sign")),
    )
    points = numbered.select("request", F.inline(ends))
    known = as_of(points, checkpoint(counts_to_date(bookings)), "day", "held")
    sums = [F.sum(F.coalesce(F.col(f"held.{kind}"), F.lit(0)) * F.col("sign")).cast("bigint").alias(kind) for kind in KINDS]
    cells = shifts_before(F.date_add("end_date", 1)) - shifts_before(F.col("start_date"))
    held = known.groupBy("request").agg(*sums)
    return numbered.join(held, "request").select("period", "ref", "start_date", "end_date", cells.cast("bigint").alias("cells"), *KINDS)


def request_summaries(bookings: DataFrame, requests: DataFrame, settings: Settings) -> DataFrame:
    """``request_totals`` with the mean utilization of both kinds over every worked shift of the period."""
    totals = request_totals(bookings, requests)
    shares = (share(F.col(kind), capacity, F.col("cells")) for kind, capacity in zip(KINDS, (settings.desks, settings.parking)))
    return totals.select("*", *(s.alias(name) for s, name in zip(shares, ("desk_util", "parking_util"))))
