"""The booking fact table ``(date, shift, kind, slot, user_id)`` and its nested day form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.functions.periods import is_worked
from slotledger.schemas import GROUP_KEYS, KINDS, SHIFTS, SLOT_KEYS


def within(bookings: DataFrame, start, end) -> DataFrame:
    """Bookings of a period. The bounds are literals, so the filter reaches the scan."""
    return bookings.where(F.col("date").between(F.lit(start), F.lit(end)))


def applicable(bookings: DataFrame) -> DataFrame:
    """Bookings on a shift that is worked on their date; the others are stored but never reported."""
    return bookings.where(is_worked(F.col("date"), F.col("shift")))


def dangling(bookings: DataFrame, employees: DataFrame) -> DataFrame:
    """Bookings whose user is not, or no longer, an employee."""
    return bookings.join(employees.select(F.col("id").alias("user_id")), "user_id", "left_anti").select(
        *SLOT_KEYS, "user_id"
    )


def with_dates(bookings: DataFrame) -> DataFrame:
    """Turn date keys into dates. A key not written as an ISO date is kept as text but has no date to report under."""
    iso = F.col("date").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    return bookings.withColumn("date_raw", F.col("date")).withColumn(
        "date", F.when(iso, F.try_to_date("date_raw", "yyyy-MM-dd"))
    )


def day_key(bookings: DataFrame) -> Column:
    """The text a day is stored under: as it was written, where that is known, else the ISO date."""
    iso = F.date_format("date", "yyyy-MM-dd")
    return F.coalesce("date_raw", iso) if "date_raw" in bookings.columns else iso


def _rooms(bookings: DataFrame, key: str, parts: int) -> DataFrame:
    """The bookings by day text, shift, kind and part. A slot's part depends on the slot alone, never on how many there are."""
    part = F.pmod(F.xxhash64("slot"), F.lit(parts)).cast("int").alias("part")
    return bookings.select(day_key(bookings).alias(key), "shift", "kind", part, "slot", "user_id")


def _gather(key: str, value: str) -> Column:
    return F.map_from_entries(F.collect_list(F.struct(key, value)))


def nest_bookings(bookings: DataFrame, parts: int = 1) -> DataFrame:
    """``parts`` rows per date text at most, holding shift -> kind -> slot -> user.

    With more than one part every room is dealt over them alike, whatever its size, so ``date`` and ``part`` are the key. One read,
    no join. Days without a proper date keep the text they were stored under.
    """
    slots = _rooms(bookings, "date", parts)
    rooms = slots.groupBy("date", "shift", "kind", "part").agg(_gather("slot", "user_id").alias("slots"))
    shifts = rooms.groupBy("date", "part", "shift").agg(_gather("kind", "slots").alias("kinds"))
    return shifts.groupBy("date", "part").agg(_gather("shift", "kinds").alias("day"))


def flatten_bookings(days: DataFrame) -> DataFrame:
    """The inverse of ``nest_bookings``, with the date as text (see ``with_dates``). Absent or NULL levels give no rows."""
    return (
        days.select("date", F.explode("day").alias("shift", "kinds"))
        .select("date", "shift", F.explode("kinds").alias("kind", "slots"))
        .select("date", "shift", "kind", F.explode("slots").alias("slot", "user_id"))
    )


def day_grid(bookings: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Every date with all four shifts and both kinds, and how many slots are held, zero included.

    Covers the dates that have bookings, and any others given. Each counted cell brings along the empty cells of its
    date, so the bookings are read once and completing the grid takes no join.
    """
    counts = bookings.groupBy(*GROUP_KEYS).agg(F.count("*").alias("held"))
    grid = [_cell(F.lit(shift), F.lit(kind), F.lit(0)) for shift in SHIFTS for kind in KINDS]
    own = _cell(F.col("shift"), F.col("kind"), F.col("held"))
    cells = counts.select("date", F.inline(F.array(own, *grid)))
    if dates is not None:
        cells = cells.unionByName(dates.select("date", F.inline(F.array(*grid))))
    return cells.groupBy(*GROUP_KEYS).agg(F.sum("held").alias("held"))


def _cell(shift: Column, kind: Column, held: Column) -> Column:
    return F.struct(shift.alias("shift"), kind.alias("kind"), held.cast("bigint").alias("held"))


def day_image(bookings: DataFrame, parts: int = 1) -> DataFrame:
    """What a room shows: per (day text, shift, kind, part) the slots with their users, as a map and as sorted text.

    ``parts`` is as in ``nest_bookings``. A slot without a user shows an empty one.
    """
    pairs = F.array_sort(F.collect_list(F.struct("slot", "user_id")))
    shown = F.transform("pairs", lambda p: F.concat(p["slot"], F.lit("="), F.coalesce(p["user_id"], F.lit(""))))
    return (
        _rooms(bookings, "day", parts)
        .groupBy("day", "shift", "kind", "part")
        .agg(pairs.alias("pairs"))
        .select("day", "shift", "kind", "part", F.map_from_entries("pairs").alias("slots"), F.array_join(shown, ",").alias("image"))
    )
