"""Outputs with an order: files that, read in the order of their names, have the rows in order.

Each file is a range of the order, sorted by the task that writes it, so no task holds more than its range. Where the rows of one
value outgrow a file, end the order with a column that tells them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.schemas import SHIFTS


def write_ordered(rows: DataFrame, path: str, *order: Column | str, files: int | None = None, fmt: str = "parquet") -> None:
    """Write rows in order; part files are numbered along the ranges. NULLs come first unless a column says otherwise."""
    ranged = rows.repartitionByRange(*order) if files is None else rows.repartitionByRange(files, *order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").format(fmt).save(path)


def spot_order() -> list[Column]:
    """Spots by their number; those without one after all others, by text."""
    number = F.col("id").try_cast("bigint")
    return [F.col("type").asc(), number.asc_nulls_last(), F.col("id").asc()]


def shift_order() -> list[Column]:
    """By date, then shifts in display order."""
    return [F.col("date").asc(), F.array_position(F.array(*map(F.lit, SHIFTS)), F.col("shift")).asc()]


def write_spots(spots: DataFrame, path: str, files: int | None = None) -> None:
    """Spot status (type, id, ...) in the order spots are shown in."""
    write_ordered(spots, path, *spot_order(), files=files)


def write_feedback(feedback: DataFrame, path: str, files: int | None = None) -> None:
    """Stored feedback in order of arrival."""
    write_ordered(feedback, path, "seq", files=files)


def write_employees(employees: DataFrame, path: str, files: int | None = None) -> None:
    """Employees in the order they were added in; several of one request by id."""
    write_ordered(employees, path, "ordinal", "id", files=files)


def write_shifts(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Rows with a date and a shift in the order reports show them in."""
    write_ordered(rows, path, *shift_order(), files=files)
