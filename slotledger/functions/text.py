"""Text clean-up and lenient parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotledger.schemas import SHIFTS

# Spark's trim takes off the space character only; stored text is stripped of every Unicode white space
# character and of the four ASCII separators (1C to 1F).
_BLANK = r"[\s\x1c-\x1f]+"


def strip(text: Column) -> Column:
    """Take white space of any kind off both ends."""
    lead = F.regexp_replace(text, r"(?U)\A" + _BLANK, "")
    return F.regexp_replace(lead, r"(?U)" + _BLANK + r"\z", "")


def or_default(text: Column, default: str) -> Column:
    """The text, or the default where it is missing or empty. Blanks count as text."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def to_int(text: Column) -> Column:
    """Whole number written as text, else NULL.

    Surrounding white space, a sign and single underscores between digits are accepted. A number beyond 64 bits
    counts as unreadable.
    """
    clean = strip(text)
    digits = F.regexp_replace(clean, "_", "")
    return F.when(clean.rlike(r"\A[+-]?[0-9]+(_[0-9]+)*\z"), digits.try_cast("bigint"))


def comma_items(text: Column) -> Column:
    """Split on commas, strip every item, drop the empty ones. Order and repeats stay."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda item: item != "")


def int_items(items: Column) -> Column:
    """The items that read as whole numbers, in order, repeats kept."""
    return F.filter(F.transform(items, to_int), lambda number: number.isNotNull())


def shift_items(items: Column, fallback: str = "day") -> Column:
    """The known shift names among the items, in order, repeats kept; the fallback alone where there is none."""
    known = F.filter(items, lambda item: item.isin(*SHIFTS))
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(fallback)))


def shift_list(text: Column, fallback: str = "day") -> Column:
    """``shift_items`` of a comma-separated text."""
    return shift_items(comma_items(text), fallback)
