"""What follows from replay outcomes: settled bookings, occupancy intervals, and booking change events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.operators.room import BOOKED, FREED, SHOWN
from slotledger.schemas import SLOT_KEYS

# Before any command.
NEVER = -(1 << 63)


def settled_bookings(outcomes: DataFrame, keys: Sequence[str] = SLOT_KEYS, held: DataFrame | None = None) -> DataFrame:
    """Slots still held at the end of the log: the last booking or release of each decides.

    ``held`` are the stored bookings the log went on from; slots it did not touch stay as they are.
    """
    rows = outcomes.where(F.col("outcome").isin(BOOKED, FREED)).select(*keys, "outcome", "user_id", "seq")
    if held is not None:
        rows = _as_booked(held, keys).unionByName(rows)
    last = F.max_by(F.struct("outcome", "user_id", "seq"), F.coalesce("seq", F.lit(NEVER))).alias("last")
    return (
        rows.groupBy(*keys)
        .agg(last)
        .where(F.col("last.outcome") == BOOKED)
        .select(*keys, "last.user_id", F.col("last.seq").alias("booked_seq"))
    )


def _as_booked(held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored bookings as the outcomes that made them."""
    since = F.col("booked_seq") if "booked_seq" in held.columns else F.lit(None)
    return held.select(*keys, F.lit(BOOKED).alias("outcome"), "user_id", since.cast("bigint").alias("seq"))


def occupancy_intervals(outcomes: DataFrame, keys: Sequence[str] = SLOT_KEYS, held: DataFrame | None = None) -> DataFrame:
    """Who held which slot from which command to which, open where it is still held.

    ``held`` are the stored bookings the log went on from: their intervals start where they were booked (NULL where that is not
    known) and are open unless the log ends them.

    A release names the booking it ends, so the two meet in an aggregate by that booking's ``seq``. The rows of a
    busy slot spread over all tasks, which a window over its history would not allow.
    """
    booked = F.col("outcome") == BOOKED
    ends = outcomes.where(F.col("outcome").isin(BOOKED, FREED)).select(*keys, "outcome", "user_id", "seq", "since")
    if held is not None:
        ends = ends.unionByName(_as_booked(held, keys).withColumn("since", F.lit(None).cast("bigint")))
    return (
        ends.groupBy(*keys, F.when(booked, F.col("seq")).otherwise(F.col("since")).alias("valid_from"))
        .agg(
            F.max(F.when(booked, F.col("user_id"))).alias("user_id"),
            F.max(F.when(~booked, F.col("seq"))).alias("valid_to"),
        )
        .select(*keys, "user_id", "valid_from", "valid_to")
    )


def booking_changes(outcomes: DataFrame, keys: Sequence[str] = SLOT_KEYS) -> DataFrame:
    """The change events of the booking log: bookings, repeats of one's own, and releases."""
    return outcomes.where(F.col("outcome").isin(*SHOWN)).select(
        F.lit("bookings").alias("log"),
        "seq",
        F.lit("booking").alias("action"),
        F.concat_ws("|", *keys).alias("ref"),
        F.when(F.col("outcome") != FREED, F.col("user_id")).alias("detail"),
    )
