"""What a subscriber shows: the last update per spot, and its status for the person looking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The words shown for one's own and for free spots.
YOU, AVAILABLE = "You", "Available"


def spot_updates(commands: DataFrame) -> DataFrame:
    """Commands as update messages ``(seq, type, id, reserved_by)``; a release leaves the spot free."""
    owner = F.when(F.col("op") == "book", F.col("user_id"))
    return commands.select("seq", F.col("kind").alias("type"), F.col("slot").alias("id"), owner.alias("reserved_by"))


def client_state(updates: DataFrame) -> DataFrame:
    """The last update per (type, id) wins. A partial maximum per task comes before the shuffle."""
    last = F.max_by(F.struct("reserved_by", "seq"), "seq").alias("last")
    return updates.groupBy("type", "id").agg(last).select("type", "id", "last.reserved_by", "last.seq")


def slot_status(spots: DataFrame, viewer: str) -> DataFrame:
    """Status and label of each spot for a viewer, with the number spots are shown in order of."""
    owner = F.nullif(F.col("reserved_by"), F.lit(""))
    mine = owner == F.lit(viewer)
    return spots.select(
        "type",
        "id",
        F.when(owner.isNull(), "free").when(mine, "mine").otherwise("taken").alias("status"),
        F.when(owner.isNull(), AVAILABLE).when(mine, YOU).otherwise(owner).alias("shown"),
        F.col("id").try_cast("bigint").alias("position"),
    )
