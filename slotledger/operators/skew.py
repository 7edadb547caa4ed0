"""Finding groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one group that one task may work through.
LARGE_ROWS = 2_000_000
# The limit grows with the data so that there are never more large groups than this.
MOST_GROUPS = 20_000


@dataclass(frozen=True)
class LargeGroups:
    """The keys of the large groups, at most ``MOST_GROUPS`` of them, and how many rows these have in all."""

    keys: DataFrame
    rows: int
    limit: int


def large_groups(
    rows: DataFrame, keys: Sequence[str], limit: int = LARGE_ROWS, most: int = MOST_GROUPS
) -> LargeGroups | None:
    """The groups of more than ``limit`` rows, None if there are none.

    One job counts the rows per group, with partial counts before the shuffle. Only counts above a limit that fewer
    than ``most`` groups can exceed come to the driver.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    largest, total = sizes.agg(F.max("rows"), F.sum("rows")).first()
    if (largest or 0) <= limit:
        return None
    limit = max(limit, -(-total // most))
    large = sizes.where(F.col("rows") > limit).collect()
    if not large:
        return None
    found = rows.sparkSession.createDataFrame(large, sizes.schema).select(*keys)
    return LargeGroups(found, sum(row["rows"] for row in large), limit)
