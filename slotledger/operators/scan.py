"""Running totals and as-of values over one global order, without gathering the order in one task.

The order is cut into even ranges at quantiles of the order column. Each range is scanned by a window of its own; a
summary row per range carries what the ranges before it contribute.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Most ranges an order is cut into, hence most summary rows that are broadcast.
MAX_RANGES = 10_000


def cutter(rows: DataFrame, order: str) -> tuple[Callable[..., DataFrame], int]:
    """Cut the order at quantiles of these rows: what adds a row's ``range`` number, and how many ranges there are.

    Other rows can be cut at the same places, by any ``column``, and the number go by another ``name``.
    """
    ranges = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES)
    points = [n / ranges for n in range(1, ranges)]
    position = F.col(order).cast("double").alias("_order")
    inner = rows.select(position).approxQuantile("_order", points, 1 / (4 * ranges)) if points else []
    splits = [float("-inf"), *sorted(set(inner)), float("inf")]

    def cut(some: DataFrame, column: str = order, name: str = "range") -> DataFrame:
        if len(splits) == 2:
            return some.withColumn(name, F.lit(0.0))
        buckets = Bucketizer(splits=splits, inputCol="_order", outputCol=name)
        return buckets.transform(some.withColumn("_order", F.col(column).cast("double"))).drop("_order")

    return cut, len(splits) - 1


def running_total(rows: DataFrame, order: str, value: str, total: str) -> DataFrame:
    """Add the sum of ``value`` over all rows up to and including this one in ``order``.

    The rows are gone through three times (cut, summaries, scan): pass in a table or a checkpoint.
    """
    into_ranges, _ = cutter(rows, order)
    cut = into_ranges(rows)
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = (
        cut.groupBy("range")
        .agg(F.sum(value).alias("_sum"))
        .select("range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cut.withColumn(total, F.sum(value).over(inside))
        .join(F.broadcast(offsets), "range")  # at most MAX_RANGES rows
        .withColumn(total, F.col(total) + F.col("_offset"))
        .drop("range", "_offset")
    )


def as_of(rows: DataFrame, history: DataFrame, order: str, value: str, along: DataFrame | None = None) -> DataFrame:
    """Add the ``value`` the history (``order``, ``value``) has at or before each row, NULL if there is none yet.

    The cut is made along both inputs, so that ranges are even wherever rows pile up. ``along`` may stand in for rows
    that are costly to compute: they are then gone through only once.
    """
    both = (rows if along is None else along).select(order).unionByName(history.select(order))
    cut, ranges = cutter(both, order)
    known = cut(history.select(order, value).where(F.col(value).isNotNull()))
    last = known.groupBy("range").agg(F.max_by(value, order).alias("_last"))
    every = rows.sparkSession.range(ranges).select(F.col("id").cast("double").alias("range"))
    starts = every.join(last, "range", "left")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = starts.select("range", F.last("_last", ignorenulls=True).over(earlier).alias("_offset"))
    inside = (
        Window.partitionBy("range").orderBy(order, "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    marked = cut(rows).withColumn("_row", F.lit(1))
    return (
        marked.unionByName(known.withColumn("_row", F.lit(0)), allowMissingColumns=True)
        .withColumn(value, F.last(value, ignorenulls=True).over(inside))
        .where(F.col("_row") == 1)
        .join(F.broadcast(offsets), "range", "left")  # at most MAX_RANGES rows
        .withColumn(value, F.coalesce(value, "_offset"))
        .drop("range", "_offset", "_row")
    )


def running_last(rows: DataFrame, order: str, values: list[str]) -> DataFrame:
    """Replace each of ``values`` by its last value that is not NULL, up to and including this row in ``order``.

    The rows are gone through three times (cut, summaries, scan): pass in a table or a checkpoint.
    """
    into_ranges, _ = cutter(rows, order)
    cut = into_ranges(rows)
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    last = cut.groupBy("range").agg(
        *(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_{v}") for v in values)
    )
    offsets = last.select("range", *(F.last(f"_{v}", ignorenulls=True).over(earlier).alias(f"_{v}") for v in values))
    inside = Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = cut.withColumns({v: F.last(v, ignorenulls=True).over(inside) for v in values})
    joined = seen.join(F.broadcast(offsets), "range")  # at most MAX_RANGES rows
    return joined.withColumns({v: F.coalesce(v, f"_{v}") for v in values}).drop("range", *(f"_{v}" for v in values))
