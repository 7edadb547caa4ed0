"""Storing state: tables on shared storage, and day documents in the nested form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotledger.operators.bookings import flatten_bookings, nest_bookings, with_dates
from slotledger.operators.room import BOOKED, FREED
from slotledger.schemas import DAY_DOCUMENT, STORED_TABLES
from slotledger.sinks.versions import commit, committed, folder


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Replace the stored state, all tables at once: readers see the old state until the last table is written."""
    spark = next(iter(tables.values())).sparkSession
    last = committed(spark, path)
    version = 0 if last is None else last + 1
    for name, table in tables.items():
        types = {f.name: f.dataType for f in STORED_TABLES[name]}
        table = table.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in table.columns])
        if name == "bookings":
            _write_bookings(table, f"{folder(path, version)}/{name}", "static")
        else:
            table.write.mode("overwrite").parquet(f"{folder(path, version)}/{name}")
    commit(spark, path, version)


def write_days(bookings: DataFrame, path: str, touched: DataFrame | None = None) -> None:
    """Replace the dates that have rows here, and leave the files of the other dates of the stored bookings alone.

    ``touched`` (date) are dates to replace even if nothing is left on them; such a date keeps one row without a slot, which readers
    leave out. The rows must not come from the files that are replaced: pass a checkpoint.
    """
    spark = bookings.sparkSession
    if touched is not None:
        empty = touched.select("date").distinct().join(bookings.select("date").distinct(), "date", "left_anti")
        bookings = bookings.unionByName(empty.withColumn("date_raw", F.date_format("date", "yyyy-MM-dd")), allowMissingColumns=True)
    last = committed(spark, path)
    _write_bookings(bookings, f"{folder(path, last or 0)}/bookings", "dynamic")
    if last is None:
        commit(spark, path, 0)


def touched_dates(outcomes: DataFrame) -> DataFrame:
    """The dates on which a log changed what is held."""
    return outcomes.where(F.col("outcome").isin(BOOKED, FREED)).select("date").distinct()


def _write_bookings(bookings: DataFrame, path: str, overwrite: str) -> None:
    # Rebalancing gathers each date in few files and still splits a date that is too big for one.
    writer = bookings.hint("rebalance", "date").write.mode("overwrite").partitionBy("date")
    writer.option("partitionOverwriteMode", overwrite).parquet(path)


def day_documents(bookings: DataFrame, parts: int = 1) -> DataFrame:
    """One JSON text per date text: ``{"date": ..., "day": {shift: {kind: {slot: user}}}}``.

    With more ``parts`` up to that many texts per date, each with its ``part``; date and part are then the key.
    """
    keys = ("date", "day") if parts == 1 else ("date", "part", "day")
    return nest_bookings(bookings, parts).select(F.to_json(F.struct(*keys)).alias("value"))


def read_day_documents(spark: SparkSession, path: str) -> DataFrame:
    """The bookings that ``write_day_documents`` stored. A damaged line is an error."""
    schema = T.StructType([T.StructField("date", T.StringType()), T.StructField("day", DAY_DOCUMENT)])
    return with_dates(flatten_bookings(spark.read.schema(schema).json(path, mode="FAILFAST")))


def write_day_documents(bookings: DataFrame, path: str, parts: int = 1) -> None:
    """Write the nested form as JSON lines, a line per date and part."""
    day_documents(bookings, parts).write.mode("overwrite").text(path)
