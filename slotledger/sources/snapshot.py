"""Stored state: the nested JSON document of a whole office, and the same four tables as Spark writes them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotledger.operators.bookings import flatten_bookings, with_dates
from slotledger.schemas import DEFAULT_SETTINGS, LIST_SETTINGS, SNAPSHOT_DOCUMENT, STORED_TABLES, Settings
from slotledger.sinks.versions import committed, folder


def read_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot document. A missing file is an office without people or bookings.

    A damaged document is an error here and now, before anything is written from it. One task parses a document, as it is
    one JSON value; at volume, read the request log or the stored tables instead.
    """
    try:
        document = spark.read.schema(SNAPSHOT_DOCUMENT).json(path, multiLine=True, mode="FAILFAST")
        # One row per document; every section is named, so every section is parsed.
        document.select("config", *(F.size(c) for c in ("employees", "bookings", "feedback"))).write.format("noop").mode("overwrite").save()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = T.StructType([T.StructField(f.name, f.dataType) for f in SNAPSHOT_DOCUMENT])
        document = spark.createDataFrame([(None, None, None, None)], empty)
    return {
        "settings": normalize_settings(document.select("config")),
        "employees": document.select(F.posexplode("employees").alias("ordinal", "e")).select(
            "e.id",
            "ordinal",
            "e.name",
            "e.shift",
            "e.shifts",
            "e.department",
            F.col("e.targetDays").alias("target_days"),
            "e.remote",
            F.col("e.hasCar").alias("has_car"),
        ),
        "bookings": with_dates(
            flatten_bookings(document.select(F.explode("bookings").alias("date", "day")))
        ),
        "feedback": document.select(F.posexplode("feedback").alias("ordinal", "f")).select(
            "f.id",
            "ordinal",
            "f.name",
            "f.message",
            "f.category",
            F.try_to_timestamp(F.col("f.ts")).alias("ts"),
            F.coalesce("f.read", F.lit(False)).alias("read"),
        ),
    }


def normalize_settings(config: DataFrame) -> DataFrame:
    """Stored settings with every known one filled in. The stored record stays alongside, with any further keys."""
    numbers = [
        F.coalesce(F.try_variant_get("config", f"$.{key}", "bigint"), F.lit(default).cast("bigint")).alias(key)
        for key, default in DEFAULT_SETTINGS.items()
    ]
    empty = F.array().cast("array<bigint>")
    lists = [
        F.coalesce(F.try_variant_get("config", f"$.{key}", "array<bigint>"), empty).alias(key) for key in LIST_SETTINGS
    ]
    return config.select(*numbers, *lists, F.to_json("config").alias("stored"))


def report_settings(settings: DataFrame) -> Settings:
    """The one settings row as plain numbers."""
    row = settings.select("desks", "parking", "targetDays").first()
    return Settings(row["desks"], row["parking"], row["targetDays"])


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables ``write_tables`` stored last, empty ones included."""
    version = committed(spark, path)
    if version is None:
        raise FileNotFoundError(f"no complete state below {path}")
    stored = folder(path, version)
    tables = {name: spark.read.schema(schema).parquet(f"{stored}/{name}") for name, schema in STORED_TABLES.items()}
    return tables | {"bookings": tables["bookings"].where("slot is not null")}


def register_views(tables: dict[str, DataFrame]) -> None:
    """Make the state queryable in SQL, one view per table."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
