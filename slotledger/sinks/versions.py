"""Several tables replaced together or not at all: a folder for each version, and a pointer to it that is written last.

Readers take the largest version that has a pointer. A writer that fails between two tables leaves a folder without one, which nobody
reads and the next writer of that number replaces. There is one writer at a time. Older versions stay until someone deletes them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS = "pointers"


def committed(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The last version that is complete (and below a number); None if there is none."""
    try:
        pointers = spark.read.schema("number bigint").option("recursiveFileLookup", True).parquet(f"{path}/{POINTERS}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return (pointers if below is None else pointers.where(F.col("number") < below)).agg(F.max("number")).first()[0]


def folder(path: str, version: int) -> str:
    return f"{path}/version={version}"


def commit(spark: SparkSession, path: str, version: int) -> None:
    """Make a version the one that is read. Spark moves the pointer's file into place whole."""
    pointer = spark.range(1, numPartitions=1).select(F.lit(version).cast("bigint").alias("number"))
    pointer.write.mode("overwrite").parquet(f"{path}/{POINTERS}/{version}")


def write_version(tables: dict[str, DataFrame], path: str, version: int) -> None:
    """Write all tables of a version, then its pointer."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder(path, version)}/{name}")
    commit(spark, path, version)


def read_version(spark: SparkSession, path: str, version: int, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder(path, version)}/{name}") for name in names}
