"""Helpers that several operators share."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.session import shared_path, tune

# A word is a run of code points other than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus folder."""
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the workers this library, once per application, through Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_slotledger_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    handle, archive = tempfile.mkstemp(prefix="slotledger-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    context._slotledger_shipped = True


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this library at the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and go on from the copy there, which outlives lost executors and is not computed twice."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def hash_share(*key) -> Column:
    """A number from 0 to 1 that depends on the key alone, in the order of the key's signed hash."""
    return F.xxhash64(*key) / F.lit(2.0**64) + 0.5


#: A sample of the k smallest hashes among n rows looks only at rows whose share is below this many times k / n: few
#: rows are ranked, however many tasks read them, and fewer than k of them are left with next to no chance.
SAMPLE_SLACK = 4.0


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


#: What tells rows apart: the id, and a hash that also knows a null id and the text. Rows alike in both are the same document.
KEY = ["k", "h"]


def key_columns() -> list[Column]:
    """``KEY`` of rows with doc_id and text; neither is ever null, so they join by plain equality."""
    return [F.coalesce("doc_id", F.lit(0)).cast("long").alias("k"), F.xxhash64("doc_id", "text").alias("h")]


def rows_by_key(docs: DataFrame, marked: DataFrame, how: str, once: bool = False) -> DataFrame:
    """The rows of ``docs`` that ``how`` (left_semi or left_anti) gives for the keys in ``marked``, columns unchanged.

    With ``once``, rows alike in id and text come out once.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key_columns())
    chosen = rows.join(marked.select(*KEY).distinct(), KEY, how)
    return (chosen.dropDuplicates(KEY) if once else chosen).select("row.*")
