"""The feedback log: submissions, read marks and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.functions.text import or_default, strip
from slotledger.operators.scan import running_total
from slotledger.schemas import FEEDBACK_NOT_FOUND, MESSAGE_REQUIRED
from slotledger.session import checkpoint, written

# What stored feedback is cut to, and what missing parts become.
NAME_LENGTH, MESSAGE_LENGTH = 80, 1000
ANONYMOUS, GENERAL = "Anonymous", "general"
EDITS = ("read", "delete")


def clean_name(name: Column) -> Column:
    """A missing or empty name becomes the default before stripping, so a blank one ends up empty."""
    return F.substring(strip(or_default(name, ANONYMOUS)), 1, NAME_LENGTH)


def clean_message(message: Column) -> Column:
    """The message without surrounding white space, at its stored length."""
    return F.substring(strip(F.coalesce(message, F.lit(""))), 1, MESSAGE_LENGTH)


def clean_submissions(log: DataFrame) -> DataFrame:
    """Submissions as they would be stored, with the error of those that are not."""
    message = clean_message(F.col("message"))
    # A category sent as null stays null; only a missing one gets the default.
    missing = ~F.col("category_sent") if "category_sent" in log.columns else F.col("category").isNull()
    stamp = [name for name in ("ts",) if name in log.columns]
    return log.where(F.col("op") == "submit").select(
        "seq",
        "fb_id",
        clean_name(F.col("name")).alias("name"),
        message.alias("message"),
        F.when(missing, GENERAL).otherwise(F.col("category")).alias("category"),
        *stamp,
        F.when(message == "", MESSAGE_REQUIRED).alias("error"),
    )


def _stored(log: DataFrame) -> DataFrame:
    return clean_submissions(log).where(F.col("error").isNull())


def _arrivals(log: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Submissions as ``(fb_id, submitted)`` only, so the message text stays out of the joins. ``held`` were stored before the log."""
    new = _stored(log).select("fb_id", F.col("seq").alias("submitted"))
    return new if held is None else held.select("fb_id", F.col("seq").alias("submitted")).unionByName(new)


def histories(log: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Per stored submission: when it was submitted, first deleted and first marked as read.

    Edits of ids that do not exist meet no submission and drop out before the aggregate.
    """
    edits = log.where(F.col("op").isin(*EDITS)).select("fb_id", "seq", "op")
    arrivals = written(_arrivals(log, held), "arrivals")
    edited = (
        edits.join(arrivals, "fb_id")
        .where(F.col("seq") > F.col("submitted"))
        .groupBy("fb_id")
        .agg(
            F.min(F.when(F.col("op") == "delete", F.col("seq"))).alias("deleted"),
            F.min(F.when(F.col("op") == "read", F.col("seq"))).alias("first_read"),
        )
    )
    return arrivals.join(edited, "fb_id", "left")


def current_feedback(log: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Feedback still stored at the end of the log. Marking as read sticks; marking an unknown id does nothing.

    ``held`` is feedback (columns as here) that the log goes on from, with numbers below the log's.
    """
    left = histories(log, held=held).where(F.col("deleted").isNull()).select(
        "fb_id", F.col("first_read").isNotNull().alias("marked")
    )
    rows = _stored(log).drop("error").withColumn("read", F.lit(False))
    if held is not None:
        rows = held.unionByName(rows, allowMissingColumns=True)
    return rows.join(left, "fb_id").withColumn("read", F.col("read") | F.col("marked")).drop("marked")


def feedback_rejects(log: DataFrame) -> DataFrame:
    """Blank submissions, and deletes of ids that are not stored at that time."""
    blank = clean_submissions(log).where(F.col("error").isNotNull()).select(
        "seq", F.lit("submit").alias("op"), "fb_id", "error"
    )
    deletes = log.where(F.col("op") == "delete").select("seq", "op", "fb_id")
    first = F.coalesce(F.col("seq") == F.col("deleted"), F.lit(False))
    unknown = (
        deletes.join(written(histories(log).select("fb_id", "deleted"), "deletions"), "fb_id", "left")
        .where(~first)
        .select("seq", "op", "fb_id", F.lit(FEEDBACK_NOT_FOUND).alias("error"))
    )
    return blank.unionByName(unknown)


def feedback_counts(log: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """After each stored submission and each successful delete: how many pieces of feedback there are, ``held`` included."""
    spans = histories(log, held=held)
    before = 0 if held is None else held.count()
    new = spans if held is None else spans.join(held.select("fb_id"), "fb_id", "left_anti")
    steps = new.select(F.col("submitted").alias("seq"), "fb_id", F.lit("submit").alias("op"), F.lit(1).alias("step"))
    ends = spans.where(F.col("deleted").isNotNull()).select(
        F.col("deleted").alias("seq"), "fb_id", F.lit("delete").alias("op"), F.lit(-1).alias("step")
    )
    counts = running_total(checkpoint(steps.unionByName(ends)), "seq", "step", "count").drop("step")
    return counts.withColumn("count", F.col("count") + F.lit(before).cast("bigint"))


def feedback_changes(log: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The change events of the feedback log: the new count after each edit that changed it, ``held`` included."""
    return feedback_counts(log, held).select(
        F.lit("feedback").alias("log"),
        "seq",
        F.lit("feedback_count").alias("action"),
        F.col("fb_id").cast("string").alias("ref"),
        F.col("count").cast("string").alias("detail"),
    )
