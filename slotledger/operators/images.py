"""The day image of every booking event: which slots of its date were held, and by whom, once the event had happened.

Arrival numbers are cut into ranges at quantiles of the events. Each occupancy interval is entered under its date in every range in which it
was open, from the one it began in to the one it ended in or to the date's last event; an event looks in its own date and range and
keeps the intervals open at its number. So what one task holds is one stretch of a day's history, however busy a room or a day is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.operators.changes import NEVER, occupancy_intervals
from slotledger.operators.room import SHOWN
from slotledger.operators.scan import cutter
from slotledger.session import checkpoint

ALWAYS = (1 << 63) - 1


def interval_index(intervals: DataFrame, events: DataFrame, cut: Callable[..., DataFrame]) -> DataFrame:
    """Intervals by date and range: (date, range, shift, kind, slot, user_id, valid_from, valid_to), bounds filled in.

    ``events`` have a date and a range, which ``cut`` gave them; an interval is entered in no range after its date's last event.
    """
    last = events.groupBy("date").agg(F.max("range").alias("last"))
    rows = intervals.withColumns({"valid_from": F.coalesce("valid_from", F.lit(NEVER)), "valid_to": F.coalesce("valid_to", F.lit(ALWAYS))})
    rows = cut(cut(rows, "valid_from", "begins"), "valid_to", "ends").join(last, "date")
    entered = F.sequence(F.col("begins").cast("int"), F.least("ends", "last").cast("int"))
    return rows.where(F.col("begins") <= F.least("ends", "last")).select(
        "date", F.explode(entered).alias("range"), "shift", "kind", "slot", "user_id", "valid_from", "valid_to"
    )


def event_images(outcomes: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(seq, date, image) of every booking, repeat of one's own booking, and release, ``image`` as ``shift|kind|slot=user`` in order.

    ``held`` are the stored bookings the log went on from. The image is empty where nothing is left on the date. What meets per event is one
    day's held slots.
    """
    outcomes = checkpoint(outcomes)
    shown = outcomes.where(F.col("outcome").isin(*SHOWN)).select("seq", "date")
    cut, _ = cutter(shown, "seq")
    events = checkpoint(cut(shown).withColumn("range", F.col("range").cast("int")))
    index = interval_index(occupancy_intervals(outcomes, held=held), events, cut)
    text = F.concat(F.concat_ws("|", "shift", "kind", "slot"), F.lit("="), F.col("user_id"))
    open_now = (F.col("valid_from") <= F.col("seq")) & (F.col("valid_to") > F.col("seq"))
    seen = events.join(index, ["date", "range"]).where(open_now).groupBy("seq").agg(F.sort_array(F.collect_list(text)).alias("slots"))
    return events.join(seen, "seq", "left").select("seq", "date", F.coalesce(F.array_join("slots", ","), F.lit("")).alias("image"))
