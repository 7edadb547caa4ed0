"""Streams that go on from stored state: each micro-batch is a batch job over the state that the batch before it left.

State is a set of tables by batch number (``sinks.versions``). A batch reads the last complete version below its own number and
writes its results, its version, and the pointer last. So a batch that is tried again starts from the right state and replaces
what its first try left; and a busy room within a batch is cut into chunks by the batch replay, where keyed state would give it to one task.
What a batch costs besides its own rows is rewriting the state: slots held, people, settings and feedback.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from slotledger.operators.changes import settled_bookings
from slotledger.operators.replay import replay
from slotledger.operators.validation import valid_commands
from slotledger.plans.changefeed import Logs, Office, change_feed, office_after, outcomes_of
from slotledger.session import checkpoint, shared_path
from slotledger.sinks.versions import committed, read_version, write_version
from slotledger.sources import requests as R
from slotledger.streaming.live import SLICES, cut_log

Tables = dict[str, DataFrame]
#: From a micro-batch and the state before it (None at the start): results to publish, and the state after it.
Advance = Callable[[DataFrame, Tables | None], tuple[Tables, Tables]]

AVAILABLE_NOW = {"availableNow": True}
OFFICE = ("bookings", "settings", "lists", "employees", "feedback")


def follow(stream: DataFrame, path: str, progress: str, advance: Advance, state: tuple[str, ...], trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Run ``advance`` over a stream: results below ``path`` by name and batch, state tables (named in ``state``) by version.

    ``trigger`` is what ``DataStreamWriter.trigger`` takes. The source must deliver rows in order from batch to batch.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = committed(spark, f"{path}/state", below=number)
        before = None if version is None else read_version(spark, f"{path}/state", version, state)
        batch = batch.persist()
        try:
            results, after = advance(batch, before)
            for name, table in results.items():
                table.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            write_version(after, f"{path}/state", number)
        finally:
            batch.unpersist()

    return stream.writeStream.trigger(**trigger).option("checkpointLocation", progress).foreachBatch(step).start()


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All results of one name, with their ``batch``."""
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")


def advance_bookings(batch: DataFrame, before: Tables | None) -> tuple[Tables, Tables]:
    """Replay a batch of valid commands from the bookings held before it."""
    held = before["bookings"] if before else None
    outcomes = checkpoint(replay(batch, held=held))
    return {"outcomes": outcomes}, {"bookings": settled_bookings(outcomes, held=held)}


def split_requests(requests: DataFrame) -> Logs:
    """The four logs of a request log, written, since what follows goes through each of them several times."""
    logs = (
        valid_commands(R.booking_commands(requests)),
        R.settings_commands(requests),
        R.employee_commands(requests),
        R.feedback_commands(requests),
    )
    return Logs(*map(checkpoint, logs))


def advance_office(batch: DataFrame, before: Tables | None) -> tuple[Tables, Tables]:
    """The change events of a batch of requests of all kinds, and the office after it."""
    logs, office = split_requests(batch), Office(**before) if before else None
    outcomes = checkpoint(outcomes_of(logs, office))
    events = change_feed(outcomes, logs.settings, logs.employees, logs.feedback, office)
    return {"events": events}, office_after(logs, outcomes, office).tables()


def follow_bookings(stream: DataFrame, path: str, progress: str, trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Outcomes of a stream of valid commands, and the bookings held after each batch."""
    return follow(stream, path, progress, advance_bookings, ("bookings",), trigger)


def follow_requests(stream: DataFrame, path: str, progress: str, trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """The change feed of a stream of requests (``sources.requests.stream_requests``), and the office after each batch."""
    return follow(stream, path, progress, advance_office, OFFICE, trigger)


def replayed_log(log: DataFrame, start: Callable[..., StreamingQuery], slices: int = SLICES) -> str:
    """Feed a stored log to a following stream, slice by slice in order of ``seq``. Returns the folder of its results."""
    spark = log.sparkSession
    inbox, path, progress = (shared_path(spark, label) for label in ("inbox", "followed", "progress"))
    for number, part in enumerate(cut_log(log, slices)):
        part.write.mode("overwrite").parquet(f"{inbox}/slice={number:05d}")
        start(spark.readStream.schema(log.schema).parquet(f"{inbox}/slice=*"), path, progress).awaitTermination()
    return path
