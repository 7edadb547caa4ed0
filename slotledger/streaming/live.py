"""Structured Streaming over the command log: keyed replay, live occupancy, and published changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slotledger.operators.replay import PAYLOAD
from slotledger.operators.room import BOOKED, FREED, Room
from slotledger.schemas import GROUP_KEYS
from slotledger.session import shared_path

STATE = "slots array<string>, users array<string>, since array<bigint>"
# Micro-batches a stored log is replayed in as a stream. Each is a run of the streaming job, so choose by what one may hold.
SLICES = 2


def replay_stream(commands: DataFrame, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """Streaming twin of ``replay``: the same rule and the same columns, with the rooms in keyed state.

    Commands are put in arrival order within a micro-batch; between micro-batches the source must deliver them in
    order. What one task holds of a group is its share of one micro-batch, which the source's trigger options bound.
    """
    log = commands.select(*keys, *PAYLOAD)
    fields = [T.StructField(f.name, f.dataType) for f in log.schema]
    answer = [
        T.StructField("outcome", T.StringType()),
        T.StructField("by", T.StringType()),
        T.StructField("since", T.LongType()),
    ]
    return log.groupBy(*keys).applyInPandasWithState(
        _advance, T.StructType([*fields, *answer]), STATE, "append", GroupStateTimeout.NoTimeout
    )


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    room = Room()
    if state.exists:
        for slot, user, since in zip(*state.get):
            room.place(slot, user, since)
    log = pd.concat(list(frames)).sort_values("seq")
    answers = []
    for seq, slot, op, user, is_admin in log[list(PAYLOAD)].itertuples(index=False, name=None):
        user = user if isinstance(user, str) else None
        answers.append(room.book(seq, slot, user) if op == "book" else room.unbook(slot, user, bool(is_admin)))
    held = room.owners
    state.update((list(held), [user for user, _ in held.values()], [since for _, since in held.values()]))
    outcome, by, since = zip(*answers)
    texts = {name: pd.array(values, dtype="string") for name, values in (("outcome", outcome), ("by", by))}
    yield log.assign(**texts, since=pd.array(since, dtype="Int64"))


def live_occupancy(outcomes: DataFrame, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """Slots held right now per room: plus one for each booking, minus one for each release."""
    step = F.when(F.col("outcome") == BOOKED, 1).otherwise(-1)
    moves = outcomes.where(F.col("outcome").isin(BOOKED, FREED))
    return moves.groupBy(*keys).agg(F.sum(step).cast("bigint").alias("held"))


def live_client_state(updates: DataFrame) -> DataFrame:
    """Last update per (type, id) of a stream of spot updates, for update or complete mode."""
    last = F.max_by(F.struct("reserved_by", "seq"), "seq").alias("last")
    return updates.groupBy("type", "id").agg(last).select("type", "id", "last.reserved_by", "last.seq")


def write_changes(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Publish a stream to a folder per micro-batch. A batch that is tried again replaces its own folder only."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )


def read_changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``write_changes`` published, with its ``batch`` number."""
    fields = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(fields).option("basePath", path).parquet(path)


# ---- a stored log as a stream -------------------------------------------------------------------------------------


def cut_log(log: DataFrame, slices: int) -> Iterator[DataFrame]:
    """The log in consecutive pieces of about equal size, as filters on ``seq`` at its quantiles; rows without one come first."""
    points = [n / slices for n in range(1, slices)]
    cuts = log.agg(F.percentile_approx("seq", points, 100 * slices)).first()[0] if points else None
    bounds = sorted(set(cuts or ()))
    seq = F.col("seq")
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = log if low is None else log.where(seq > low)
        yield part if high is None else part.where((seq <= high) | seq.isNull() if low is None else seq <= high)


def run_log(
    commands: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    mode: str = "append",
    slices: int = SLICES,
) -> DataFrame:
    """Feed a stored log to a streaming job piece by piece, and return what the job published.

    Each piece is written in parallel, in any number of files, and then taken up as one micro-batch by the same job,
    which finds its state and progress in its checkpoint. So the order holds however a piece is spread over files.
    """
    spark = commands.sparkSession
    log = commands.select(*GROUP_KEYS, *PAYLOAD)
    inbox, outbox, progress = (shared_path(spark, label) for label in ("inbox", "outbox", "progress"))
    published = None
    for number, part in enumerate(cut_log(log, slices)):
        part.write.mode("overwrite").parquet(f"{inbox}/slice={number:05d}")
        stream = build(spark.readStream.schema(log.schema).parquet(f"{inbox}/slice=*"))
        write_changes(stream, outbox, progress, mode).awaitTermination()
        published = stream.schema
    return read_changes(spark, outbox, published)


def outcomes_of_log(commands: DataFrame, slices: int = SLICES) -> DataFrame:
    """Outcomes of a stored log, computed by the streaming replay."""
    return run_log(commands, replay_stream, slices=slices).drop("batch")


def occupancy_of_log(commands: DataFrame) -> DataFrame:
    """Slots held per room at the end of a stored log, from the updates of the live count."""
    updates = run_log(commands, lambda stream: live_occupancy(replay_stream(stream)), "update")
    return updates.groupBy(*GROUP_KEYS).agg(F.max_by("held", "batch").alias("held"))
