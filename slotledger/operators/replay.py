"""Ordered replay of the book / unbook log.

Whether a command succeeds depends on earlier successes and releases in the same (date, shift, kind), and on nothing
outside it. Such a group is replayed in arrival order by a streaming pass over sorted Arrow batches, which keeps the
room in memory but never the group's rows.

A group that outgrows one task is cut along the log into chunks that run side by side:

1. range partitioning by (group, seq) cuts the log into even chunks, however skewed the groups are, and a checkpoint
   fixes the cut;
2. every chunk is replayed from a guess of the room it starts with (at first: empty) and reports what it did to
   each slot: set it (freed on the way), filled it if empty, or kept it;
3. those reports are composed along the chunks with windows, one row per chunk and slot, which gives every chunk a
   new guess of the slots and users it deals with;
4. chunks whose guess changed run again, until none does;
5. where that takes more than ``SAME_CHUNKS`` rounds, ``MERGED`` neighbouring chunks become one in every further round.

The first chunk of a group starts from an empty room and is right at once, and a chunk is right when all before it
are. So a state where no guess changes is the sequential result, exactly. Occupancy is forgotten as slots are freed and
sticks where they are not, and the composition covers both, so few rounds are needed in practice. A log that forgets too slowly
for its chunks gets longer ones, so the rounds grow with the logarithm of a group's chunks, and the longest task of all rounds together
is no more than a pass or two over a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from itertools import count, islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slotledger.operators.room import BOOKED, FREED, Room
from slotledger.operators.skew import MOST_GROUPS, LargeGroups, large_groups
from slotledger.schemas import GROUP_KEYS
from slotledger.session import checkpoint

# Largest group replayed in one piece, and size of the chunks of larger ones.
CHUNK_ROWS = 4_000_000
# Chunks grow with the log beyond this many, so lists of chunks and of large groups stay this short.
MAX_CHUNKS = MOST_GROUPS

# Rounds with chunks as they were cut, and how many of them become one in each round after these.
SAME_CHUNKS = 2
MERGED = 4

PAYLOAD = ("seq", "slot", "op", "user_id", "is_admin")
# Rows that set a room up: from a guess of what came before, and from stored bookings.
PLACE, STORED = "place", "stored"
SET, FILL, KEEP = "set", "fill", "keep"
BY_SLOT, BY_USER = "slot", "user"


def replay(
    commands: DataFrame,
    keys: Sequence[str] = GROUP_KEYS,
    chunk_rows: int = CHUNK_ROWS,
    max_chunks: int = MAX_CHUNKS,
    held: DataFrame | None = None,
) -> DataFrame:
    """Outcome of every valid command: the payload plus ``outcome``, ``by`` and ``since``.

    ``held`` are stored bookings (keys, slot, user_id, and ``booked_seq`` where known) that the log goes on from; their
    numbers are below the log's. Rooms stored in a way the rule would not leave them (a user on two slots, an empty holder) are
    replayed in one piece, whatever their size.

    ``by`` is the holder of the slot in question (after a booking, before a release, and in refusals);
    ``since`` is the ``seq`` of the command that holder booked with. ``seq`` must be unique within a group.
    """
    log = commands.select(*keys, *PAYLOAD)
    stored = None if held is None else _stored_rows(held, log, keys)
    large = large_groups(log, keys, chunk_rows, max_chunks)
    if large is not None and stored is not None:
        large = _without_odd_rooms(large, stored, keys)
    if large is None:
        return _replay_groups(_after(stored, log), keys)
    marks = F.broadcast(large.keys)  # fewer than max_chunks rows
    chunks = -(-large.rows // large.limit)
    shuffle = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(chunks, max(shuffle, -(-large.rows // CHUNK_ROWS)))  # small chunks share a task
    rows = _after(stored, log)
    return _replay_groups(rows.join(marks, list(keys), "left_anti"), keys).unionByName(
        _replay_chunks(rows.join(marks, list(keys), "left_semi"), keys, chunks, tasks)
    )


def _stored_rows(held: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored bookings of the rooms that the log deals with, in the log's columns."""
    since = F.col("booked_seq") if "booked_seq" in held.columns else F.lit(None)
    rows = held.select(
        *keys,
        since.cast("bigint").alias("seq"),
        "slot",
        F.lit(STORED).alias("op"),
        F.coalesce("user_id", F.lit("")).alias("user_id"),
        F.lit(False).alias("is_admin"),
    )
    return rows.join(log.select(*keys).distinct(), list(keys), "left_semi")


def _after(stored: DataFrame | None, log: DataFrame) -> DataFrame:
    return log if stored is None else stored.unionByName(log)


def _without_odd_rooms(large: LargeGroups, stored: DataFrame, keys: Sequence[str]) -> LargeGroups | None:
    """Large groups whose stored rooms have one slot per user: what is composed along chunks is one slot per user."""
    odd = stored.groupBy(*keys, "user_id").agg(F.count("*").alias("n")).where("n > 1 or user_id = ''").select(*keys)
    kept = checkpoint(large.keys.join(odd.distinct(), list(keys), "left_anti"))
    return None if kept.isEmpty() else replace(large, keys=kept)


def _replay_groups(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    ordered = log.repartition(*keys).sortWithinPartitions(*keys, "seq")
    return _outcomes(ordered, keys, log)


def _outcomes(ordered: DataFrame, unit: Sequence[str], log: DataFrame) -> DataFrame:
    fields = [T.StructField(f.name, f.dataType) for f in log.schema]
    answer = [
        T.StructField("outcome", T.StringType()),
        T.StructField("by", T.StringType()),
        T.StructField("since", T.LongType()),
    ]
    return ordered.mapInArrow(_outcome_pass(unit, log.columns), T.StructType([*fields, *answer]))


# ---- passes over sorted batches -------------------------------------------------------------------------------


def _edges(batch: pa.RecordBatch, keys: Sequence[str]) -> list[int]:
    """Row numbers where a new key starts, and the end."""
    changes = pa.array([False] * (batch.num_rows - 1), pa.bool_())
    for key in keys:
        column = batch.column(key)
        differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
        changes = pc.or_(changes, pc.fill_null(differs, True))
    return [0, *pc.add(pc.indices_nonzero(changes), 1).to_pylist(), batch.num_rows]


class _Walk:
    """Walks sorted batches run by run and keeps one room per key across batch borders.

    Only the current room is held; ``close`` gets it when its key is done.
    """

    def __init__(self, keys: Sequence[str], new: Callable[[], Room], close: Callable | None = None) -> None:
        self.keys, self.new, self.close = keys, new, close
        self.key, self.room = None, None

    def runs(self, batch: pa.RecordBatch) -> Iterator[tuple[Room, Iterator[tuple]]]:
        """Each run of the batch as its room and its commands."""
        rows = zip(*(batch.column(name).to_pylist() for name in PAYLOAD))
        edges = _edges(batch, self.keys)
        for start, stop in zip(edges, edges[1:]):
            key = tuple(batch.column(k)[start].as_py() for k in self.keys)
            if key != self.key:
                self.finish()
                self.key, self.room = key, self.new()
            yield self.room, islice(rows, stop - start)

    def finish(self) -> None:
        if self.room is not None and self.close is not None:
            self.close(self.key, self.room)


def _apply(room: Room, command: tuple) -> tuple | None:
    seq, slot, op, user, is_admin = command
    if op == "book":
        return room.book(seq, slot, user)
    if op == "unbook":
        return room.unbook(slot, user, is_admin)
    room.place(slot, user, seq)
    return None


def _outcome_pass(keys: Sequence[str], names: Sequence[str]) -> Callable:
    """Returns the commands with their outcomes. Placements only set a room up and are not returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(keys, Room)
        for batch in batches:
            if not batch.num_rows:
                continue
            answers = [_apply(room, command) for room, commands in walk.runs(batch) for command in commands]
            answers = [answer for answer in answers if answer is not None]
            kept = batch.select(list(names))
            if len(answers) < batch.num_rows:
                kept = kept.filter(pc.invert(pc.is_in(batch.column("op"), pa.array([PLACE, STORED]))))
            outcome, by, since = zip(*answers) if answers else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(outcome, pa.string()), pa.array(by, pa.string()), pa.array(since, pa.int64())],
                names=[*names, "outcome", "by", "since"],
            )

    return run


class _Watched(Room):
    """A room that notes what a chunk deals with and how it changes each slot."""

    __slots__ = ("effects", "users")

    def __init__(self) -> None:
        super().__init__()
        self.effects: dict[str, str] = {}
        self.users: set[str] = set()

    def note(self, slot: str, user: str | None, outcome: str) -> None:
        if user:
            self.users.add(user)
        if outcome == FREED:
            self.effects[slot] = SET
        elif outcome == BOOKED:
            if self.effects.get(slot) != SET:
                self.effects[slot] = FILL
        else:
            self.effects.setdefault(slot, KEEP)


def _effect_pass(keys: Sequence[str], schema: pa.Schema) -> Callable:
    """Returns only what each chunk did: a row per slot and per user it dealt with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def close(key: tuple, room: _Watched) -> None:
            for slot, effect in room.effects.items():
                rows.append((*key, BY_SLOT, slot, effect, *room.owners.get(slot, (None, None))))
            for user in room.users:
                rows.append((*key, BY_USER, user, None, None, None))

        def drain() -> Iterator[pa.RecordBatch]:
            if rows:
                columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                rows.clear()

        walk = _Walk(keys, _Watched, close)
        for batch in batches:
            if not batch.num_rows:
                continue
            for room, commands in walk.runs(batch):
                for command in commands:
                    answer = _apply(room, command)
                    if answer is not None:
                        room.note(command[1], command[3], answer[0])
                    elif command[2] == STORED:  # the chunk starts with it, as if it had been booked there
                        room.note(command[1], command[3], BOOKED)
            yield from drain()
        walk.finish()
        yield from drain()

    return run


# ---- chunked replay -------------------------------------------------------------------------------------------


def _replay_chunks(log: DataFrame, keys: Sequence[str], chunks: int, tasks: int) -> DataFrame:
    """Replay large groups chunk by chunk until no chunk's starting room changes any more."""
    unit = [*keys, "chunk"]
    cut = log.repartitionByRange(chunks, *keys, "seq").withColumn("chunk", F.spark_partition_id())
    cut = checkpoint(cut.coalesce(tasks))  # the cut comes from a sample, so it must be taken only once

    effects = checkpoint(_chunk_effects(cut, None, unit, tasks))
    rooms = checkpoint(_starting_rooms(effects, keys))
    changed = rooms.select("chunk").distinct()
    for turn in count():
        if changed.isEmpty():
            break
        if turn < SAME_CHUNKS:
            again = F.broadcast(changed)  # chunk numbers only, at most max_chunks of them
            redone = _chunk_effects(
                cut.join(again, "chunk", "left_semi"), rooms.join(again, "chunk", "left_semi"), unit, tasks
            )
            effects = checkpoint(effects.join(again, "chunk", "left_anti").unionByName(redone))
        else:  # all of them run again: a merged chunk's guess may be another than its parts had
            cut = cut.withColumn("chunk", _merged_chunk())
            rooms = checkpoint(_starting_rooms(_merged_effects(effects, keys), keys))
            effects = checkpoint(_chunk_effects(cut, rooms, unit, tasks))
        previous, rooms = rooms, checkpoint(_starting_rooms(effects, keys))
        changed = checkpoint(_changed_chunks(previous, rooms))
    return _outcomes(_with_rooms(cut, rooms, unit, tasks), unit, log)


def _merged_chunk() -> Column:
    return F.floor(F.col("chunk") / MERGED).cast("int")


def _merged_effects(effects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What ``MERGED`` neighbouring chunks did together to each slot, as ``_chunk_effects`` reports it for one."""
    told = F.struct("chunk", "effect", "user_id", "since")
    merged = effects.groupBy(*keys, _merged_chunk().alias("merged"), "side", "name").agg(
        F.array_sort(F.collect_list(told)).alias("told")  # at most MERGED of them
    )
    last_set = F.array_max(F.transform(F.filter("told", lambda t: t.effect == SET), lambda t: t.chunk))
    left = F.filter(
        "told", lambda t: (t.chunk >= F.coalesce(last_set, t.chunk)) & (t.effect != KEEP) & t.user_id.isNotNull()
    )
    filled = F.exists("told", lambda t: t.effect == FILL)
    return merged.select(
        *keys,
        F.col("merged").alias("chunk"),
        "side",
        "name",
        F.when(last_set.isNotNull(), SET).when(filled, FILL).otherwise(KEEP).alias("effect"),
        F.get(left, 0).user_id.alias("user_id"),
        F.get(left, 0).since.alias("since"),
    )


def _with_rooms(cut: DataFrame, rooms: DataFrame | None, unit: Sequence[str], tasks: int) -> DataFrame:
    """Each chunk in one partition, its placements first: they carry the ``seq`` of earlier commands."""
    names = [*unit, *PAYLOAD]
    rows = cut.select(*names)
    if rooms is not None:
        placements = rooms.select(
            *unit,
            F.col("since").alias("seq"),
            "slot",
            F.lit(PLACE).alias("op"),
            "user_id",
            F.lit(False).alias("is_admin"),
        )
        rows = rows.unionByName(placements)
    return rows.repartition(tasks, *unit).sortWithinPartitions(*unit, "seq")


def _chunk_effects(cut: DataFrame, rooms: DataFrame | None, unit: Sequence[str], tasks: int) -> DataFrame:
    fields = [T.StructField(name, cut.schema[name].dataType) for name in unit]
    texts = [T.StructField(name, T.StringType()) for name in ("side", "name", "effect", "user_id")]
    schema = T.StructType([*fields, *texts, T.StructField("since", T.LongType())])
    ordered = _with_rooms(cut, rooms, unit, tasks)
    return ordered.mapInArrow(_effect_pass(unit, to_arrow_schema(schema)), schema)


def _starting_rooms(effects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What each chunk must know of the room it starts with: (keys, chunk, slot, user_id, since).

    Every window below runs over effects, which have a row per chunk for a slot or a user, never over commands.
    """
    holder = F.struct("user_id", "since")
    along = Window.partitionBy(*keys, "name").orderBy("chunk")
    stretch = Window.partitionBy(*keys, "name", "stretch").orderBy("chunk")
    slots = (
        effects.where(F.col("side") == BY_SLOT)
        # A slot that was freed in a chunk starts anew with what that chunk left; later chunks only fill it.
        .withColumn("stretch", F.sum((F.col("effect") == SET).cast("int")).over(along))
        .withColumn("left", F.when((F.col("effect") != KEEP) & F.col("user_id").isNotNull(), holder))
        .withColumn("after", F.first("left", ignorenulls=True).over(stretch))
        .withColumn("before", F.lag("after").over(along))
    )
    of_slots = slots.where(F.col("before").isNotNull()).select(
        *keys, "chunk", F.col("name").alias("slot"), "before.user_id", "before.since"
    )
    # The slot a user comes in with: the last one taken in an earlier chunk and not given up before this one.
    moves = slots.where(~F.col("after").eqNullSafe(F.col("before"))).withColumn("until", F.lead("chunk").over(along))
    taken = moves.where(F.col("after").isNotNull()).select(
        *keys,
        F.col("after.user_id").alias("user_id"),
        "chunk",
        F.lit(1).alias("step"),
        F.struct(F.col("name").alias("slot"), "after.since", "until").alias("stay"),
    )
    seen = effects.where(F.col("side") == BY_USER).select(
        *keys,
        F.col("name").alias("user_id"),
        "chunk",
        F.lit(0).alias("step"),
        F.lit(None).cast(taken.schema["stay"].dataType).alias("stay"),
    )
    by_user = Window.partitionBy(*keys, "user_id").orderBy("chunk", "step")
    of_users = (
        taken.unionByName(seen)
        .withColumn("last", F.last("stay", ignorenulls=True).over(by_user))
        .where((F.col("step") == 0) & F.col("last").isNotNull())
        .where(F.col("last.until").isNull() | (F.col("last.until") >= F.col("chunk")))
        .select(*keys, "chunk", "last.slot", "user_id", "last.since")
    )
    return of_slots.unionByName(of_users).distinct()


def _changed_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    tagged = old.withColumn("side", F.lit(-1)).unionByName(new.withColumn("side", F.lit(1)))
    return (
        tagged.groupBy(*old.columns).agg(F.sum("side").alias("side")).where("side <> 0").select("chunk").distinct()
    )
