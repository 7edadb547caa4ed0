"""Streams that go on from stored state, and the store: what is read after something failed, and which files are touched."""

from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException

from slotledger.operators.changes import settled_bookings
from slotledger.operators.replay import replay
from slotledger.operators.validation import valid_commands
from slotledger.plans import fixtures as X
from slotledger.sinks import state, versions
from slotledger.session import checkpoint
from slotledger.sources import snapshot
from slotledger.schemas import STORED_TABLES
from slotledger.streaming import follow, live

from conftest import rows

ANSWER = ("seq", "outcome", "by", "since")


@pytest.fixture(scope="module")
def log(spark, small):
    return checkpoint(valid_commands(X.commands(spark, small)).where("date < '2024-01-12'"))


@pytest.mark.parametrize("slices", [1, 4])
def test_batches_give_what_the_whole_log_gives(spark, log, slices):
    path = follow.replayed_log(log, follow.follow_bookings, slices)
    whole = replay(log)
    assert rows(follow.published(spark, path, "outcomes"), *ANSWER) == rows(whole, *ANSWER)
    last = versions.read_version(spark, f"{path}/state", slices - 1, ("bookings",))["bookings"]
    assert rows(last, "date", "shift", "kind", "slot", "user_id", "booked_seq") == rows(settled_bookings(whole))


def test_a_batch_that_fails_midway_is_tried_again_from_the_right_state(spark, log, tmp_path, monkeypatch):
    """The second batch fails after its results and its state are written, before the pointer; the stream then goes on."""
    inbox, path, progress = (str(tmp_path / n) for n in ("inbox", "out", "progress"))
    pieces, failed = list(live.cut_log(log, 3)), []

    def start():
        stream = spark.readStream.schema(log.schema).parquet(f"{inbox}/slice=*")
        return follow.follow_bookings(stream, path, progress)

    def failing(session, where, version, commit=versions.commit):
        if version == 1 and not failed:
            failed.append(version)
            raise RuntimeError("lost")
        commit(session, where, version)

    monkeypatch.setattr(versions, "commit", failing)
    for number, part in enumerate(pieces):
        part.write.parquet(f"{inbox}/slice={number}")
        if number == 1:
            with pytest.raises(StreamingQueryException):
                start().awaitTermination()
            assert versions.committed(spark, f"{path}/state") == 0
            assert Path(versions.folder(f"{path}/state", 1)).exists()
        start().awaitTermination()
    assert failed == [1]
    assert rows(follow.published(spark, path, "outcomes"), *ANSWER) == rows(replay(log), *ANSWER)


def _tables(spark, bookings):
    return {name: spark.createDataFrame([], schema) for name, schema in STORED_TABLES.items()} | {"bookings": bookings}


def _bookings(spark, *held):
    made = [("day", "desks", slot, user, day) for day, slot, user in held]
    df = spark.createDataFrame(made, "shift string, kind string, slot string, user_id string, date_raw string")
    return df.withColumn("date", df["date_raw"].cast("date"))


def test_readers_see_the_old_state_until_all_tables_are_written(spark, tmp_path, monkeypatch):
    store = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        snapshot.read_tables(spark, store)
    state.write_tables(_tables(spark, _bookings(spark, ("2026-01-05", "1", "a"))), store)
    broken = _tables(spark, _bookings(spark, ("2026-01-05", "1", "b")))
    broken["feedback"] = spark.range(1).selectExpr("cast(id as string) as id", "raise_error('lost') as name")
    with pytest.raises(Exception, match="lost"):
        state.write_tables(broken, store)
    assert (tmp_path / "version=1" / "bookings").exists()
    assert [r["user_id"] for r in snapshot.read_tables(spark, store)["bookings"].collect()] == ["a"]
    # The state may be replaced by what is computed from it.
    tables = snapshot.read_tables(spark, store)
    state.write_tables(tables | {"bookings": tables["bookings"].selectExpr("*").replace("a", "c", "user_id")}, store)
    assert [r["user_id"] for r in snapshot.read_tables(spark, store)["bookings"].collect()] == ["c"]
    assert versions.committed(spark, store) == 1


def test_only_touched_days_are_written_back(spark, tmp_path):
    store = str(tmp_path)
    held = _bookings(spark, ("2026-01-05", "1", "a"), ("2026-01-06", "1", "a"), ("2026-01-07", "1", "a"))
    state.write_tables(_tables(spark, held), store)

    def files():
        return {str(f.relative_to(store)): f.stat().st_mtime_ns for f in tmp_path.rglob("date=*/*.parquet")}

    before = files()
    new = _bookings(spark, ("2026-01-06", "1", "b"), ("2026-01-06", "2", "c"))
    touched = spark.sql("select explode(array(date'2026-01-05', date'2026-01-06')) as date")
    state.write_days(new, store, touched)
    after = files()
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("date=")[1][:10] for f in same} == {"2026-01-07"}
    left = snapshot.read_tables(spark, store)["bookings"]
    assert rows(left, "date_raw", "slot", "user_id") == [("2026-01-06", "1", "b"), ("2026-01-06", "2", "c"), ("2026-01-07", "1", "a")]
    state.write_days(_bookings(spark, ("2026-01-05", "4", "d")), store)
    assert [r["slot"] for r in snapshot.read_tables(spark, store)["bookings"].where("date = '2026-01-05'").collect()] == ["4"]
