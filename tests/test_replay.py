import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from conftest import rows
from model import as_commands, random_commands, replay_model
from slotledger.operators import changes
import slotledger.operators.replay as replay_module
from slotledger.operators.replay import replay
from slotledger.operators.spots import client_state, spot_updates
from slotledger.plans.changefeed import messages
from slotledger.streaming import live


def cmd(seq, op, slot, user, is_admin=False, **room):
    base = {"date": "2026-01-05", "shift": "day", "kind": "desks"}
    return {"seq": seq, **base, **room, "slot": slot, "op": op, "user_id": user, "is_admin": is_admin}


def answers(df):
    return {r["seq"]: (r["outcome"], r["by"]) for r in df.collect()}


def test_every_rule_once(spark):
    log = [
        cmd(1, "book", "1", "ann"),
        cmd(2, "book", "1", "ann"),
        cmd(3, "book", "1", "bo"),
        cmd(4, "book", "2", "ann"),
        cmd(5, "book", "1", "ann", kind="parking"),
        cmd(6, "unbook", "2", "ann"),
        cmd(7, "unbook", "1", "bo"),
        cmd(8, "unbook", "1", "bo", is_admin=True),
        cmd(9, "book", "99", "ann"),
        cmd(10, "unbook", "99", None),
        cmd(11, "book", "2", "ann"),
        cmd(12, "unbook", "2", ""),
        cmd(13, "book", "1", "nobody", shift="weekend"),
    ]
    assert answers(replay(as_commands(spark, log))) == {
        1: ("booked", "ann"),
        2: ("rebook", "ann"),
        3: ("taken", "ann"),
        4: ("already_booked", None),
        5: ("booked", "ann"),
        6: ("noop", None),
        7: ("not_yours", "ann"),
        8: ("freed", "ann"),
        9: ("booked", "ann"),
        10: ("freed", "ann"),
        11: ("booked", "ann"),
        12: ("freed", "ann"),
        13: ("booked", "nobody"),
    }


@pytest.mark.parametrize(
    "shape",
    [
        {"slots": 5, "users": 7},
        {"slots": 30, "users": 12},
        {"slots": 6, "users": 40, "unbooks": 0.0},
        {"slots": 200, "users": 150, "unbooks": 0.02},
    ],
)
def test_chunks_match_the_model(spark, shape):
    """A hot room cut into many chunks gives the sequential outcomes, whether slots are freed often or never."""
    log = random_commands(seed=11, count=900, hot=0.8, **shape)
    expected, held = replay_model(log)
    result = replay(as_commands(spark, log), chunk_rows=100).cache()
    assert answers(result) == expected
    settled = changes.settled_bookings(result)
    assert {tuple(r)[:4]: r["user_id"] for r in settled.collect()} == held
    # intervals do not depend on where the log was cut either
    whole = changes.occupancy_intervals(replay(as_commands(spark, log)))
    assert rows(changes.occupancy_intervals(result)) == rows(whole)


def test_chunk_number_is_bounded(spark):
    log = random_commands(seed=3, count=600, hot=1.0)
    result = replay(as_commands(spark, log), chunk_rows=10, max_chunks=3)
    assert answers(result) == replay_model(log)[0]


command = st.tuples(
    st.sampled_from(["book", "book", "unbook"]),
    st.sampled_from("1234"),
    st.sampled_from(["a", "b", "c", None]),
    st.booleans(),
    st.sampled_from(["day", "night"]),
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(command, min_size=1, max_size=120))
def test_batch_stream_and_model_agree(spark, drawn):
    log = []
    for seq, (op, slot, user, is_admin, shift) in enumerate(drawn):
        user = "d" if op == "book" and user is None else user
        log.append(cmd(seq, op, slot, user, is_admin and op == "unbook", shift=shift))
    expected, held = replay_model(log)
    commands = as_commands(spark, log)
    batch = replay(commands)
    assert answers(batch) == expected
    assert answers(replay(commands.orderBy("slot", "seq"))) == expected
    spans = changes.occupancy_intervals(batch).collect()
    # never two owners of one slot at a time, and open spans are exactly the held slots
    by_slot = {}
    for s in sorted(spans, key=lambda s: s["valid_from"]):
        key = (s["date"], s["shift"], s["kind"], s["slot"])
        assert by_slot.get(key, -1) is not None and by_slot.get(key, -1) < s["valid_from"]
        by_slot[key] = s["valid_to"]
    assert {k for k, until in by_slot.items() if until is None} == set(held)
    # a user holds at most one slot per room
    holders = [(*k[:3], u) for k, u in held.items()]
    assert len(holders) == len(set(holders))


@pytest.mark.parametrize("slices", [1, 3])
def test_stream_matches_model_for_any_split(spark, slices):
    log = random_commands(seed=5, count=120)
    expected, held = replay_model(log)
    assert answers(live.outcomes_of_log(as_commands(spark, log), slices)) == expected


def test_live_occupancy_matches_model(spark):
    log = random_commands(seed=6, count=150)
    counts = {}
    for key in replay_model(log)[1]:
        counts[key[:3]] = counts.get(key[:3], 0) + 1
    live_counts = {tuple(r)[:3]: r["held"] for r in live.occupancy_of_log(as_commands(spark, log)).collect()}
    assert {k: n for k, n in live_counts.items() if n} == counts


def test_published_batches_are_replaced_not_repeated(spark, tmp_path):
    commands = as_commands(spark, random_commands(seed=8, count=40))
    commands.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(commands.schema).parquet(str(tmp_path / "in"))
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for _ in range(2):
        live.write_changes(stream, out, progress).awaitTermination()
    assert live.read_changes(spark, out, stream.schema).count() == 40


def test_published_feed_of_bookings(spark):
    log = random_commands(seed=10, count=80)
    shown = [q for q, (outcome, _) in replay_model(log)[0].items() if outcome in ("booked", "rebook", "freed")]
    feed = live.run_log(as_commands(spark, log), lambda stream: changes.booking_changes(live.replay_stream(stream)))
    texts = {r["seq"]: json.loads(r["message"]) for r in messages(feed).collect()}
    assert sorted(texts) == shown
    assert all(t["action"] == "booking" and t["ref"].count("|") == 3 for t in texts.values())


def test_live_client_state(spark):
    commands = as_commands(spark, random_commands(seed=9, count=60))
    shown = live.run_log(commands, lambda stream: live.live_client_state(spot_updates(stream)), "update")
    latest = shown.groupBy("type", "id").agg(F.max_by("reserved_by", "seq").alias("reserved_by"), F.max("seq").alias("seq"))
    assert rows(latest) == rows(client_state(spot_updates(commands)))


def test_replay_goes_on_from_stored_rooms(spark):
    stored = [("1", "ann", 5), ("2", "ann", 6), ("3", "", None), ("4", "", None), ("5", "bo", None)]
    held = as_commands(spark, [cmd(1, "book", slot, user) for slot, user, _ in stored]).select("date", "shift", "kind", "slot", "user_id")
    log = as_commands(spark, [
        cmd(11, "unbook", "1", "ann"),
        cmd(12, "book", "9", "ann"),  # still on slot 2
        cmd(13, "book", "2", "ann"),
        cmd(14, "book", "3", "cy"),  # an empty holder does not hold
        cmd(15, "unbook", "4", "cy"),
        cmd(16, "unbook", "4", None),
        cmd(17, "book", "5", "dee"),
        cmd(18, "unbook", "2", "ann"),
        cmd(19, "book", "9", "ann"),
    ])
    for chunk_rows in (4_000_000, 3):
        found = replay(log, held=held, chunk_rows=chunk_rows)
        assert answers(found) == {
            11: ("freed", "ann"), 12: ("already_booked", None), 13: ("rebook", "ann"), 14: ("booked", "cy"),
            15: ("not_yours", ""), 16: ("freed", ""), 17: ("taken", "bo"), 18: ("freed", "ann"), 19: ("booked", "ann"),
        }
        settled = changes.settled_bookings(found, held=held)
        assert rows(settled, "slot", "user_id") == [("3", "cy"), ("5", "bo"), ("9", "ann")]


@pytest.mark.parametrize("cut,chunk_rows", [(150, 4_000_000), (150, 40), (290, 40)])
def test_halves_give_the_whole(spark, cut, chunk_rows):
    log = as_commands(spark, [cmd(i, "unbook" if i % 4 == 0 else "book", str(i * 7 % 12), f"u{i * 5 % 17}") for i in range(1, 301)])
    whole = replay(log)
    first = replay(log.where(f"seq <= {cut}"))
    second = replay(log.where(f"seq > {cut}"), held=changes.settled_bookings(first), chunk_rows=chunk_rows)
    assert rows(first.unionByName(second)) == rows(whole)


def test_rounds_do_not_grow_with_the_chunks(spark, monkeypatch):
    log = random_commands(seed=12, count=1500, slots=60, users=45, rooms=1, unbooks=0.05)  # forgets slowly
    passes = []
    effects = replay_module._chunk_effects
    monkeypatch.setattr(replay_module, "_chunk_effects", lambda *args: passes.append(args[-1]) or effects(*args))
    found = replay(as_commands(spark, log), chunk_rows=10)
    assert answers(found) == replay_model(log)[0]
    assert len(passes) <= 8  # of 150 chunks: as they are cut, twice again, and four of them as one until one is left
    assert max(passes) <= max(10, int(spark.conf.get("spark.sql.shuffle.partitions")))  # small chunks share tasks


def test_merged_effects_are_what_neighbours_did_one_after_the_other(spark):
    told = [
        (0, "a", "set", "x", 1), (1, "a", "fill", "y", 2), (2, "a", "keep", None, None),
        (0, "b", "set", None, None), (3, "b", "fill", "y", 3),
        (0, "c", "fill", "x", 1), (1, "c", "fill", "z", 4), (4, "c", "set", "w", 9),
        (1, "d", "keep", "x", 1),
        (0, "e", "fill", "x", 1), (2, "e", "set", "z", 5),
    ]
    effects = spark.createDataFrame([("k", c, "slot", *rest) for c, *rest in told], "g string, chunk int, side string, name string, effect string, user_id string, since bigint")
    assert rows(replay_module._merged_effects(effects, ["g"]), "chunk", "name", "effect", "user_id", "since") == [
        (0, "a", "set", "x", 1), (0, "b", "set", "y", 3), (0, "c", "fill", "x", 1), (0, "d", "keep", None, None), (0, "e", "set", "z", 5),
        (1, "c", "set", "w", 9),
    ]
