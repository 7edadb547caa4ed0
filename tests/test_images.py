"""Day images of booking events against a replay that keeps the whole day."""

import pytest

from slotledger.operators import images
from slotledger.operators.changes import settled_bookings
from slotledger.operators.replay import replay
from slotledger.operators.validation import valid_commands
from slotledger.plans import fixtures as X
from slotledger.session import checkpoint


def plain_images(outcomes):
    held, out = {}, []
    for r in sorted(outcomes, key=lambda r: r.seq):
        if r.outcome == "booked":
            held[r.date, r.shift, r.kind, r.slot] = r.user_id
        elif r.outcome == "freed":
            del held[r.date, r.shift, r.kind, r.slot]
        elif r.outcome != "rebook":
            continue
        out.append((r.seq, ",".join(sorted(f"{s}|{k}|{n}={u}" for (d, s, k, n), u in held.items() if d == r.date))))
    return out


@pytest.mark.parametrize("one_day", [False, True])
def test_images_equal_a_replay(spark, small, one_day):
    log = valid_commands(X.commands(spark, small))
    if one_day:  # all of the log on one busy day, with few slots, so that they change hands often
        log = log.selectExpr("seq", "date'2026-01-05' as date", "'day' as shift", "kind", "slot", "if(seq % 3 = 0, 'unbook', op) as op", "user_id", "true as is_admin")
        log = valid_commands(log)
    outcomes = checkpoint(replay(log))
    found = images.event_images(outcomes)
    assert sorted((r.seq, r.image) for r in found.collect()) == plain_images(outcomes.collect())
    half = log.where("seq <= 500"), log.where("seq > 500")
    held = checkpoint(settled_bookings(replay(half[0])))
    resumed = images.event_images(replay(half[1], held=held.drop("booked_seq")), held.drop("booked_seq"))
    assert sorted((r.seq, r.image) for r in resumed.collect()) == [r for r in plain_images(outcomes.collect()) if r[0] > 500]


def test_a_busy_day_is_spread_over_ranges(spark, small):
    log = valid_commands(X.commands(spark, small)).selectExpr("seq", "date'2026-01-05' as date", "'day' as shift", "kind", "slot", "if(seq % 2 = 0, 'unbook', op) as op", "user_id", "true as is_admin")
    outcomes = checkpoint(replay(valid_commands(log)))
    shown = outcomes.where("outcome in ('booked', 'rebook', 'freed')").select("seq", "date")
    cut, ranges = images.cutter(shown, "seq")
    events = cut(shown).withColumn("range", images.F.col("range").cast("int"))
    index = images.interval_index(images.occupancy_intervals(outcomes), events, cut)
    n = outcomes.where("outcome = 'booked'").count()
    largest = max(r["count"] for r in index.groupBy("date", "range").count().collect())
    assert ranges > 2 and largest <= n / ranges + 38 + 20  # new ones, and at most 38 slots held at the range's start
