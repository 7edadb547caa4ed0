import random

import pytest

from conftest import rows
from model import EMPLOYEE_DDL, employees_model, feedback_model, random_employee_log
from slotledger.operators import employees, feedback, scan, settings, spots
from slotledger.operators.skew import large_groups


def config(spark, entries):
    return spark.createDataFrame(entries, "seq bigint, key string, raw_value string")


def test_settings_keep_the_last_readable_number(spark):
    log = config(
        spark,
        [
            (1, "desks", "12"),
            (2, "desks", " +1_3\t"),
            (3, "desks", "12.7"),
            (4, "desks", "x"),
            (5, "parking", None),
            (6, "targetDays", "99999999999999999999"),
            (7, "other", "5"),
        ],
    )
    assert dict(settings.effective_settings(log).collect()) == {
        "desks": 13,
        "parking": 10,
        "targetDays": 2,
        "year": 2026,
    }


def test_list_settings_are_replaced_whole(spark):
    log = config(spark, [(1, "unavailableDesks", "9"), (2, "unavailableDesks", "3, x,5,3"), (3, "unavailableParking", "")])
    got = {r["key"]: r["numbers"] for r in settings.effective_lists(log).collect()}
    assert got == {"unavailableDesks": [3, 5, 3], "unavailableParking": []}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_employee_fold_matches_model(spark, seed):
    log = random_employee_log(seed, 400)
    names = [part.split()[0] for part in EMPLOYEE_DDL.split(", ")]
    df = spark.createDataFrame([tuple(c[n] for n in names) for c in log], EMPLOYEE_DDL)
    people, refused = employees_model(log)
    got = {r["id"]: r.asDict() for r in employees.current_employees(df).collect()}
    assert {i: {k: got[i][k] for k in people[i]} for i in got} == people
    assert sorted((r["seq"], r["op"]) for r in employees.employee_rejects(df).collect()) == refused
    assert employees.employee_changes(df).count() == len(log) - len(refused)
    assert employees.judge(df).where("error is not null").count() == len(refused)


def test_adaptive_execution_splits_a_busy_employee(spark):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000",
    }
    names = [part.split()[0] for part in EMPLOYEE_DDL.split(", ")]
    empty = dict.fromkeys(names)
    log = [empty | {"seq": i, "id": f"e{i}", "op": "add", "name": f"n{i}"} for i in range(50)]
    log += [empty | {"seq": 50 + i, "id": "e7", "op": "update", "name": f"again {i}"} for i in range(20_000)]
    df = spark.createDataFrame([tuple(c[n] for n in names) for c in log], EMPLOYEE_DDL).repartition(8)
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        judged = employees.judge(df)
        assert len(judged.where("error is null").collect()) == len(log)
        judged.collect()
        assert "skew=true" in judged._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_failed_add_leaves_nothing(spark):
    log = [
        (1, "e1", "add", "A", "d", "day", None, "x", None, None),
        (2, "e1", "update", "B", None, None, None, None, None, None),
        (3, "e2", "delete", None, None, None, None, None, None, None),
        (4, "e2", "add", "C", None, None, "night", None, None, None),
    ]
    df = spark.createDataFrame(log, EMPLOYEE_DDL)
    assert rows(employees.employee_rejects(df), "seq", "error") == [
        (1, "Bad target days"),
        (2, "Employee not found"),
        (3, "Employee not found"),
    ]
    assert rows(employees.current_employees(df), "id", "name", "shift", "target_days") == [("e2", "C", "night", 2)]


def test_target_is_the_one_configured_at_the_time(spark):
    adds = spark.createDataFrame([(1, "a"), (5, "b"), (9, "c")], "seq bigint, id string")
    log = config(spark, [(3, "targetDays", "4"), (4, "desks", "7"), (6, "targetDays", "oops"), (8, "targetDays", "1")])
    assert rows(settings.target_as_of(adds, log), "seq", "default_target") == [(1, 2), (5, 4), (9, 1)]


def test_feedback_is_cleaned(spark):
    log = [
        (1, "submit", "a", None, "  hi\n", None),
        (2, "submit", "b", "", " x" + "y" * 2000, "bug"),
        (3, "submit", "c", "   ", "\x1c ok ", None),
        (4, "submit", "d", " " + "n" * 100, " \t\n", None),
    ]
    df = spark.createDataFrame(log, "seq bigint, op string, fb_id string, name string, message string, category string")
    got = {r["fb_id"]: r for r in feedback.clean_submissions(df).collect()}
    assert [got[k]["name"] for k in "abc"] == ["Anonymous", "Anonymous", ""]
    assert (got["a"]["message"], got["c"]["message"]) == ("hi", "ok")
    assert len(got["b"]["message"]) == 1000 and len(got["d"]["name"]) == 80
    assert (got["a"]["category"], got["b"]["category"]) == ("general", "bug")
    assert [got[k]["error"] for k in "abcd"] == [None, None, None, "Message required"]


@pytest.mark.parametrize("seed", [4, 5])
def test_feedback_fold_matches_model(spark, seed):
    rng = random.Random(seed)
    log, last = [], 0
    for seq in range(1, 300):
        op = rng.choice(["submit", "read", "delete"])
        ident = last = last + 1 if op == "submit" else last
        if op != "submit":
            ident = rng.randrange(0, max(last, 1) + 3)
        log.append((seq, op, ident, rng.choice(["hello", "hello", "  "]) if op == "submit" else None))
    df = spark.createDataFrame(
        [(s, o, i, None, m, None) for s, o, i, m in log],
        "seq bigint, op string, fb_id bigint, name string, message string, category string",
    )
    stored, refused, counts = feedback_model(log)
    assert dict(feedback.current_feedback(df).select("fb_id", "read").collect()) == stored
    assert sorted(r["seq"] for r in feedback.feedback_rejects(df).collect()) == refused
    assert sorted((r["seq"], r["count"]) for r in feedback.feedback_counts(df).collect()) == counts
    # with one id edited far more often than the others, and unknown ones without an id
    busy = [(1000 + n, "read" if n % 3 else "delete", 2 if n % 2 else None, None, None, None) for n in range(60)]
    more = df.unionByName(df.sparkSession.createDataFrame(busy, df.schema))
    stored, refused, _ = feedback_model(log + [(q, o, i, None) for q, o, i, *_ in busy])
    assert sorted(r["seq"] for r in feedback.feedback_rejects(more).collect()) == refused
    left = feedback.histories(more).where("deleted is null")
    assert {r["fb_id"]: r["first_read"] is not None for r in left.collect()} == stored


def test_large_groups(spark):
    df = spark.range(100).selectExpr("case when id < 60 then 0 when id < 90 then 1 else id end as k")
    assert large_groups(df, ["k"], limit=60) is None
    found = large_groups(df, ["k"], limit=20)
    assert rows(found.keys) == [(0,), (1,)] and found.rows == 90
    assert rows(large_groups(df, ["k"], limit=20, most=2).keys) == [(0,)]
    assert large_groups(df.limit(0), ["k"], limit=1) is None


def test_global_scans(spark):
    rng = random.Random(7)
    data = [(n * 3, rng.randrange(-5, 9)) for n in range(500)]
    known = [(rng.randrange(1500) * 2 + 1, n) for n in range(40)] + [(9999, 1)]
    df = spark.createDataFrame(data, "seq bigint, step bigint").repartition(7)
    history = spark.createDataFrame(list(dict(known).items()), "seq bigint, value bigint")
    total, sums, latest = 0, {}, {}
    for seq, step in data:
        total += step
        sums[seq] = total
        earlier = [k for k in dict(known) if k <= seq]
        latest[seq] = dict(known)[max(earlier)] if earlier else None
    assert {r["seq"]: r["total"] for r in scan.running_total(df, "seq", "step", "total").collect()} == sums
    assert {r["seq"]: r["value"] for r in scan.as_of(df, history, "seq", "value").collect()} == latest
    assert {r["seq"]: r["value"] for r in scan.as_of(df, history, "seq", "value", along=history).collect()} == latest
    assert scan.running_total(df.limit(0), "seq", "step", "total").count() == 0
    assert scan.running_total(df.limit(1), "seq", "step", "total").count() == 1
    assert scan.as_of(df, history.limit(0), "seq", "value").where("value is null").count() == 500


def test_client_view(spark):
    updates = spark.createDataFrame(
        [(1, "desks", "10", "ann"), (2, "desks", "9", "bo"), (3, "desks", "10", None), (4, "desks", "2", ""), (5, "desks", "1", "me")],
        "seq bigint, type string, id string, reserved_by string",
    )
    shown = spots.slot_status(spots.client_state(updates), "me").orderBy("position")
    assert [(r["id"], r["status"], r["shown"]) for r in shown.collect()] == [
        ("1", "mine", "You"),
        ("2", "free", "Available"),
        ("9", "taken", "bo"),
        ("10", "free", "Available"),
    ]


def test_stored_employee_without_shifts_gets_them_from_a_single_one(spark):
    people = spark.createDataFrame(
        [("a", 0, "A", "day", None, "", 3, None, None), ("b", 1, "B", "day", ["night"], "", None, None, None), ("c", 2, "C", None, [], "", 1, None, None)],
        "id string, ordinal long, name string, shift string, shifts array<string>, department string, target_days long, remote boolean, has_car boolean",
    )
    log = spark.createDataFrame(
        [(10, "a", "evening"), (11, "a", "night"), (12, "b", "evening"), (13, "gone", "day")], "seq long, id string, shift string"
    ).selectExpr(
        "seq", "id", "'update' as op", "cast(null as string) name", "cast(null as string) department", "cast(null as string) shifts",
        "shift", "cast(null as string) target_days", "cast(null as boolean) remote", "cast(null as boolean) has_car",
    )
    from slotledger.operators.employees import current_employees

    found = {r["id"]: (r["shift"], r["shifts"], r["target_days"], r["name"]) for r in current_employees(log, people=people).collect()}
    assert found == {
        "a": ("night", ["evening"], 3, "A"),
        "b": ("evening", ["night"], None, "B"),
        "c": (None, None, 1, "C"),
    }
