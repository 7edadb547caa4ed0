import datetime as dt
import json

import pytest

from conftest import rows
from slotledger.operators.employees import current_employees, employee_rejects
from slotledger.operators.feedback import current_feedback
from slotledger.operators.replay import replay
from slotledger.operators.settings import effective_lists, effective_settings
from slotledger.operators.validation import valid_commands, validate_commands
from slotledger.plans import catalog
from slotledger.plans import fixtures as X
from slotledger.plans.changefeed import change_feed
from slotledger.sinks.state import read_day_documents, write_day_documents, write_days, write_tables
from slotledger.sources import requests as R
from slotledger.sources import snapshot as S

D = dt.date


def log_file(tmp_path, requests):
    path = tmp_path / "requests.json"
    lines = []
    for seq, (op, body, *admin) in enumerate(requests, 1):
        text = body if isinstance(body, str) else json.dumps(body)
        lines.append(json.dumps({"seq": seq, "ts": "2026-01-05T08:00:00.9Z", "op": op, "is_admin": bool(admin), "body": text}))
    path.write_text("\n".join(lines))
    return str(path)


def test_booking_bodies(spark, tmp_path):
    good = {"date": "2026-01-05", "shift": "day", "kind": "desks", "slot": 3, "userId": "a"}
    bodies = [
        good,
        {**good, "slot": None, "userId": "b"},
        {k: v for k, v in good.items() if k != "slot"},
        {**good, "slot": ""},
        {**good, "date": ""},
        {**good, "shift": "noon"},
        {**good, "kind": "bike"},
        {**good, "userId": ""},
        {**good, "userId": 0},
        {**good, "date": "someday", "shift": "weekend"},
        "not json {",
        "",
        "[1]",
        {**good, "slot": True, "userId": 7},
        {**good, "shift": ["day"]},
    ]
    path = log_file(tmp_path, [("book", b) for b in bodies])
    commands = R.booking_commands(R.read_requests(spark, path))
    checked = validate_commands(commands).orderBy("seq").collect()
    bad, nobody = "Invalid request", "No user selected"
    assert [r["error"] for r in checked] == [None, None, bad, bad, bad, bad, bad, nobody, nobody, None, bad, bad, None, bad]  # the list fails
    assert [r["slot"] for r in checked][:4] == ["3", "None", "", ""]
    assert (checked[12]["slot"], checked[12]["user_id"]) == ("True", "7")
    assert rows(replay(valid_commands(commands)), "seq", "outcome") == [(1, "booked"), (10, "booked"), (14, "booked"), (2, "booked")]


def test_bodies_and_kinds_that_fail(spark, tmp_path):
    """Each request must leave no command, however it came to be: a wrong body, or a text that is none."""
    slot = {"date": "2026-01-05", "shift": "day", "kind": "desks", "slot": 1, "userId": "a"}
    refused = [
        *((op, body, 1) for op in ("book", "unbook", "employees/add", "employees/update", "employees/delete") for body in ("[1]", "5", '"x"', "true")),
        *((f"feedback/{op}", body, 1) for op in ("submit", "delete", "read") for body in ("[1]", '"x"')),
        ("book", {**slot, "date": ["2026-01-05"]}),
        *(("config", body) for body in ("5", "true", '["unavailableDesks"]', '"no unavailableParking"')),
        *(("employees/add", body, 1) for body in ({"name": 12}, {"name": ["A"]}, {"names": [5, "a"]}, {"names": ["a", {"b": 1}]}, {"names": ["a", True]})),
        *(("feedback/submit", body) for body in ({"message": 5}, {"message": "m", "name": 7}, {"message": {"a": 1}})),
    ]
    path = log_file(tmp_path, refused)
    requests = R.read_requests(spark, path)
    for commands in (R.booking_commands, R.settings_commands, R.employee_commands, R.feedback_commands):
        assert commands(requests).collect() == [], commands


def test_odd_bodies_that_do_not_fail(spark, tmp_path):
    slot = {"date": "2026-01-05", "shift": "day", "kind": "desks", "userId": "a"}
    texts = {"1.0": 1.0, "1.5": 1.5, "1": 1, "{}": {}, "True": True, "100.0": 100.0, "-3": -3, "0.25": 0.25}
    path = log_file(
        tmp_path,
        [
            *(("book", {**slot, "slot": value}) for value in texts.values()),
            *(("config", body) for body in ("[]", "[1]", '"x"', "0", "null", '["desks"]')),
            *(("employees/add", body, 1) for body in ("[]", "0", {"name": 0}, {"names": [], "name": False}, {"names": [0, "", None, False, [], "Al"]})),
            ("feedback/submit", {"message": "m", "name": 0}),
        ],
    )
    requests = R.read_requests(spark, path)
    assert [r["slot"] for r in R.booking_commands(requests).orderBy("seq").collect()] == list(texts)
    assert [r["key"] for r in R.settings_commands(requests).collect()] == [None] * 6
    assert sorted(r["name"] for r in R.employee_commands(requests).collect()) == ["Al"] + ["New Employee"] * 4
    assert [r["name"] for r in current_feedback(R.feedback_commands(requests)).collect()] == ["Anonymous"]


def test_settings_bodies(spark, tmp_path):
    path = log_file(
        tmp_path,
        [
            ("config", {"desks": 12.7, "parking": "7", "year": True, "unavailableDesks": "3, x,5,3"}),
            ("config", {"desks": "12.7", "parking": None, "unavailableParking": [4, "5", "y", None, 6.9]}),
            ("config", {"desks": 99, "unavailableDesks": 7}),
            ("config", {"targetDays": [1]}),
            ("config", "oops"),
        ],
    )
    log = R.settings_commands(R.read_requests(spark, path))
    assert dict(effective_settings(log).collect()) == {"desks": 12, "parking": 7, "targetDays": 2, "year": 1}
    lists = {r["key"]: r["numbers"] for r in effective_lists(log).collect()}
    assert lists == {"unavailableDesks": [3, 5, 3], "unavailableParking": [4, 5, 6]}


def test_employee_and_feedback_bodies(spark, tmp_path):
    path = log_file(
        tmp_path,
        [
            ("employees/add", {"names": [" Ann ", "", None, "Bo"], "shifts": ["night", "bogus", "night"], "targetDays": "3"}, 1),
            ("employees/add", {"name": "  ", "shift": "evening"}, 1),
            ("employees/add", {"name": "Eve"}),
            ("employees/add", {"name": "Max", "targetDays": None}, 1),
            ("employees/update", {"id": "e_00000001", "shifts": 7, "remote": "yes", "hasCar": 0, "targetDays": 4.9}),
            ("employees/update", {"id": "e_00000002", "shift": "noon", "department": "ops", "targetDays": "x"}),
            ("employees/delete", {"id": "e_00000001_1"}),
            ("employees/delete", {"id": "nobody"}, 1),
            ("feedback/submit", {"name": "", "message": " hello "}),
            ("feedback/submit", {"message": "  "}),
            ("feedback/read", {"id": "fb_00000009"}, 1),
            ("feedback/delete", {"id": "fb_00000009"}),
        ],
    )
    requests = R.read_requests(spark, path)
    log = R.employee_commands(requests)
    got = rows(current_employees(log), "id", "name", "shift", "shifts", "department", "target_days", "remote", "has_car")
    assert got == [
        ("e_00000001", "Ann", "day", ["day"], "", 4, True, False),
        ("e_00000001_1", "Bo", "night", ["night", "night"], "", 3, None, None),
        ("e_00000002", "New Employee", "evening", ["evening"], "ops", 2, None, None),
    ]
    assert rows(employee_rejects(log), "seq", "error") == [(4, "Bad target days"), (8, "Employee not found")]
    stored = current_feedback(R.feedback_commands(requests)).collect()
    assert [(r["fb_id"], r["name"], r["message"], r["category"], r["read"]) for r in stored] == [
        ("fb_00000009", "Anonymous", "hello", "general", True)
    ]
    assert stored[0]["ts"].isoformat() == "2026-01-05T08:00:00"


def test_feed_from_requests(spark, tmp_path):
    slot = {"date": "2026-01-05", "shift": "day", "kind": "desks", "slot": "1"}
    path = log_file(
        tmp_path,
        [
            ("book", {**slot, "userId": "a"}),
            ("book", {**slot, "userId": "b"}),
            ("config", {"desks": "x"}),
            ("unbook", slot),
            ("unbook", slot),
            ("employees/add", {"name": "A"}, 1),
            ("feedback/submit", {"message": "m"}),
        ],
    )
    requests = R.read_requests(spark, path)
    feed = change_feed(
        replay(valid_commands(R.booking_commands(requests))),
        R.settings_commands(requests),
        R.employee_commands(requests),
        R.feedback_commands(requests),
    )
    assert [tuple(r) for r in feed.orderBy("seq").collect()] == [
        ("bookings", 1, "booking", "2026-01-05|day|desks|1", "a"),
        ("settings", 3, "config", None, DEFAULTS),
        ("bookings", 4, "booking", "2026-01-05|day|desks|1", None),
        ("employees", 6, "employees", "e_00000006", "add"),
        ("feedback", 7, "feedback_count", "fb_00000007", "1"),
    ]


DEFAULTS = '{"desks":28,"parking":10,"targetDays":2,"year":2026,"unavailableDesks":[],"unavailableParking":[]}'


def test_requests_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log_file(tmp_path / "in", [("book", {"date": "2026-01-05", "shift": "day", "kind": "desks", "slot": 1, "userId": "a"})] * 3)
    from slotledger.streaming import live

    stream = live.replay_stream(valid_commands(R.booking_commands(R.stream_requests(spark, str(tmp_path / "in")))))
    live.write_changes(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert rows(live.read_changes(spark, str(tmp_path / "out"), stream.schema), "seq", "outcome") == [(1, "booked"), (2, "rebook"), (3, "rebook")]


DOCUMENT = {
    "config": {"desks": 4, "color": "blue", "unavailableDesks": [1, 2]},
    "employees": [
        {"id": "e2", "name": "Zed", "shift": "day", "shifts": ["day"], "department": "x", "targetDays": 3, "hasCar": True},
        {"id": "e1", "name": "Ann", "shifts": ["night"], "department": ""},
    ],
    "bookings": {
        "2026-01-05": {"day": {"desks": {"1": "e1", "99": "e9"}, "parking": {}}},
        "2026-01-06": {},
        "2026-1-7": {"night": {"parking": {"2": 12}}},
    },
}


def test_snapshot_document(spark, tmp_path):
    path = tmp_path / "state.json"
    path.write_text(json.dumps(DOCUMENT, indent=2))
    tables = S.read_document(spark, str(path))
    settings = tables["settings"].first()
    assert (settings["desks"], settings["parking"], settings["targetDays"], settings["year"]) == (4, 10, 2, 2026)
    assert settings["unavailableDesks"] == [1, 2] and settings["unavailableParking"] == []
    assert json.loads(settings["stored"])["color"] == "blue"
    assert S.report_settings(tables["settings"]).desks == 4
    assert [r["id"] for r in tables["employees"].orderBy("ordinal").collect()] == ["e2", "e1"]
    held = [
        (D(2026, 1, 5), "day", "desks", "1", "e1", "2026-01-05"),
        (D(2026, 1, 5), "day", "desks", "99", "e9", "2026-01-05"),
        (None, "night", "parking", "2", "12", "2026-1-7"),
    ]
    columns = ("date", "shift", "kind", "slot", "user_id", "date_raw")
    assert rows(tables["bookings"], *columns) == held
    assert tables["feedback"].count() == 0

    write_tables(tables, str(tmp_path / "store"))
    stored = S.read_tables(spark, str(tmp_path / "store"))
    assert rows(stored["bookings"], *columns) == held
    assert rows(stored["employees"]) == rows(tables["employees"])
    S.register_views(stored)
    assert spark.sql("select count(*) from bookings join employees on user_id = id").first()[0] == 1

    one_day = tables["bookings"].where("slot = '99'")
    write_days(one_day, str(tmp_path / "store"))
    again = S.read_tables(spark, str(tmp_path / "store"))["bookings"]
    assert rows(again, "slot") == [("2",), ("99",)]


def test_missing_snapshot_is_an_empty_office(spark, tmp_path):
    tables = S.read_document(spark, str(tmp_path / "nothing.json"))
    assert tables["settings"].first()["desks"] == 28
    assert [tables[n].count() for n in ("employees", "bookings", "feedback")] == [0, 0, 0]


def test_day_documents(spark, tmp_path):
    held = spark.createDataFrame(
        [(D(2026, 1, 5), "day", "desks", "1", "a"), (D(2026, 1, 5), "day", "parking", "1", "b")],
        "date date, shift string, kind string, slot string, user_id string",
    )
    write_day_documents(held, str(tmp_path / "days"))
    (line,) = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "days")).collect()]
    assert line == {"date": "2026-01-05", "day": {"day": {"desks": {"1": "a"}, "parking": {"1": "b"}}}}


def test_day_documents_without_a_date(spark, tmp_path):
    held = spark.createDataFrame(
        [(D(2026, 1, 5), "2026-01-05", "day", "desks", "1", "a"), (None, "2026-1-7", "day", "desks", "1", "b")],
        "date date, date_raw string, shift string, kind string, slot string, user_id string",
    )
    for parts in (1, 2):
        write_day_documents(held, str(tmp_path / f"days{parts}"), parts)
        assert rows(read_day_documents(spark, str(tmp_path / f"days{parts}")), *held.columns) == rows(held)


def test_empty_and_dateless_stores_come_back(spark, tmp_path):
    empty = S.read_document(spark, str(tmp_path / "nothing.json"))
    write_tables(empty, str(tmp_path / "empty"))
    back = S.read_tables(spark, str(tmp_path / "empty"))
    assert [back[n].count() for n in ("settings", "employees", "bookings", "feedback")] == [1, 0, 0, 0]
    dateless = spark.createDataFrame(
        [(None, "2026-1-7", "day", "desks", "1", "b")], "date date, date_raw string, shift string, kind string, slot string, user_id string"
    )
    write_tables(empty | {"bookings": dateless}, str(tmp_path / "dateless"))
    found = S.read_tables(spark, str(tmp_path / "dateless"))["bookings"]
    assert dict(found.dtypes)["date"] == "date" and rows(found, *dateless.columns) == rows(dateless)


@pytest.mark.parametrize("text", ['{"bookings": {"2026-01-05": ', "[1, 2", "not json"])
def test_damaged_snapshot_is_an_error(spark, tmp_path, text):
    (tmp_path / "state.json").write_text(text)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        S.read_document(spark, str(tmp_path / "state.json"))


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from slotledger.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session)


@pytest.mark.parametrize("commands", [R.booking_commands, R.settings_commands, R.employee_commands, R.feedback_commands])
def test_bodies_are_parsed_once_a_row(spark, small, commands):
    plan = commands(X.requests(spark, small))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == plan.count("Relation")


def test_requests_of_a_small_file_are_many_tasks(spark, small):
    assert X.requests(spark, small).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_halves_of_a_log_are_read_and_not_made_again(spark, small):
    first, second, _ = catalog._cut(X.commands(spark, small))
    plans = [half._jdf.queryExecution().optimizedPlan().toString() for half in (first, second)]
    assert not any("get_json_object" in plan for plan in plans)
