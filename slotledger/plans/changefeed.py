"""The outbound feed: one event per edit that was carried out, over all four logs, and the office that the logs leave."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.operators.changes import booking_changes, settled_bookings
from slotledger.operators.employees import current_employees, employee_changes
from slotledger.operators.feedback import current_feedback, feedback_changes
from slotledger.operators.replay import replay
from slotledger.operators.settings import effective_lists, effective_settings, settings_changes, settings_of
from slotledger.schemas import DEFAULT_TARGET_DAYS


@dataclass
class Logs:
    """The four logs of one stretch of arrival numbers: valid bookings, settings, employees and feedback."""

    bookings: DataFrame
    settings: DataFrame
    employees: DataFrame
    feedback: DataFrame


@dataclass
class Office:
    """What logs leave, and what further logs go on from. All numbers in it are below those logs'."""

    bookings: DataFrame
    settings: DataFrame
    lists: DataFrame
    employees: DataFrame
    feedback: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def change_feed(
    outcomes: DataFrame,
    settings_log: DataFrame,
    employee_log: DataFrame,
    feedback_log: DataFrame,
    before: Office | None = None,
) -> DataFrame:
    """Events ``(log, seq, action, ref, detail)``. Each log is ordered by ``seq``; across logs no order is promised.

    ``before`` is the office that the logs go on from.
    """
    known = before.tables() if before else {}
    return (
        booking_changes(outcomes)
        .unionByName(settings_changes(settings_log, known.get("settings"), known.get("lists")))
        .unionByName(employee_changes(employee_log, known.get("employees")))
        .unionByName(feedback_changes(feedback_log, known.get("feedback")))
    )


def outcomes_of(logs: Logs, before: Office | None = None) -> DataFrame:
    """The outcomes of the booking log."""
    return replay(logs.bookings, held=before.bookings if before else None)


def office_after(logs: Logs, outcomes: DataFrame, before: Office | None = None) -> Office:
    """The office that the logs leave; ``outcomes`` are those of their bookings."""
    known = before.tables() if before else {}
    target = settings_of(before.settings).target_days if before else DEFAULT_TARGET_DAYS
    return Office(
        bookings=settled_bookings(outcomes, held=known.get("bookings")),
        settings=effective_settings(logs.settings, known.get("settings")),
        lists=effective_lists(logs.settings, known.get("lists")),
        employees=current_employees(logs.employees, logs.settings, people=known.get("employees"), target_before=target),
        feedback=current_feedback(logs.feedback, known.get("feedback")),
    )


def messages(feed: DataFrame) -> DataFrame:
    """The events as JSON texts, ``seq`` alongside."""
    return feed.select("seq", F.to_json(F.struct("action", "log", "seq", "ref", "detail")).alias("message"))
