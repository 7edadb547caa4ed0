"""Fixed vocabulary and explicit schemas of the booking data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The vocabulary of a booking, in display order.
SHIFTS = ("day", "evening", "night", "weekend")
WEEKDAY_SHIFTS = ("day", "evening", "night")
WEEKEND_SHIFTS = ("weekend",)
KINDS = ("desks", "parking")
SHIFT_HOURS = {
    "day": "09:00-18:00",
    "evening": "16:00-24:00",
    "night": "23:00-07:00",
    "weekend": "19:00-03:00",
}

# Settings used when none are stored.
DEFAULT_DESKS = 28
DEFAULT_PARKING = 10
DEFAULT_TARGET_DAYS = 2
DEFAULT_YEAR = 2026
DEFAULT_SETTINGS = {
    "desks": DEFAULT_DESKS,
    "parking": DEFAULT_PARKING,
    "targetDays": DEFAULT_TARGET_DAYS,
    "year": DEFAULT_YEAR,
}
LIST_SETTINGS = ("unavailableDesks", "unavailableParking")

# Answers given to a command that is not carried out.
INVALID_REQUEST = "Invalid request"
NO_USER = "No user selected"
ADMIN_REQUIRED = "Admin access required"
EMPLOYEE_NOT_FOUND = "Employee not found"
FEEDBACK_NOT_FOUND = "Not found"
MESSAGE_REQUIRED = "Message required"

# What tells one independent piece of booking state from another.
GROUP_KEYS = ("date", "shift", "kind")
SLOT_KEYS = (*GROUP_KEYS, "slot")


@dataclass(frozen=True)
class Settings:
    """The report settings. One small record, so it travels as literals rather than as a joined table."""

    desks: int = DEFAULT_DESKS
    parking: int = DEFAULT_PARKING
    target_days: int = DEFAULT_TARGET_DAYS


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_text, _long, _flag = T.StringType(), T.LongType(), T.BooleanType()

BOOKING = _struct(date=T.DateType(), shift=_text, kind=_text, slot=_text, user_id=_text)

EMPLOYEE_DOCUMENT = _struct(
    id=_text, name=_text, shift=_text, shifts=T.ArrayType(_text), department=_text,
    targetDays=_long, remote=_flag, hasCar=_flag,
)
FEEDBACK_DOCUMENT = _struct(id=_text, name=_text, message=_text, category=_text, ts=_text, read=_flag)

_slots = T.MapType(_text, _text)
DAY_DOCUMENT = T.MapType(_text, T.MapType(_text, _slots))
SNAPSHOT_DOCUMENT = _struct(
    config=T.VariantType(),
    employees=T.ArrayType(EMPLOYEE_DOCUMENT),
    bookings=T.MapType(_text, DAY_DOCUMENT),
    feedback=T.ArrayType(FEEDBACK_DOCUMENT),
)

# The stored tables, partition columns included, so that reading never has to infer a type.
STORED_TABLES = {
    "settings": _struct(
        **dict.fromkeys(DEFAULT_SETTINGS, _long), **dict.fromkeys(LIST_SETTINGS, T.ArrayType(_long)), stored=_text
    ),
    "employees": _struct(
        id=_text, ordinal=_long, name=_text, shift=_text, shifts=T.ArrayType(_text), department=_text,
        target_days=_long, remote=_flag, has_car=_flag,
    ),
    "bookings": _struct(shift=_text, kind=_text, slot=_text, user_id=_text, date_raw=_text, date=T.DateType()),
    "feedback": _struct(
        id=_text, ordinal=_long, name=_text, message=_text, category=_text, ts=T.TimestampType(), read=_flag
    ),
}

# One request as logged: its arrival number and time, the operation, the caller's authority, and the body as received.
REQUEST = _struct(seq=_long, ts=T.TimestampType(), op=_text, is_admin=_flag, body=_text)
