"""Checks made on a command before it may touch any state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.schemas import ADMIN_REQUIRED, INVALID_REQUEST, KINDS, NO_USER, SHIFTS


def _absent(name: str) -> Column:
    column = F.col(name)
    return column.isNull() | (column.cast("string") == "")


def command_error() -> Column:
    """What is wrong with a book / unbook command, NULL if nothing. Empty text counts as missing.

    Capacity, the weekday of the shift and the user's existence are deliberately not checked.
    """
    malformed = (
        _absent("date")
        | ~F.coalesce(F.col("shift").isin(*SHIFTS), F.lit(False))
        | ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
        | _absent("slot")
    )
    nobody = (F.col("op") == "book") & _absent("user_id")
    return F.when(malformed, INVALID_REQUEST).when(nobody, NO_USER)


def validate_commands(commands: DataFrame) -> DataFrame:
    """Add the error column."""
    return commands.withColumn("error", command_error())


def valid_commands(commands: DataFrame) -> DataFrame:
    """The commands that reach the booking rules."""
    return commands.where(command_error().isNull())


# Operations only an administrator may call. Unbooking is open to all; there the flag lifts the
# owner check instead.
ADMIN_EMPLOYEE_OPS = ("add", "delete")
ADMIN_FEEDBACK_OPS = ("list", "read", "delete")


def authority_error(admin_ops: tuple[str, ...]) -> Column:
    """The refusal of a command whose caller lacks the authority for it, else NULL."""
    allowed = F.coalesce(F.col("is_admin"), F.lit(False))
    return F.when(F.col("op").isin(*admin_ops) & ~allowed, ADMIN_REQUIRED)
