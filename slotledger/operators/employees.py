"""The employee log: adds, sparse updates and deletes, folded into the current table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.functions.text import or_default, shift_list, strip, to_int
from slotledger.operators.settings import target_as_of
from slotledger.schemas import DEFAULT_TARGET_DAYS, EMPLOYEE_NOT_FOUND, SHIFTS
from slotledger.session import written

# Fixed value: the name of an employee added without one.
NEW_EMPLOYEE = "New Employee"

BAD_TARGET = "Bad target days"
# The operation of a request that was to add names and had none that could be used.
ADD_NONE = "add_none"


def requested_names(requests: DataFrame, *kept: str) -> DataFrame:
    """The employees asked for: a row per usable name of a list, else one for the single name.

    Names in a list are stripped and blank ones dropped; a blank single name becomes the default. An empty list
    counts as none. Columns named in ``kept`` are passed on.
    """
    listed = F.coalesce(F.size("names"), F.lit(0)) > 0
    cleaned = F.filter(F.transform("names", strip), lambda name: name != "")
    single = or_default(strip(or_default(F.col("name"), NEW_EMPLOYEE)), NEW_EMPLOYEE)
    names = F.when(listed, cleaned).otherwise(F.array(single))
    return requests.select("seq", *kept, F.posexplode(names).alias("position", "name"))


def lifespans(log: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """When each employee was added and first deleted after that, by ``seq``: one row per id.

    ``people`` are stored employees, there since their ordinal.

    An add whose target cannot be read fails as a whole. Ids are given out by the add and never used again.
    """
    failed = F.col("target_days").isNotNull() & to_int(F.col("target_days")).isNull()
    adds = log.where((F.col("op") == "add") & ~failed).groupBy("id").agg(F.min("seq").alias("added"))
    if people is not None:
        adds = adds.unionByName(people.select("id", F.col("ordinal").cast("bigint").alias("added")))
    deletes = log.where(F.col("op") == "delete").select("id", "seq")
    adds = written(adds, "added")
    later = deletes.join(adds, "id").where(F.col("seq") > F.col("added"))
    return adds.join(later.groupBy("id").agg(F.min("seq").alias("ended")), "id", "left")


def judge(log: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """The log with ``added``, ``ended`` and ``error``: NULL for commands that were carried out.

    The lifespans are written first, so that adaptive execution can split an id with very many commands.
    """
    seq, added, ended = F.col("seq"), F.col("added"), F.col("ended")
    alive = (seq > added) & (ended.isNull() | (seq <= ended))
    carried_out = F.when(F.col("op") == "add", seq == added).when(F.col("op") == ADD_NONE, True).otherwise(alive)
    reason = F.when(F.col("op") == "add", BAD_TARGET).otherwise(EMPLOYEE_NOT_FOUND)
    return log.join(written(lifespans(log, people), "lifespans"), "id", "left").withColumn(
        "error", F.when(~F.coalesce(carried_out, F.lit(False)), reason)
    )


def employee_rejects(log: DataFrame) -> DataFrame:
    """Commands that were refused, and why."""
    return judge(log).where(F.col("error").isNotNull()).select("seq", "id", "op", "error")


def employee_changes(log: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """The change events of the employee log: one per request that was carried out. ``people`` were stored before the log.

    ``ref`` has the ids it dealt with, several of an add with several names, none of one without a usable name.
    """
    done = judge(log, people=people).where(F.col("error").isNull())
    is_add = F.col("op").isin("add", ADD_NONE)
    ids = F.coalesce(F.array_join(F.sort_array(F.collect_list("id")), ","), F.lit(""))
    adds = done.where(is_add).groupBy("seq").agg(ids.alias("id"), F.lit("add").alias("op"))
    return adds.unionByName(done.where(~is_add).select("seq", "id", "op")).select(
        F.lit("employees").alias("log"),
        "seq",
        F.lit("employees").alias("action"),
        F.col("id").alias("ref"),
        F.col("op").alias("detail"),
    )


def current_employees(
    log: DataFrame,
    settings_log: DataFrame | None = None,
    people: DataFrame | None = None,
    target_before: int = DEFAULT_TARGET_DAYS,
) -> DataFrame:
    """The employees left at the end of the log, with the last value sent of every field.

    One aggregate per id with a ``max_by`` per field does the folding; its partial step runs before the shuffle.
    A field that was not sent, or was sent with an unusable value, is NULL by then and does not count; a name or department that
    the log says was sent (``name_sent``, ``department_sent``) counts as NULL too. An add without
    a target takes the one configured at that time, which needs the settings log.

    ``target_before`` is the target configured before the settings log. ``people`` are stored employees that the log goes on
    from; their ordinals are below the log's numbers. One stored without
    a list of shifts gets it from the first single shift sent.
    """
    done = judge(log, people).where(F.col("error").isNull())
    alive = done.where(F.col("ended").isNull() & (F.col("op") != ADD_NONE))
    is_add = F.col("op") == "add"
    lone_shift = F.when(F.col("shifts").isNull() & F.col("shift").isin(*SHIFTS), F.col("shift"))
    # Only an update leaves the shifts alone when it does not send any; an add falls back to its single shift.
    first_shifts = F.when(is_add & F.col("shifts").isNull(), shift_list(F.coalesce("shift", F.lit("day"))))
    shifts = F.coalesce(F.when(F.col("shifts").isNotNull(), shift_list(F.col("shifts"))), first_shifts)
    sent = alive.select(
        "id",
        "seq",
        "added",
        F.when(is_add, or_default(strip(or_default(F.col("name"), NEW_EMPLOYEE)), NEW_EMPLOYEE))
        .otherwise(F.col("name"))
        .alias("name"),
        F.when(is_add, F.coalesce("department", F.lit(""))).otherwise(F.col("department")).alias("department"),
        shifts.alias("shifts"),
        F.coalesce(shifts[0], lone_shift).alias("shift"),
        to_int(F.col("target_days")).alias("target_days"),
        "remote",
        "has_car",
        *((_was_sent(log, name) | is_add).alias(f"{name}_sent") for name in NULLABLE),
        lone_shift.alias("lone_shift"),
        F.lit(False).alias("stored"),
    )
    if people is not None:
        deleted = done.where(F.col("op") == "delete").select("id").distinct()
        sent = sent.unionByName(_as_sent(people.join(deleted, "id", "left_anti")))
    folded = sent.groupBy("id").agg(
        F.min("added").alias("seq"),
        *(_last_sent(name) for name in ("name", "department", "shift", "shifts", "target_days", "remote", "has_car")),
        F.min_by("lone_shift", F.when(F.col("lone_shift").isNotNull(), F.col("seq"))).alias("lone_shift"),
        F.bool_or("stored").alias("stored"),
    )
    target = F.lit(DEFAULT_TARGET_DAYS).cast("bigint")
    if settings_log is not None:
        folded = target_as_of(folded, settings_log, log.where(is_add), target_before)
        target = F.col("default_target")
    return folded.select(
        "id",
        F.col("seq").alias("ordinal"),
        "name",
        "shift",
        F.coalesce("shifts", F.when(F.col("lone_shift").isNotNull(), F.array("lone_shift"))).alias("shifts"),
        "department",
        F.coalesce("target_days", F.when(~F.col("stored"), target)).alias("target_days"),
        "remote",
        "has_car",
    )


def _as_sent(people: DataFrame) -> DataFrame:
    """Stored employees as the first thing sent of each."""
    known = F.lit(True)
    return people.select(
        "id",
        F.col("ordinal").cast("bigint").alias("seq"),
        F.col("ordinal").cast("bigint").alias("added"),
        "name",
        "department",
        F.when(F.size("shifts") > 0, F.col("shifts")).alias("shifts"),
        "shift",
        F.col("target_days").cast("bigint").alias("target_days"),
        "remote",
        "has_car",
        *(known.alias(f"{name}_sent") for name in NULLABLE),
        F.lit(None).cast("string").alias("lone_shift"),
        known.alias("stored"),
    )


# Fields whose NULL can be a value.
NULLABLE = ("name", "department")


def _was_sent(log: DataFrame, name: str) -> Column:
    return F.col(f"{name}_sent") if f"{name}_sent" in log.columns else F.col(name).isNotNull()


def _last_sent(name: str) -> Column:
    sent = F.col(f"{name}_sent") if name in NULLABLE else F.col(name).isNotNull()
    return F.max_by(name, F.when(sent, F.col("seq"))).alias(name)
