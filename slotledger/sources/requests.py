"""The request log: one JSON line per request, split into the logs of bookings, settings, employees and feedback.

Bodies are taken as received. One that is not JSON counts as empty, and a field is judged by the kind it was sent with. Requests whose body
or fields are of a kind that the operation cannot work with fail as a whole, and leave no command. All of it is per row, so a log file and a stream of log files are read by the same code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.functions.json import Field, object_or_falsy, read_bodies, texts_or_falsy
from slotledger.functions.text import comma_items, int_items, shift_items, strip
from slotledger.operators.employees import ADD_NONE, requested_names
from slotledger.operators.validation import ADMIN_EMPLOYEE_OPS, ADMIN_FEEDBACK_OPS, authority_error
from slotledger.schemas import DEFAULT_SETTINGS, LIST_SETTINGS, REQUEST


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """The request log as a batch."""
    return spark.read.schema(REQUEST).option("mode", "PERMISSIVE").json(path)


def stream_requests(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The request log as a stream of files, taken in the order in which they were written."""
    reader = spark.readStream.schema(REQUEST).option("mode", "PERMISSIVE")
    return reader.option("maxFilesPerTrigger", files_per_trigger).json(path)


def booking_commands(requests: DataFrame) -> DataFrame:
    """``book`` and ``unbook`` requests as commands; see ``validation`` for which of them are valid.

    The slot becomes text before it is checked: a missing one is empty, a null one reads None. A date that is a list or an object
    cannot be stored under, if the rest is valid.
    """
    log, whole, fields = read_bodies(requests.where(F.col("op").isin("book", "unbook")), "date", "shift", "kind", "slot", "userId")
    date, shift, kind, slot, user = fields.values()
    stored = ~F.coalesce((date.is_list | date.is_object) & date.truthy(), F.lit(False))
    return log.where(object_or_falsy(whole) & stored).select(
        "seq",
        F.when(date.truthy(), date.text()).alias("date"),
        shift.text().alias("shift"),
        kind.text().alias("kind"),
        F.coalesce(slot.text_or_none(), F.lit("")).alias("slot"),
        "op",
        F.when(user.truthy(), user.text()).alias("user_id"),
        F.coalesce("is_admin", F.lit(False)).alias("is_admin"),
    )


def settings_commands(requests: DataFrame) -> DataFrame:
    """``config`` requests as ``(seq, key, raw_value)``, a row per setting sent, or one with a NULL key where none is.

    A list setting sent as anything that cannot be gone through fails the whole request. So does a body in which nothing can be
    looked up (a number, or true); a list or a text does no harm unless it names a list setting.
    """
    log, whole, fields = read_bodies(requests.where(F.col("op") == "config"), *DEFAULT_SETTINGS, *LIST_SETTINGS)
    numbers = {key: fields[key] for key in DEFAULT_SETTINGS}
    lists = {key: fields[key] for key in LIST_SETTINGS}

    def entry(key: str, sent: Column, value: Column) -> Column:
        return F.when(sent, F.struct(F.lit(key).alias("key"), value.alias("raw_value")))

    entries = [entry(key, field.sent, field.int_text()) for key, field in numbers.items()]
    entries += [entry(key, field.sent, _list_text(field)) for key, field in lists.items()]
    failed = (whole.is_number | whole.is_flag) & whole.truthy()
    for key in LIST_SETTINGS:
        named = F.when(whole.is_list, F.array_contains(whole.items(), key)).when(whole.is_text, F.contains(whole.text(), F.lit(key)))
        failed = failed | F.coalesce(named, F.lit(False))
    failed = F.coalesce(failed, F.lit(False))
    for field in lists.values():
        failed = failed | F.coalesce(field.sent & ~(field.is_text | field.is_list | field.is_object), F.lit(False))
    return (
        log.where(~failed)
        .select("seq", F.inline_outer(F.filter(F.array(*entries), lambda e: e.isNotNull())))
        .select("seq", "key", "raw_value")
    )


def _list_text(field: Field) -> Column:
    items = F.when(field.is_text, comma_items(field.text())).otherwise(field.int_items())
    numbers = F.transform(int_items(items), lambda n: n.cast("string"))
    return F.coalesce(F.array_join(numbers, ","), F.lit(""))


def _shift_text(field: Field) -> Column:
    items = F.when(field.is_text, comma_items(field.text())).otherwise(field.items())
    return F.array_join(F.when(items.isNull(), F.array(F.lit("day"))).otherwise(shift_items(items)), ",")


def _allowed(requests: DataFrame, ops: tuple[str, ...]) -> DataFrame:
    return requests.where(authority_error(ops).isNull())


def employee_commands(requests: DataFrame) -> DataFrame:
    """``employees/add``, ``/update`` and ``/delete`` requests as the employee log, refused ones left out.

    Added employees get ids made from the arrival number, which makes them unique and repeatable. A list without a usable name
    adds nobody but is a request all the same: its row has the operation ``ADD_NONE`` and no id. A name or department
    sent as null is a value (``name_sent``, ``department_sent``).
    """
    log = requests.withColumn("op", F.regexp_extract("op", r"\Aemployees/(add|update|delete)\z", 1)).where("op <> ''")
    sent = ("id", "name", "department", "shifts", "shift", "remote", "hasCar", "targetDays", "names")
    log, whole, fields = read_bodies(_allowed(log, ADMIN_EMPLOYEE_OPS), *sent)
    log = log.where(object_or_falsy(whole))
    target = fields["targetDays"].int_text().alias("target_days")
    listed = fields["names"]
    names = listed.text_items()
    several = F.coalesce(listed.is_list & listed.truthy(), F.lit(False))
    fit = F.when(several, texts_or_falsy(listed)).otherwise(fields["name"].text_or_falsy())
    log = log.where((F.col("op") != "add") | fit)
    none = F.lit(None)

    single = F.when(fields["shift"].sent, shift_items(F.array(F.coalesce(fields["shift"].text(), F.lit("")))))
    add_shifts = F.when(fields["shifts"].truthy(), _shift_text(fields["shifts"])).otherwise(
        F.coalesce(F.array_join(single, ","), F.lit("day"))
    )
    requested = log.where(F.col("op") == "add").select(
        "seq",
        names.alias("names"),
        F.when(fields["name"].truthy(), fields["name"].text()).alias("name"),
        F.coalesce(fields["department"].text(), F.lit("")).alias("department"),
        add_shifts.alias("shifts"),
        target,
    )
    number = F.lower(F.lpad(F.hex("seq"), 8, "0"))
    adds = requested_names(requested, "department", "shifts", "target_days").select(
        "seq",
        F.concat(F.lit("e_"), number, F.when(F.col("position") > 0, F.concat(F.lit("_"), "position")).otherwise(""))
        .alias("id"),
        F.lit("add").alias("op"),
        "name",
        "department",
        "shifts",
        none.cast("string").alias("shift"),
        "target_days",
        none.cast("boolean").alias("remote"),
        none.cast("boolean").alias("has_car"),
        F.lit(True).alias("name_sent"),
        F.lit(True).alias("department_sent"),
    )
    nobody = log.where(F.col("op") == "add").select("seq", names.alias("names"))
    nobody = nobody.where((F.size("names") > 0) & ~F.exists("names", lambda n: strip(n) != ""))
    edits = log.where(F.col("op") != "add").select(
        "seq",
        fields["id"].text().alias("id"),
        "op",
        fields["name"].text().alias("name"),
        fields["department"].text().alias("department"),
        F.when(fields["shifts"].sent, _shift_text(fields["shifts"])).alias("shifts"),
        fields["shift"].text().alias("shift"),
        target,
        F.when(fields["remote"].sent, fields["remote"].truthy()).alias("remote"),
        F.when(fields["hasCar"].sent, fields["hasCar"].truthy()).alias("has_car"),
        fields["name"].sent.alias("name_sent"),
        fields["department"].sent.alias("department_sent"),
    )
    nobody = nobody.select("seq", F.lit(ADD_NONE).alias("op"))
    return adds.unionByName(edits).unionByName(nobody, allowMissingColumns=True)


def feedback_commands(requests: DataFrame) -> DataFrame:
    """``feedback/submit``, ``/delete`` and ``/read`` requests as the feedback log, refused ones left out."""
    log = requests.withColumn("op", F.regexp_extract("op", r"\Afeedback/(submit|delete|read)\z", 1)).where("op <> ''")
    log, whole, fields = read_bodies(_allowed(log, ADMIN_FEEDBACK_OPS), "id", "name", "message", "category")
    given = F.concat(F.lit("fb_"), F.lower(F.lpad(F.hex("seq"), 8, "0")))
    fit = fields["name"].text_or_falsy() & fields["message"].text_or_falsy()
    log = log.where(object_or_falsy(whole) & ((F.col("op") != "submit") | fit))
    return log.select(
        "seq",
        "op",
        F.when(F.col("op") == "submit", given).otherwise(fields["id"].text()).alias("fb_id"),
        F.when(fields["name"].truthy(), fields["name"].text()).alias("name"),
        F.when(fields["message"].truthy(), fields["message"].text()).alias("message"),
        fields["category"].text().alias("category"),
        fields["category"].sent.alias("category_sent"),
        F.date_trunc("second", "ts").alias("ts"),
    )
