"""Booking-shaped inputs derived from the test tables, each as a DataFrame and as the same thing in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Given with every read, so that no job has to look at the files first.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book / unbook log, from ``events``."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    unbook = F.col("event_type") == "error"
    hour = F.hour("ts")
    weekend = F.weekday(F.col("ts").cast("date")) >= 5
    return events.withColumn("k", k).select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("date").alias("date"),
        F.when(weekend, "weekend").when(hour < 8, "night").when(hour < 16, "day").otherwise("evening").alias("shift"),
        F.when(F.col("k") % 3 == 0, "parking").otherwise("desks").alias("kind"),
        F.when(F.col("k") % 3 == 0, F.col("k") % 10 + 1).otherwise(F.col("k") % 28 + 1).cast("string").alias("slot"),
        F.when(unbook, "unbook").otherwise("book").alias("op"),
        F.when(~(unbook & (F.col("k") % 4 == 1)), F.concat(F.lit("e_"), F.col("user_id") % 40)).alias("user_id"),
        (unbook & (F.col("k") % 5 == 0)).alias("is_admin"),
    )


def commands_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log with defects, for validation."""
    seq = F.col("seq")
    return commands(spark, sf_dir).select(
        "seq",
        F.when(seq % 11 != 0, F.col("date")).alias("date"),
        F.when(seq % 13 == 0, "noon").otherwise(F.col("shift")).alias("shift"),
        F.when(seq % 17 == 0, "bike").otherwise(F.col("kind")).alias("kind"),
        F.when(seq % 19 == 0, "").otherwise(F.col("slot")).alias("slot"),
        "op",
        F.when(seq % 23 != 0, F.col("user_id")).alias("user_id"),
        "is_admin",
    )


def bookings(
    spark: SparkSession, sf_dir: str, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Settled bookings, from ``lineitem`` and ``orders``: one owner per slot, the customer with the lowest number.

    Dates are derived from a timestamp. With the bounds of a report period given, that timestamp is filtered as well,
    which the scan can use.
    """
    lines = table(spark, sf_dir, "lineitem")
    if start is not None:
        lines = lines.where(F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        lines = lines.where(F.col("l_shipdate") < F.lit(end + dt.timedelta(days=1)).cast("timestamp_ntz"))
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    date = F.col("l_shipdate").cast("date")
    line = F.col("l_linenumber")
    desks = F.col("l_linestatus") == "O"
    slots = lines.select(
        F.col("l_orderkey").alias("o_orderkey"),
        date.alias("date"),
        F.when((F.weekday(date) >= 5) & (line < 6), "weekend")
        .when(line % 3 == 0, "day")
        .when(line % 3 == 1, "evening")
        .otherwise("night")
        .alias("shift"),
        F.when(desks, "desks").otherwise("parking").alias("kind"),
        F.when(desks, F.col("l_partkey") % 28 + 1).otherwise(F.col("l_suppkey") % 10 + 1).alias("slot"),
    )
    # Numbers until after the aggregate, which can then hash; a minimum of text would sort every row first.
    claims = slots.join(owners, "o_orderkey")
    owned = claims.groupBy("date", "shift", "kind", "slot").agg(F.min("o_custkey").alias("owner"))
    return owned.select(
        "date",
        "shift",
        "kind",
        F.col("slot").cast("string").alias("slot"),
        F.concat(F.lit("e_"), "owner").alias("user_id"),
    )


def bookings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bookings with the text their day is stored under: some days are written in a way that is no date."""
    odd = F.col("user_id").endswith("7")
    text = F.date_format("date", "yyyy-MM-dd"), F.date_format("date", "yyyy/MM/dd")
    return bookings(spark, sf_dir).select(
        F.when(~odd, F.col("date")).alias("date"),
        F.when(odd, text[1]).otherwise(text[0]).alias("date_raw"),
        "shift",
        "kind",
        "slot",
        "user_id",
    )


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The employee table, from ``customer``. One market segment is external staff, so its bookings dangle."""
    key = F.col("c_custkey")
    inside = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") != "MACHINERY")
    shift = F.when(key % 4 == 0, "day").when(key % 4 == 1, "evening").when(key % 4 == 2, "night").otherwise("weekend")
    return inside.select(
        F.concat(F.lit("e_"), key).alias("id"),
        key.alias("ordinal"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("department"),
        shift.alias("shift"),
        F.when(key % 5 != 0, (1 + key % 4).cast("bigint")).alias("target_days"),
    )


def config_cmds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings log, from ``part``: readable and unreadable numbers, comma lists with junk."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    names = ("desks", "parking", "targetDays", "year", "unavailableDesks", "unavailableParking")
    listed = F.concat(size, F.lit(", "), "p_brand", F.lit(","), (key % 10).cast("string"), F.lit(", "))
    return table(spark, sf_dir, "part").select(
        (2 * key).alias("seq"),
        F.element_at(F.array(*map(F.lit, names)), (key % 6 + 1).cast("int")).alias("key"),
        F.when(key % 6 >= 4, listed).when(key % 5 == 0, F.col("p_brand")).otherwise(size).alias("raw_value"),
    )


def employee_cmds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The employee log: adds from ``customer``, then sparse updates and deletes from ``orders``."""
    key = F.col("c_custkey")
    none = F.lit(None)
    adds = table(spark, sf_dir, "customer").select(
        (2 * key + 1).alias("seq"),
        F.concat(F.lit("e_"), key).alias("id"),
        F.lit("add").alias("op"),
        F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"),
        F.col("c_mktsegment").alias("department"),
        F.when(key % 3 == 0, "day, night").when(key % 3 == 1, "bogus").otherwise("evening,evening").alias("shifts"),
        none.cast("string").alias("shift"),
        F.when(key % 4 != 0, (1 + key % 5).cast("string")).alias("target_days"),
        none.cast("boolean").alias("remote"),
        none.cast("boolean").alias("has_car"),
    )
    order, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    by_three = order % 3
    edits = table(spark, sf_dir, "orders").select(
        (F.lit(EDIT_OFFSET) + order).alias("seq"),
        F.concat(F.lit("e_"), "o_custkey").alias("id"),
        F.when((F.col("o_orderstatus") == "F") & (order % 50 == 0), "delete").otherwise("update").alias("op"),
        none.cast("string").alias("name"),
        F.when(priority == "3-MEDIUM", F.col("o_orderstatus")).alias("department"),
        F.when(
            priority == "1-URGENT",
            F.when(by_three == 0, "night,day").when(by_three == 1, "nope").otherwise("weekend"),
        ).alias("shifts"),
        F.when(
            priority == "2-HIGH", F.when(by_three == 0, "evening").when(by_three == 1, "nope").otherwise("night")
        ).alias("shift"),
        F.when(
            priority == "4-NOT SPECIFIED", F.when(by_three == 0, "x").otherwise((order % 6).cast("string"))
        ).alias("target_days"),
        F.when(priority == "5-LOW", order % 2 == 0).alias("remote"),
        F.when((priority == "5-LOW") & (order % 4 < 2), order % 4 == 0).alias("has_car"),
    )
    return adds.unionByName(edits)


# Employee edits arrive after every add, at any table size.
EDIT_OFFSET = 1_000_000_000_000


def add_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to add employees, from ``part``: lists of names, single names, blank and missing ones."""
    key = F.col("p_partkey")
    names = F.array(F.col("p_name"), F.lit(" \t"), F.concat(F.lit("  "), "p_brand", F.lit(" ")), F.lit(None))
    single = F.when(key % 9 == 1, F.concat(F.lit(" "), "p_name")).when(key % 9 == 4, "   ").when(key % 9 == 7, "")
    return table(spark, sf_dir, "part").select(
        key.alias("seq"), F.when(key % 3 == 0, names).alias("names"), single.alias("name")
    )


def feedback_cmds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feedback log, from ``conversations``: submit, then read / delete of earlier or unknown ids."""
    turns = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    ordinal = conv * 100 + turn
    spaced = F.concat(F.lit("  "), "role", conv.cast("string"), F.lit(" "))
    none = F.lit(None).cast("string")
    submits = turns.select(
        (10 * ordinal).alias("seq"),
        F.lit("submit").alias("op"),
        ordinal.alias("fb_id"),
        F.when(turn == 0, none).when(turn == 1, "   ").otherwise(spaced).alias("name"),
        F.when((conv % 6 == 0) & (turn == 1), "   ").otherwise(F.col("text")).alias("message"),
        F.when(turn % 2 == 0, F.col("role")).alias("category"),
    )
    edits = turns.where(turn > 0).select(
        (10 * ordinal + 5).alias("seq"),
        F.when(conv % 3 == 0, "delete").otherwise("read").alias("op"),
        F.when(conv % 9 == 0, F.lit(-1).cast("bigint")).otherwise(conv * 100).alias("fb_id"),
        none.alias("name"),
        none.alias("message"),
        none.alias("category"),
    )
    return submits.unionByName(edits)


# Bodies of the request log by kind; ``$p`` stands for the part's number. Odd in as many ways as clients are.
CONFIG_BODIES = (
    "{}",
    '{"desks": $p}',
    '{"desks": "$p", "parking": 7}',
    '{"unavailableDesks": "1, x,3 ,"}',
    '{"unavailableParking": [1, "2", null, "z"], "year": 2027.9}',
    "not json",
    '{"targetDays": null, "desks": true}',
    '{"targetDays": " +3 ", "color": "blue"}',
    "5",
    '"x"',
    "[1]",
)
ADD_BODIES = (
    '{"names": ["A $p", " ", "B"]}',
    '{"names": [" ", ""]}',
    '{"name": "  N $p ", "department": "ops", "shifts": "night,x"}',
    '{"name": "X", "targetDays": "bad"}',
    '{"targetDays": "4", "shift": "evening"}',
    "[1]",
    '{"name": 12}',
    '{"names": [5, "a"]}',
)
UPDATE_FIELDS = (
    '"name": null',
    '"department": null, "shifts": ["nope"]',
    '"shift": "weekend", "targetDays": 5.9',
    '"remote": 0, "hasCar": "yes", "targetDays": "x"',
    '"name": 12, "shifts": "day,night"',
)
SUBMIT_BODIES = (
    '{"message": "  m $p ", "category": null}',
    '{"message": "m $p", "name": "  "}',
    '{"message": "   ", "name": "a"}',
    '{"message": "m $p", "name": "a", "category": "bug"}',
    '{"message": 5}',
    '{"message": "m", "name": 7}',
)
BOOK_BODIES = (
    '{"date": "2026-01-05", "shift": "day", "kind": "desks", "slot": $p, "userId": "u$p"}',
    '{"date": "2026-01-05", "shift": "day", "kind": "desks", "slot": null, "userId": "u$p"}',
    '{"date": "2026-01-05", "shift": "day", "kind": "desks", "userId": "u"}',
    '{"date": "2026-01-05", "shift": ["day"], "kind": "desks", "slot": 1, "userId": "u"}',
    '{"date": "2026-01-05", "shift": "day", "kind": "parking", "slot": true, "userId": 0}',
    '{"date": 5, "shift": "day", "kind": "parking", "slot": "x", "userId": 7}',
    '{"date": "2026-01-05", "shift": "day", "kind": "desks", "slot": 1.0, "userId": "v$p"}',
    '{"date": "2026-01-05", "shift": "day", "kind": "desks", "slot": 1.50, "userId": "w$p"}',
    '{"date": "2026-01-05", "shift": "day", "kind": "desks", "slot": {}, "userId": "x$p"}',
    "[7]",
)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log with JSON bodies, from ``part``: six requests per part, of all four kinds."""
    p = F.col("p_partkey")

    def of(bodies: tuple[str, ...]) -> Column:
        body = F.element_at(F.array(*map(F.lit, bodies)), (p % len(bodies) + 1).cast("int"))
        return F.replace(body, F.lit("$p"), p.cast("string"))

    def given(prefix: str, step: int) -> Column:
        return F.concat(F.lit(prefix), F.lower(F.lpad(F.hex(p * 10 + step), 8, "0")))

    update = F.concat(F.lit('{"id": "'), given("e_", 2), F.lit('", '), of(UPDATE_FIELDS), F.lit("}"))
    rows = (
        (1, F.lit("config"), of(CONFIG_BODIES)),
        (2, F.lit("employees/add"), of(ADD_BODIES)),
        (3, F.lit("employees/update"), update),
        (4, F.lit("feedback/submit"), of(SUBMIT_BODIES)),
        (5, F.lit("feedback/delete"), F.concat(F.lit('{"id": "'), given("fb_", 4), F.lit('"}'))),
        (6, F.lit("book"), of(BOOK_BODIES)),
    )
    entries = F.array(*[F.struct((p * 10 + step).alias("seq"), op.alias("op"), body.alias("body")) for step, op, body in rows])
    # A small file is one task's, and its requests are not small: the parts are dealt out first.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = table(spark, sf_dir, "part").select("p_partkey").repartition(tasks, "p_partkey")
    return parts.select(F.inline(entries)).select(
        "seq",
        F.lit(None).cast("timestamp").alias("ts"),
        "op",
        # Deleting feedback takes authority, which every third such request lacks.
        ((F.col("op") != "feedback/delete") | (F.col("seq") % 3 != 0)).alias("is_admin"),
        "body",
    )
