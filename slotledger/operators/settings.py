"""The settings log: which value each key has in the end, and at the time of another command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.functions.text import comma_items, int_items, to_int
from slotledger.operators.scan import as_of, running_last
from slotledger.schemas import DEFAULT_SETTINGS, DEFAULT_TARGET_DAYS, LIST_SETTINGS, Settings
from slotledger.session import checkpoint


def effective_settings(log: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The last readable number of each numeric setting ``(key, value)``; keys never set keep their default.

    ``stored`` are settings (key, value) that the log goes on from. They and the defaults join the log as first commands, so
    one aggregate yields every key.
    """
    spark = log.sparkSession
    number = to_int(F.col("raw_value"))
    sent = log.where(F.col("key").isin(*DEFAULT_SETTINGS)).select("key", "seq", number.alias("value"))
    defaults = spark.range(1).select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(key).alias("key"),
                        F.lit(None).cast("bigint").alias("seq"),
                        F.lit(value).cast("bigint").alias("value"),
                    )
                    for key, value in DEFAULT_SETTINGS.items()
                )
            )
        )
    )
    kept = sent.where(F.col("value").isNotNull()).withColumn("rank", F.lit(2)).unionByName(defaults.withColumn("rank", F.lit(0)))
    if stored is not None:
        known = stored.where(F.col("key").isin(*DEFAULT_SETTINGS) & F.col("value").isNotNull())
        nothing = F.lit(None).cast("bigint").alias("seq")
        kept = kept.unionByName(known.select("key", nothing, F.col("value").cast("bigint").alias("value"), F.lit(1).alias("rank")))
    # A default loses against what is stored, and that against any command.
    return kept.groupBy("key").agg(F.max_by("value", F.struct("rank", "seq")).alias("value"))


def settings_of(effective: DataFrame) -> Settings:
    """Effective settings, a row per key, as the record the reports take: four numbers at most."""
    values = {r["key"]: r["value"] for r in effective.where(F.col("key").isin(*DEFAULT_SETTINGS)).collect()}
    return Settings(values["desks"], values["parking"], values["targetDays"])


def effective_lists(log: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The last list of each list setting ``(key, numbers)``; a list is replaced as a whole, junk in it is dropped.

    ``stored`` are lists (key, numbers) that the log goes on from.
    """
    sent = log.where(F.col("key").isin(*LIST_SETTINGS) & F.col("raw_value").isNotNull())
    last = sent.groupBy("key").agg(F.max_by("raw_value", "seq").alias("raw_value"))
    lists = last.select("key", int_items(comma_items(F.col("raw_value"))).alias("numbers"))
    if stored is None:
        return lists
    known = stored.where(F.col("key").isin(*LIST_SETTINGS) & F.col("numbers").isNotNull()).select("key", "numbers")
    both = known.withColumn("rank", F.lit(0)).unionByName(lists.withColumn("rank", F.lit(1)))  # a row or two per key
    return both.groupBy("key").agg(F.max_by("numbers", "rank").alias("numbers"))


def _list_text(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda n: n.cast("string")), ",")


def _known_texts(stored: DataFrame | None, lists: DataFrame | None) -> dict[str, str]:
    """Every setting's text before the log: a few numbers and two lists."""
    known = {key: str(default) for key, default in DEFAULT_SETTINGS.items()} | dict.fromkeys(LIST_SETTINGS, "")
    if stored is not None:
        numbers = stored.where(F.col("key").isin(*DEFAULT_SETTINGS) & F.col("value").isNotNull())
        known |= {r["key"]: r["text"] for r in numbers.select("key", F.col("value").cast("string").alias("text")).collect()}
    if lists is not None:
        named = lists.where(F.col("key").isin(*LIST_SETTINGS) & F.col("numbers").isNotNull())
        known |= {r["key"]: r["text"] for r in named.select("key", _list_text(F.col("numbers")).alias("text")).collect()}
    return known


def settings_changes(log: DataFrame, stored: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame:
    """The change events of the settings log: one per request, with all settings as they are after it.

    ``stored`` (key, value) and ``lists`` (key, numbers) are the settings that the log goes on from.

    A request is one ``seq``, however many settings it sends. One that sends none, or nothing readable, is an event too; it
    has a row with a NULL key. The detail is a JSON object.
    """
    known = _known_texts(stored, lists)
    number, listed = to_int(F.col("raw_value")), int_items(comma_items(F.col("raw_value")))
    numbers = [F.max(F.when(F.col("key") == key, number)).alias(key) for key in DEFAULT_SETTINGS]
    texts = [F.max(F.when(F.col("key") == key, _list_text(listed))).alias(key) for key in LIST_SETTINGS]
    requests = checkpoint(log.groupBy("seq").agg(*numbers, *texts))
    after = running_last(requests, "seq", [*DEFAULT_SETTINGS, *LIST_SETTINGS])
    fields = [F.coalesce(F.col(key).cast("string"), F.lit(known[key])) for key in DEFAULT_SETTINGS]
    fields += [F.concat(F.lit("["), F.coalesce(key, F.lit(known[key])), F.lit("]")) for key in LIST_SETTINGS]
    named = [F.concat(F.lit(f'"{key}":'), field) for key, field in zip([*DEFAULT_SETTINGS, *LIST_SETTINGS], fields)]
    return after.select(
        F.lit("settings").alias("log"),
        "seq",
        F.lit("config").alias("action"),
        F.lit(None).cast("string").alias("ref"),
        F.concat(F.lit("{"), F.concat_ws(",", *named), F.lit("}")).alias("detail"),
    )


def target_as_of(adds: DataFrame, log: DataFrame, along: DataFrame | None = None, before: int = DEFAULT_TARGET_DAYS) -> DataFrame:
    """Employee adds with ``default_target``: the weekly target configured when each add arrived, ``before`` the log's first one.

    Both logs share one arrival order. See ``scan.as_of`` for ``along``.
    """
    history = log.where(F.col("key") == "targetDays").select("seq", to_int(F.col("raw_value")).alias("default_target"))
    default = F.lit(before).cast("bigint")
    found = as_of(adds, history, "seq", "default_target", along)
    return found.withColumn("default_target", F.coalesce("default_target", default))
