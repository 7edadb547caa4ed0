"""Mixing sources to target weights: how often each document is taken, by pivotal rounding of fractional copies.

Every source gets a target in words. A document's expected copies are target / source size; the whole part is taken, the
fraction is a probability. Two open documents at a time, words are moved from one to the other, the direction at random so
that expectations stay, until one of them is taken or left for good. The words expected of a source never change on the way,
so what is taken misses the target by half of one document at most: the last one open.

Documents of a source are dealt to leaves of bounded size by a hash. Each leaf leaves one open document at most, and
those meet in a tree of the same step. Random numbers are hashes of ids, so reruns agree, however many tasks run.
"""

from __future__ import annotations

import math

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotledger.llm.common import WORD_PATTERN, read_table, ship, stored, text_or_empty

# Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = 7

LEAF_ROWS = 5_000
FAN = 1_000
CLOSE = 1e-9


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD_PATTERN)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target: the weighted share of all words, no source above ``most`` times its size.

    A source's uncapped target is level x weight. Sources reach their caps in order of cap / weight, and the level is the
    largest that any split of that order into capped and others gives. Windows run over one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    weighed = per_source.withColumn("place", rank).withColumn("weight", weight.cast("double"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    capped = F.coalesce(F.sum("source_size").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(everything) - most * capped) / open_weight
    leveled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("level") * F.col("weight"), most * F.col("source_size").cast("double"))
    return leveled.select("source", "source_size", "n_docs", target.alias("target"))


def _uniform(*parts) -> float:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode(), SEED) / 2**64


def pivot(keys: list, sizes: list, chances: list, level: int) -> tuple[list[int | None], int | None, float]:
    """0 or 1 for every document but one at most, which stays open with the chance returned."""
    taken: list[int | None] = [None] * len(keys)
    held, chance = None, 0.0
    for i in range(len(keys)):
        p = chances[i]
        if p <= CLOSE or p >= 1 - CLOSE or sizes[i] == 0:
            taken[i] = int(_uniform("alone", keys[i]) < p)
            continue
        if held is None:
            held, chance = i, p
            continue
        a, b = sizes[held], sizes[i]
        up = min(a * (1 - chance), b * p)  # words that can move to the held one
        down = min(a * chance, b * (1 - p))
        move = up if _uniform(level, keys[held], keys[i]) * (up + down) < down else -down
        chance, p = chance + move / a, p - move / b
        held_open, p_open = CLOSE < chance < 1 - CLOSE, CLOSE < p < 1 - CLOSE
        if not p_open:
            taken[i] = round(p)
        if not held_open:
            taken[held] = round(chance)
            held, chance = (i, p) if p_open else (None, 0.0)
    return taken, held, chance


def _round(level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "order"], ascending=[False, True], kind="stable").reset_index(drop=True)
        keys = [f"{k}/{o}" for k, o in zip(pdf["key"], pdf["order"])]
        taken, held, chance = pivot(keys, pdf["size"].tolist(), pdf["chance"].tolist(), level)
        if held is not None:
            pdf.loc[held, "chance"] = chance
            if last:
                taken[held] = int(chance >= 0.5)
        pdf["extra"] = pd.array(taken, "Int32")
        return pdf

    return run


def mix(sizes: DataFrame, share: float = SHARE, weights=WEIGHTS, leaf_rows: int = LEAF_ROWS, fan: int = FAN) -> DataFrame:
    """``sizes`` (key, source, size) with source_size, target and copies (0, 1 or 2).

    A null source is a source of its own, last in order. Sources without words have target 0. Rows of size 0 take no words,
    whatever their copies. Rows with one key are told apart by size only, and rows alike in both are dealt together. An empty
    table gives none.
    """
    spark = sizes.sparkSession
    ship(spark)
    kind = sizes.schema["key"].dataType.simpleString()
    sizes = stored(sizes.select("key", F.col("source").cast("string").alias("source"), F.col("size").cast("long").alias("size")), "mix-sizes")
    targets = stored(source_targets(sizes, share, weights), "mix-targets")
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    same_source = sizes["source"].eqNullSafe(targets["source"])
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    order = F.xxhash64("key", "size")
    rows = (
        sizes.join(targets, same_source)
        .select("key", sizes["source"], "size", copies.alias("copies"), order.alias("order"), "n_docs")
        .withColumn("whole", F.floor(F.col("copies") + CLOSE).cast("long"))
        .withColumn("chance", F.greatest(F.col("copies") - F.col("whole"), F.lit(0.0)))
        .withColumn("leaf", F.pmod(F.xxhash64("order"), F.ceil(F.col("n_docs") / leaf_rows)))
    )
    schema = f"key {kind}, source string, size long, whole long, chance double, leaf long, order long, extra int"
    columns = ["key", "source", "size", "whole", "chance", "leaf", "order"]
    leaves, level, settled = math.ceil(largest / leaf_rows), 0, []
    while True:
        last = leaves <= 1
        done = stored(rows.select(columns).groupBy("source", "leaf").applyInPandas(_round(level, last), schema), f"mix-{level}")
        settled.append(done.where("extra is not null"))
        if last:
            break
        rows = done.where("extra is null").withColumn("leaf", F.floor(F.col("leaf") / fan).cast("long"))
        leaves, level = math.ceil(leaves / fan), level + 1
    decided = settled[0]
    for more in settled[1:]:
        decided = decided.unionByName(more)
    return decided.join(targets, decided["source"].eqNullSafe(targets["source"])).select(
        "key", decided["source"], "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies")
    )


def document_mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words, repeats counted) for every row."""
    sizes = docs.select(F.col("doc_id").alias("key"), "source", word_count(F.col("text")).alias("size"))
    mixed = mix(sizes)
    return mixed.select(
        F.col("key").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def take_mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns unchanged.

    Rows alike in id, source and size share their copies evenly, the odd ones in order of text hash. The text is shuffled
    once: the window after the join needs no other partitioning than the join's.
    """
    alike = ["doc_id", "source", "size"]
    decided = document_mix(docs).groupBy(*alike).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    decided = decided.where("copies > 0").select(
        F.xxhash64(*alike).alias("_key"), *[F.col(c).alias(f"_{c}") for c in [*alike, "copies", "rows"]]
    )
    size, source = word_count(F.col("text")), F.col("source").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), size.alias("_n"), F.xxhash64("doc_id", source, size).alias("_at"))
    same = (
        (F.col("_at") == F.col("_key"))
        & F.col("_row.doc_id").eqNullSafe(F.col("_doc_id"))
        & F.col("_row.source").cast("string").eqNullSafe(F.col("_source"))
        & (F.col("_n") == F.col("_size"))
    )
    turn = F.row_number().over(Window.partitionBy("_at", "_doc_id", "_source", "_size").orderBy(F.xxhash64("_row.text")))
    share = F.floor(F.col("_copies") / F.col("_rows")) + (turn <= F.col("_copies") % F.col("_rows")).cast("int")
    taken = rows.join(decided, same).withColumn("_times", share.cast("int")).where("_times > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
