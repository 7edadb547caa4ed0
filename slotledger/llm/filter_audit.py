"""How five filters interact: what each removes in every order they could be applied in, by wide packed counters.

A document's failed filters are a mask of five bits. Every mask, with the two labels, stands for one big integer whose 64-bit fields
hold all 600 step outcomes (120 orders of five steps; kept, removed, redundant, good and toxic documents lost) and the five filters that
a document fails alone. Adding integers adds all fields at once; a field could only run over at 2**64 documents. Each task adds up
its documents by part, partial sums are added in two further steps (salted, then whole), and the fields are unpacked at the end.

Texts are read once. What is shuffled of a document is its id, its mask and 128 bits of its text's SHA-256, by which equal texts meet.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.llm.common import map_batches, read_table, stored, text_or_empty

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

# The filters' limits.
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # per cent of the words
MOST_CAPITALS = 3  # per cent of the code points
MARKS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))

METRICS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
FIELD_BYTES = 8
STEPS = len(ORDERS) * len(FILTERS)
FIELDS = STEPS * len(METRICS) + len(FILTERS)
GOOD, TOXIC, CLASSES = 1 << 5, 1 << 6, 1 << 7
SALTS = 64
#: Parts whose sums a task holds at a time, each an integer of 24 kB.
MOST_PARTS = 256

_NOT_CAPITALS = bytes(b for b in range(256) if b not in CAPITALS)


def text_mask(data: bytes, points: int) -> int:
    """Which of A to D a text fails, from its UTF-8 bytes and its number of code points."""
    words = data.split()  # bytes: only ASCII white space separates
    n = len(words)
    mask = n < LEAST_WORDS
    mask |= (100 * len(set(words)) < LEAST_DISTINCT * n) << 1
    mask |= (100 * len(data.translate(None, _NOT_CAPITALS)) > MOST_CAPITALS * points) << 2
    return mask | (MARKS.search(data) is not None) << 3


@lru_cache(maxsize=1)
def wide_integers() -> list[int]:
    """The integer of every class (mask, good, toxic): a one in the field of each outcome it has."""
    out = []
    for cls in range(CLASSES):
        fields = np.zeros(FIELDS, "<u8")
        for o, order in enumerate(ORDERS):
            alive = True
            for s, letter in enumerate(order):
                fails = bool(cls >> FILTERS.index(letter) & 1)
                lost = alive and fails
                row = (alive and not fails, lost, fails and not alive, lost and cls & GOOD, lost and cls & TOXIC)
                at = (o * len(FILTERS) + s) * len(METRICS)
                fields[at : at + len(METRICS)] = [bool(x) for x in row]
                alive = alive and not fails
        for f in range(len(FILTERS)):
            fields[STEPS * len(METRICS) + f] = cls % GOOD == 1 << f
        out.append(int.from_bytes(fields.tobytes(), "little"))
    return out


def unpacked(total: int) -> np.ndarray:
    return np.frombuffer(total.to_bytes(FIELDS * FIELD_BYTES, "little"), "<u8").astype(np.int64)


# ---- masks ------------------------------------------------------------------------------------------------------


def text_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, x and y (128 bits that stand for the text) and mask (A to D) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, masks = [], []
            for text in batch.column("text"):
                points = text.as_py()
                data = points.encode()
                digests.append(hashlib.sha256(data).digest()[:16])
                masks.append(text_mask(data, len(points)))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            columns = [*(batch.column(c) for c in ("doc_id", "part")), *(pa.array(halves[:, k], pa.int64()) for k in (0, 1)), pa.array(masks, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "x", "y", "mask"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        text_or_empty(F.col("text")).alias("text"),
    )
    return map_batches(rows, run, "doc_id long, part string, x long, y long, mask int")


def classes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and class (mask of all five filters, good, toxic) of every row."""
    rows = stored(text_masks(docs), "filter-masks")
    firsts = rows.groupBy("x", "y").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = stored(firsts, "filter-firsts")  # written, like the rows: adaptive execution can split a text with very many copies
    marked = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(marked("quality"), marked("toxic"))
    known = stored(known, "filter-labels")
    judged = rows.join(firsts, ["x", "y"], "left").join(known, "doc_id", "left")
    again = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    bit = lambda c, value: F.coalesce(c.cast("int"), F.lit(0)) * value
    cls = F.col("mask") + bit(again, 1 << 4) + bit(F.col("quality"), GOOD) + bit(F.col("toxic"), TOXIC)
    return judged.select("part", cls.cast("int").alias("cls"))


# ---- sums of integers -------------------------------------------------------------------------------------------


def _rows(sums: dict[str, int]) -> pa.RecordBatch:
    totals = [t.to_bytes(FIELDS * FIELD_BYTES, "little") for t in sums.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(totals, pa.binary())], ["part", "total"])


def packed_sums(judged: DataFrame) -> DataFrame:
    """part, total: the sum of the rows' integers, for each task and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, sums = wide_integers(), {}
        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            places, cls = np.asarray(parts.indices), np.asarray(batch.column("cls"))
            for place, part in enumerate(parts.dictionary.to_pylist()):
                counts = np.bincount(cls[places == place], minlength=CLASSES)
                seen = np.flatnonzero(counts).tolist()
                sums[part] = sums.get(part, 0) + sum(int(counts[c]) * wide[c] for c in seen)
                if len(sums) >= MOST_PARTS:
                    yield _rows(sums)
                    sums.clear()
        yield _rows(sums)

    return map_batches(judged, run, "part string, total binary")


def added(totals: DataFrame) -> DataFrame:
    """One total for each part in a partition; rows come sorted by part, so one integer is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, 0
        for batch in batches:
            for p, t in zip(batch.column("part").to_pylist(), batch.column("total")):
                if p != part:
                    if part is not None:
                        yield _rows({part: total})
                    part, total = p, 0
                total += int.from_bytes(t.as_py(), "little")
        if part is not None:
            yield _rows({part: total})

    return map_batches(totals.sortWithinPartitions("part"), run, "part string, total binary")


def step_rows(totals: DataFrame) -> DataFrame:
    """The 600 rows of each part's total."""
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.array([[FILTERS.index(c) for c in order] for order in ORDERS]).ravel()
        for batch in batches:
            for part, total in zip(batch.column("part").to_pylist(), batch.column("total")):
                fields = unpacked(int.from_bytes(total.as_py(), "little"))
                steps = dict(zip(METRICS, fields[: STEPS * len(METRICS)].reshape(STEPS, -1).T))
                removed = np.zeros(len(FILTERS), np.int64)
                np.add.at(removed, letters, steps["removed"])
                columns = {
                    "part": pa.array([part] * STEPS, pa.string()),
                    "filter_order": pa.array(np.repeat(ORDERS, len(FILTERS)).tolist(), pa.string()),
                    "step": pa.array(np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS)), pa.int32()),
                    "unique_fails": pa.array(fields[STEPS * len(METRICS) :][letters]),
                    "shapley": pa.array(removed[letters]),
                } | {m: pa.array(np.ascontiguousarray(v)) for m, v in steps.items()}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return map_batches(totals, run, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names[3:]))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for every part (lang; null as empty text), order of the five filters and step, with its counts.

    Null texts are empty and fail A. Repeated rows all count; E spares every row with the text's smallest id, and rows without an id come
    after all others: they fail E where a row with an id has their text. A label counts if any of an id's label rows has it. An
    empty table has no part and gives no row. Columns beyond doc_id, text, lang and doc_id, quality, toxic are ignored.
    """
    partial = packed_sums(classes(docs, labels))
    salted = partial.repartition("part", (F.spark_partition_id() % SALTS).alias("salt"))
    return step_rows(added(added(salted).repartition("part")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
  + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
  + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT) AS mask FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT f1.letter || f2.letter || f3.letter || f4.letter || f5.letter AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bs
  FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b + f2.b + f3.b + f4.b + f5.b = 31 AND f1.b | f2.b | f3.b | f4.b | f5.b = 31),
s AS (SELECT filter_order, step, bs[step] AS b, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, b,
  sum(n) FILTER (mask & (before | b) = 0) AS kept, sum(n) FILTER (mask & b > 0 AND mask & before = 0) AS removed,
  sum(n) FILTER (mask & b > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (mask = b) AS unique_fails,
  sum(n) FILTER (mask & b > 0 AND mask & before = 0 AND good = 1) AS good_lost,
  sum(n) FILTER (mask & b > 0 AND mask & before = 0 AND toxic = 1) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, b), 0) AS BIGINT) AS shapley
FROM r
"""
