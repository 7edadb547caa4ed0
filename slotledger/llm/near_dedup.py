"""Near-duplicate documents by SimHash, found with covering locality-sensitive hashing.

Bit i of a fingerprint carries a vector m(i) of r + 1 bits. For every non-zero v of r + 1 bits, table v keeps the bits with odd
<m(i), v>. At most r differing bits span at most r dimensions, so some v is orthogonal to all their vectors, and the two
fingerprints agree in that table: every pair within the radius meets, with certainty.

Equal fingerprints are one row from the start. Buckets of up to ``small_bucket`` fingerprints are compared inside, and a star over each
of their components comes out, never their pairs. Fingerprints of larger buckets meet at neighbours instead: two within three bits have a
point within one bit of the one and two of the other, and whatever lies within two bits of a point is at most 2,081 fingerprints,
so those groups are bounded by geometry, and again a star comes out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.llm.common import KEY, key_columns, map_batches, read_table, stored, text_or_empty
from slotledger.llm.components import components

# Fixed values of the fingerprint.
SHINGLE_WORDS = 3
HASH_SEED = 42
RADIUS = 3

SMALL_BUCKET = 2_048
_VOTES_AT_ONCE = 1 << 16


def fingerprint(text: str) -> int:
    """Signed 64 bits: bit i is set if over half of the shingles' hashes have it set. Zero without words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(SHINGLE_WORDS, len(words))
    starts, ends = (ends - lengths)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_digest
    votes, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, _VOTES_AT_ONCE):
        hashes = b"".join([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[k : k + _VOTES_AT_ONCE], ends[k : k + _VOTES_AT_ONCE])])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key and fp (signed 64 bits) of every row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fps, pa.int64())], [*names, "fp"])

    names = ["doc_id", *KEY]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key_columns(), text_or_empty(F.col("text")).alias("text"))
    return map_batches(rows, run, "doc_id long, k long, h long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One mask of about half the 64 bits per table, as signed numbers; bits take the non-zero vectors in turn."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(64)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [signed(m) for m in masks]


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def star_of(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges from each fingerprint to the smallest of its component within the bucket."""
    bits = fps.view(np.uint64)  # the bits of a negative number are not those of its size
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    labels = np.arange(len(fps))
    while True:
        least = np.where(near, labels[None, :], len(fps)).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == labels).all():
            return [(int(fps[i]), int(fps[j])) for i, j in enumerate(labels.tolist()) if i != j]
        labels = least


def _bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = []
            for fps in batch.column("fps"):
                edges += star_of(np.sort(np.array(fps.as_py(), np.int64)), radius)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return map_batches(buckets.select("fps"), run, "a long, b long")


def _crowd_links(fps: DataFrame) -> DataFrame:
    """Links within three bits among the fingerprints of large buckets, by points near them."""
    one = [1 << i for i in range(64)]
    near = [0, *map(signed, one)]
    further = [signed(a | b) for a, b in combinations(one, 2)]
    points = fps.select("fp", F.explode(F.array(*map(F.lit, near))).alias("d")).select("fp", (F.col("fp").bitwiseXOR(F.col("d"))).alias("z"), F.lit(True).alias("close"))
    rest = fps.select("fp", F.explode(F.array(*map(F.lit, further))).alias("d")).select("fp", (F.col("fp").bitwiseXOR(F.col("d"))).alias("z"), F.lit(False).alias("close"))
    met = points.union(rest).groupBy("z").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("centre"), F.collect_list("fp").alias("fps"))
    met = met.where(F.col("centre").isNotNull() & (F.size("fps") > 1))
    return met.select(F.explode("fps").alias("a"), F.col("centre").alias("b")).where("a <> b").distinct()


def links(distinct: DataFrame, radius: int = RADIUS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``distinct`` (fp) within ``radius`` (three at most)."""
    if radius > 3:
        raise ValueError("crowded buckets are resolved within three bits")
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(covering_masks(radius))])
    keyed = distinct.select("fp", F.inline(tables))
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, ["t", "k"])
    buckets = shared.where(F.col("n") <= small_bucket).groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
    crowds = shared.where(F.col("n") > small_bucket).select("fp").distinct()
    return _bucket_links(buckets, radius).union(_crowd_links(crowds))


def grouped(docs: DataFrame, radius: int = RADIUS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """doc_id, key, fp and root (the smallest fingerprint of the component) of every row."""
    rows = stored(fingerprints(docs), "fingerprints")
    distinct = stored(rows.select("fp").distinct(), "distinct-fingerprints")
    roots = components(links(distinct, radius, small_bucket))
    placed = distinct.join(roots, distinct["fp"] == roots["vertex"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return rows.join(stored(placed, "roots"), "fp")  # two written tables: adaptive execution can split a hot fingerprint


def near_duplicates(docs: DataFrame, radius: int = RADIUS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) for every row.

    Null and empty texts have fingerprint zero and link like any other. Rows without an id take part; a component of such
    rows only has a null id. Repeated rows stay, one each. An empty table gives none; other columns are ignored.
    """
    rows = stored(grouped(docs, radius, small_bucket), "near-groups")
    lowest = stored(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "lowest")  # as in ``grouped``, for a hot root
    return rows.join(lowest, "root").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The key of one row of each group: the smallest id (null last), then the smallest hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), *KEY)).alias("first")
    return grouped(docs, radius).groupBy("root").agg(first).select("first.k", "first.h")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
