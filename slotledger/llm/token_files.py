"""Token-id files of directly addressable codes, and readers that start anywhere in them.

An id is cut into chunks of eight bits, lowest first. Level 0 has the first chunk of every id, level k the next chunk of
the ids that go on, in order. A bitmap beside each level but the last says which ids go on, and a directory holds the number
of set bits before each 512, so that the place of an id in the next level is one rank away and nothing before it is
decoded. Blocks of whole documents are rows of Parquet files, written by Spark's committer, in ascending document order:
``shard`` (the partition), ``block`` (its place there), the documents' ids and lengths, and the levels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotledger.llm.common import map_batches, read_table, text_or_empty
from slotledger.llm.tokens import TOKENIZER_PATH, text_ids
from slotledger.session import shared_path

RANK_BITS = 512
END_ID = 0

BLOCK_SCHEMA = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())),
        ("levels", pa.list_(pa.binary())),
        ("bitmaps", pa.list_(pa.binary())),
        ("ranks", pa.list_(pa.binary())),
    ]
)
BLOCK_DDL = (
    "shard int, block int, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, "
    "levels array<binary>, bitmaps array<binary>, ranks array<binary>"
)


# ---- the code itself --------------------------------------------------------------------------------------------


def encode_block(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of unsigned 32-bit ids."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        rest = rest >> 8
        more = rest != 0
        if not more.any():
            return levels, bitmaps, ranks
        bitmap = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(bitmap) * 8 // RANK_BITS) * RANK_BITS // 8, np.uint8)
        words[: len(bitmap)] = bitmap
        counts = np.bitwise_count(words.reshape(-1, RANK_BITS // 8)).sum(axis=1, dtype=np.uint32)
        bitmaps.append(bitmap.tobytes())
        ranks.append(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4").tobytes())
        rest = rest[more]


def decode_block(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a block."""
    ids = np.frombuffer(levels[0], np.uint8).astype(np.uint32)
    where = None
    for k, bitmap in enumerate(bitmaps):
        n = len(levels[k])
        more = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n, bitorder="little").view(bool)
        where = np.flatnonzero(more) if where is None else where[more]
        ids[where] |= np.frombuffer(levels[k + 1], np.uint8).astype(np.uint32) << np.uint32(8 * (k + 1))
    return ids


def id_at(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """One id, by rank: at most four reads, none of them of anything before the id."""
    value = levels[0][i]
    for k, bitmap in enumerate(bitmaps):
        if not bitmap[i >> 3] >> (i & 7) & 1:
            break
        first = i // RANK_BITS
        before = bitmap[first * RANK_BITS // 8 : i >> 3]
        tail = bitmap[i >> 3] & ((1 << (i & 7)) - 1)
        i = int.from_bytes(ranks[k][4 * first : 4 * first + 4], "little") + int.from_bytes(before, "little").bit_count() + tail.bit_count()
        value |= levels[k + 1][i] << 8 * (k + 1)
    return value


# ---- writing and reading ----------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER_PATH, end_id: int = END_ID, block_tokens: int = 1 << 18) -> None:
    """Encode every row and write the files.

    Null texts are empty, each row ends with ``end_id``, null ids come first, and rows with one id are ordered by text
    hash. A block holds whole documents: it closes once it has ``block_tokens``, and a longer document is a block of its own size.
    An empty table writes an empty, readable folder.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, held, size, doc_ids, lengths = TaskContext.get().partitionId(), 0, [], 0, [], []
        end = np.array([end_id], "<u4").tobytes()

        def closed() -> pa.RecordBatch:
            levels, bitmaps, ranks = encode_block(np.frombuffer(b"".join(held), "<u4"))
            row = [shard, block, size, list(doc_ids), list(lengths), levels, bitmaps, ranks]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCK_SCHEMA)], schema=BLOCK_SCHEMA)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = text_ids(tokenizer, text.as_py()) + end
                held.append(ids)
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                size += lengths[-1]
                if size >= block_tokens:
                    yield closed()
                    block, size = block + 1, 0
                    held.clear(), doc_ids.clear(), lengths.clear()
        if held:
            yield closed()

    text = text_or_empty(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    map_batches(ordered, encode, BLOCK_DDL).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_DDL).parquet(path)


def block_starts(blocks: DataFrame) -> DataFrame:
    """shard, block and the number of ids before it: sums by shard first, then one small row per shard in order."""
    sizes = blocks.select("shard", "block", "n_tokens")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.select("shard", "block", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inside"))
    return inside.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("inside")).alias("block_start"))


def documents_of(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, decoded from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids = decode_block(row["levels"], row["bitmaps"]).astype("<u4")
                lengths = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), row["doc_tokens"])]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * n, pa.int32()),
                        pa.array([row["block"]] * n, pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = map_batches(
        blocks.select("shard", "block", "doc_ids", "doc_tokens", "levels", "bitmaps"),
        decode,
        "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long",
    )
    placed = rows.join(block_starts(blocks), ["shard", "block"])
    return placed.select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (shard, block, offset in the block) with the id there, read by rank. Offsets outside the block give null."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for i in range(batch.num_rows):
                levels, bitmaps, ranks = (batch.column(c)[i].as_py() for c in ("levels", "bitmaps", "ranks"))
                offset = batch.column("offset")[i].as_py()
                inside = offset is not None and 0 <= offset < len(levels[0])
                ids.append(id_at(levels, bitmaps, ranks, offset) if inside else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("shard", "block", "offset")), pa.array(ids, pa.int64())], ["shard", "block", "offset", "id"]
            )

    held = blocks.select("shard", "block", "levels", "bitmaps", "ranks")
    joined = wanted.select("shard", "block", F.col("offset").cast("long").alias("offset")).join(held, ["shard", "block"])
    return map_batches(joined, look, "shard int, block int, offset long, id long")


def token_digest(docs: DataFrame) -> DataFrame:
    """Write the files below the shared folder, read them back and return one row per document."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-files")
    write_tokens(docs, path)
    return documents_of(read_blocks(spark, path))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(read_table(spark, sf_dir, "documents"))
