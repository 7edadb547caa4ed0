"""Token counts: lengths of frequent pre-tokens from a broadcast table, the others from a cache in each worker. No shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.llm.common import map_batches, read_table, text_or_empty
from slotledger.llm.tokens import TOKENIZER_PATH, Remembered, byte_letters, chunks, encode_all, encode_whole, load


def frequent_lengths(path: str) -> dict[str, int]:
    """Lengths of the space-led pre-tokens that the vocabulary holds as one piece: those its training text had most often.

    At most as many as the vocabulary has entries, whatever the corpus.
    """
    letters = byte_letters()
    found = []
    for piece in load(path).get_vocab():
        try:
            text = bytes(letters[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text[:1] == " " and chunks(text) == ["", text[1:]]:
            found.append(text)
    return {text[1:]: len(ids) for text, ids in zip(found, encode_all(path, found))}


@lru_cache(maxsize=4)
def _worker_lengths(path: str, table) -> Remembered:
    """This worker's cache over the broadcast table; the broadcast's id tells tables apart."""
    return Remembered(path, len, table.value)


def count_text(path: str, lengths: Remembered, text: str) -> int:
    head, *rest = chunks(text)
    return len(encode_whole(path, head)) + sum(lengths.values_of(rest))


def token_counts(docs: DataFrame, limit: int = 512, path: str = TOKENIZER_PATH) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Null and empty texts count 0. Null and repeated ids stay, one row each. Other columns are ignored; an empty table
    gives none. Special strings in a text count as the tokenizer library counts them by default.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _worker_lengths(path, table)
        for batch in batches:
            n = [count_text(path, lengths, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = text_or_empty(F.col("text"))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = map_batches(rows, count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
