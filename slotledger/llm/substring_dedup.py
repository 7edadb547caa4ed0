"""Repeated passages across documents, by prefix-partitioned sparse suffix trees.

A window is ``WINDOW`` words. Suffixes are put into trees at anchors only: of the ``SEED``-word prefixes that start inside a window, the one
with the smallest hash (the leftmost of equals). Equal windows have their anchor at the same place, so every repeat shows up
below a repeated anchor, and one position in about fourteen is an anchor.

1. Count the anchors' prefixes. One that occurs once is a leaf: nothing below it can repeat, and it goes no further.
2. Split the suffixes of repeated prefixes into groups. A prefix is a group; small ones are worked on together, up to ``GROUP_ROWS`` suffixes in
   memory. A prefix with more than ``CROWD`` suffixes gets longer prefixes: its windows are dealt one by one by
   all their words (a 128-bit hash) and a salt, and pre-aggregated by salt, so no group grows with the corpus.
3. Sort a group's suffixes, which is its tree read from left to right. Neighbours that share ``WINDOW`` words lie below an
   internal node at least that deep: a repeat. Comparison is by the words themselves.
4. Join the covered spans to their documents and drop the words.

Steps 2 to 4 are one plan, in which the shuffled texts of steps 2 and 4 are the same exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotledger.llm.common import KEY, key_columns, map_batches, read_table, stored, text_or_empty

# Fixed value of the operator.
WINDOW = 35

SEED = 8
CROWD = 16_000
GROUP_ROWS = 8_000
SALTS = 64
OUT_ROWS = 2_000
STRETCH = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


# ---- anchors ----------------------------------------------------------------------------------------------------


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE_BITS = 30  # of an anchor's sort key, enough for any text; the others hold the hash
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64; kept, and made longer when needed."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            _POWERS[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, base))])
    return _POWERS


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text starts and ends, in bytes."""
    space = np.concatenate([[True], _SPACE[np.frombuffer(data, np.uint8)], [True]])
    turns = np.flatnonzero(space[1:] != space[:-1])
    return turns[::2], turns[1::2]


def word_codes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word, from prefix sums over its bytes; long texts in stretches of whole words."""
    raw, codes, i = np.frombuffer(data, np.uint8), np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STRETCH, "right")))
        at = starts[i]
        power, inverse = _powers(int(ends[j - 1] - at))
        part = raw[at : ends[j - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * power[: len(part)])])
        codes[i:j] = (sums[ends[i:j] - at] - sums[starts[i:j] - at]) * inverse[starts[i:j] - at]
        i = j
    return codes


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours, by doubling."""
    low, k = values, 1
    while 2 * k <= width:
        low, k = np.minimum(low[:-k], low[k:]), 2 * k
    n = len(values) - width + 1
    return np.minimum(low[:n], low[width - k : width - k + n])


def anchors(codes: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every run of windows with one anchor: the first window's start, how many windows, and the hash of the anchor's prefix.

    A hash collision makes an anchor look repeated that is not, which costs a comparison of words and changes no result.
    """
    if len(codes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes, k = codes, 1
    while k < seed:  # a power of two
        hashes = hashes[:-k] * _POWERS[0][k] + hashes[k:]
        k *= 2
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(29)
    place = np.uint64(_PLACE_BITS)
    keys = (hashes >> place << place) | np.arange(len(hashes), dtype=np.uint64)
    at = (_smallest(keys, window - seed + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return first, np.diff(np.append(first, len(at))), hashes[at[first]]


def keyed(docs: DataFrame) -> DataFrame:
    """The rows' key, doc_id and text."""
    return docs.select(*key_columns(), "doc_id", text_or_empty(F.col("text")).alias("text"))


def anchor_rows(docs: DataFrame) -> DataFrame:
    """seed, key and first window of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                data = text.encode()
                found.append(anchors(word_codes(data, *word_places(data))))
            sizes = [len(f[0]) for f in found]
            repeated = [np.repeat(batch.column(c).to_numpy(), sizes) for c in KEY]
            first = np.concatenate([f[0] for f in found]).astype(np.int32)
            seeds = np.concatenate([f[2] for f in found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (seeds, *repeated, first)], ["seed", *KEY, "first"])

    return map_batches(docs.select(*KEY, "text"), run, "seed long, k long, h long, first int")


# ---- suffixes and their groups ----------------------------------------------------------------------------------


def suffix_rows(texts: DataFrame) -> DataFrame:
    """The wanted anchors' suffixes with their words: group, salt, key, first window, number of windows, words.

    ``firsts`` and ``crowded`` name a document's wanted anchors. A crowded one comes out window by window, as hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SUFFIX_TYPES)], SUFFIX_NAMES)

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in (*KEY, "text", "firsts", "crowded")))
            for k, h, text, firsts, crowded in rows:
                data = b" ".join(text.encode().split())
                starts, ends = word_places(data)
                found = anchors(word_codes(data, starts, ends))
                starts, ends = starts.tolist(), ends.tolist()
                wanted, crowds = set(firsts), set(crowded)
                for first, n, seed in zip(*(a.tolist() for a in found)):
                    if first in wanted:
                        group = seed - (1 << 64) if seed >> 63 else seed
                        out.append((group, 0, k, h, first, n, data[starts[first] : ends[first + n + WINDOW - 2]]))
                    elif first in crowds:
                        for p in range(first, first + n):
                            digest = xxhash.xxh3_128_digest(data[starts[p] : ends[p + WINDOW - 1]])
                            out.append((int.from_bytes(digest[:8], "big", signed=True), 1 + (h ^ p) % SALTS, k, h, p, 1, digest))
                    if len(out) >= OUT_ROWS:
                        yield flush()
        yield flush()

    return map_batches(texts, run, "g long, salt int, k long, h long, first int, n int, words binary")


SUFFIX_NAMES = ["g", "salt", *KEY, "first", "n", "words"]
SUFFIX_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def deep_spans(rows: list[tuple], depth: int = WINDOW) -> list[tuple]:
    """(k, h, start, stop, None) of what lies below internal nodes of at least ``depth`` words in the tree of the rows' suffixes.

    Rows are (group, k, h, first, n, words): n suffixes that start at the first n words. Sorted suffixes are the leaves in order; the
    node above two neighbours is deep where their first ``depth`` words agree. Rows alike in all words are one path of the tree with
    several leaves at its end, deep from its first suffix to its last; and a group of one path has no other node.
    """
    groups: dict[int, dict[bytes, list[int]]] = {}
    for r, row in enumerate(rows):
        groups.setdefault(row[0], {}).setdefault(row[5], []).append(r)
    spans, leaves, alone = [], [], {}
    for paths in groups.values():
        for text, members in paths.items():
            if len(members) > 1:
                for r in members:
                    _, k, h, first, n, _ = rows[r]
                    spans.append((k, h, first, first + n + depth - 1, None))
            else:
                alone[members[0]] = set()
            # A path may also repeat itself further along.
            n = rows[members[0]][4]
            if len(paths) > 1 or n > 1 and len(members) == 1:
                words, at = text.split(b" "), 0
                end = len(b" ".join(words[:depth]))
                for i in range(n):
                    leaves.append((text[at:end], members[0], i))
                    if i + 1 < n:
                        at, end = at + len(words[i]) + 1, end + len(words[i + depth]) + 1
    leaves.sort()
    for (a, ra, ia), (b, rb, ib) in zip(leaves, leaves[1:]):
        if a == b:
            for r, i in ((ra, ia), (rb, ib)):
                if r in alone:
                    alone[r].add(i)
    for r, places in alone.items():
        _, k, h, first, _, _ = rows[r]
        start = stop = None
        for p in sorted(places):
            if start is None or first + p > stop:
                if start is not None:
                    spans.append((k, h, start, stop, None))
                start = first + p
            stop = first + p + depth
        if start is not None:
            spans.append((k, h, start, stop, None))
    return spans


def repeated_spans(suffixes: DataFrame) -> DataFrame:
    """key, start, stop of repeated words, group by group; rows with ``rep`` wait for their fellows under other salts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group, salt, seen = None, None, {}

        def table(spans: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*spans)) if spans else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SPAN_TYPES)], SPAN_NAMES)

        def crowd_over() -> list[tuple]:
            """One row for each window of the crowd that just ended; without a key if its rows are out already."""
            out = [(*(row or (None, None, None)), row and row[2] + WINDOW, digest) for digest, row in seen.items()]
            seen.clear()
            return out

        for batch in batches:
            spans: list[tuple] = []
            for g, s, k, h, first, n, words in zip(*(batch.column(c).to_pylist() for c in SUFFIX_NAMES)):
                if (g, s) != (group, salt):
                    spans += crowd_over()
                    if len(held) >= GROUP_ROWS:
                        spans += deep_spans(held)
                        held.clear()
                    group, salt = g, s
                if s == 0:
                    held.append((g, k, h, first, n, words))
                elif words not in seen:
                    seen[words] = (k, h, first)
                else:
                    if before := seen[words]:
                        spans.append((*before, before[2] + WINDOW, None))
                        seen[words] = None
                    spans.append((k, h, first, first + WINDOW, None))
            yield table(spans)
        yield table(crowd_over() + deep_spans(held))

    ordered = suffixes.repartition("g", "salt").sortWithinPartitions("g", "salt")
    return map_batches(ordered, run, "k long, h long, start int, stop int, rep binary")


SPAN_NAMES = [*KEY, "start", "stop", "rep"]
SPAN_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def settled(spans: DataFrame) -> DataFrame:
    """Spans for certain. A waiting window is repeated if another salt has it as well: at most ``SALTS`` rows meet."""
    place = F.when(F.col("rep").isNull(), F.col("h")).otherwise(F.xxhash64("rep"))  # the others stay with their document
    met = spans.withColumn("met", F.count("*").over(Window.partitionBy(place, "rep")))
    return met.where("k is not null and (rep is null or met > 1)").select(*KEY, "start", "stop")


# ---- the operator -----------------------------------------------------------------------------------------------


def covered_spans(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """key and its list of (start, stop) word spans to remove; ``docs`` as ``keyed`` gives them."""
    # Written, so that the join's two sides are plain shuffles, of which adaptive execution can split a hot prefix.
    counts = stored(anchor_rows(docs).groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "repeated-prefixes")
    wanted = anchor_rows(docs).join(counts, "seed")
    listed = wanted.groupBy(*KEY).agg(
        F.collect_list(F.when(F.col("n") <= crowd, F.col("first"))).alias("firsts"),
        F.collect_list(F.when(F.col("n") > crowd, F.col("first"))).alias("crowded"),
    )
    texts = docs.join(listed, KEY).select(*KEY, "doc_id", "text", "firsts", "crowded")
    spans = settled(repeated_spans(suffix_rows(texts)))
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) for every row.

    Null texts have no words. Null and repeated ids stay, one row each; equal texts in two rows repeat each other, whatever their ids.
    Texts shorter than a window lose nothing. An empty table gives none.
    """
    rows = keyed(docs)
    joined = rows.join(covered_spans(rows, crowd), KEY, "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = text.encode().split()
                steps = np.zeros(len(words) + 1, np.int64)
                for span in spans or ():
                    steps[span["start"]] += 1
                    steps[span["stop"]] -= 1
                gone = np.cumsum(steps[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if spans else words
                out.append((len(words), int(gone.sum()), b" ".join(kept).decode()))
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string())))],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(joined, run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35),
v AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS w FROM p),
b AS (SELECT r, i FROM v QUALIFY count(*) OVER (PARTITION BY w) > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM b),
x AS (SELECT r, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS w FROM d),
k AS (SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY j) AS kept FROM x ANTI JOIN c USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
