"""SimHash fingerprints of whole texts, and the search for those within a Hamming radius. DataFrame functions only.

A term is a pair of neighbouring words, weighted by how often the text has it: each occurrence of its hash votes on every bit, for a
one or against. 128 bits come from two 64-bit hashes. Votes are integer sums, two bits to a 64-bit counter (32 bits each), so
64 sums in one hash aggregate count them all, beside the rows and without a shuffle of terms.

Search: fingerprints are cut into blocks, and each table has the bits of one block first. ``radius`` differing bits leave some block with
at most ``radius // blocks`` of them, so any fingerprint within the radius meets a query in the table of that block, if the query asks for
every value of the block with so many bits turned. What meets is confirmed by counting bits.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotledger.llm.common import read_table, stored, text_or_empty

BUCKET_ROWS = 2_000
MOST_BUCKETS = 1 << 16
QUERY_EVERY = 20
#: Near copies (0.8 or more of their five-word shingles in common) are 5 to 20 bits apart.
NEAR_RADIUS = 20
NEAR_BLOCKS = 7

# ASCII white space separates words.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARACTERS = " \t\n\x0b\x0c\r"

LANES = 0x0000000100000001
LOW_LANE = 0xFFFFFFFF


# ---- fingerprints -----------------------------------------------------------------------------------------------


def term_hashes(text: Column) -> Column:
    """Hashes of neighbouring words, repeats included; of the word where there is one only; none without words."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARACTERS))
    words = F.split(trimmed, SPACES)
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    pairs = F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(1)))  # the last word has no partner, unless it is alone
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(pairs)


def vote_sums(term: Column) -> list[Column]:
    """64 sums: bits i and i + 32 of the term's hash in one counter, then the same of the hash's hash."""
    return [
        F.coalesce(F.sum(F.shiftright(h, i).bitwiseAND(F.lit(LANES))), F.lit(0)).alias(f"s{k * 32 + i}")
        for k, h in enumerate((term, F.xxhash64(term)))
        for i in range(32)
    ]


def voted(k: int, n: Column) -> Column:
    """Word ``k`` of the fingerprint: bit set where over half of ``n`` terms have it set. Zero without terms: a null's hash is no vote."""
    bits = []
    for i in range(32):
        s = F.col(f"s{k * 32 + i}")
        for count, at in ((s.bitwiseAND(F.lit(LOW_LANE)), i), (F.shiftrightunsigned(s, 32), i + 32)):
            bits.append(F.when(2 * count > n, F.lit(1 << at if at < 63 else -(1 << 63))).otherwise(F.lit(0)))
    return F.when(n > 0, reduce(lambda a, b: a.bitwiseOR(b), bits)).otherwise(F.lit(0))


def hex_of(*words: str) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(w)), 16, "0") for w in words])


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Share of equal bits."""
    return 1 - sum(F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b)) / 128.0


# ---- the next document ------------------------------------------------------------------------------------------


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at or below a key: binary search in an array. Null is below all."""
    if not bounds:
        return F.lit(0)
    array, n = F.array(*map(F.lit, bounds)), len(bounds)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    here = lambda at: F.get(array, at - 1)
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (here(at + s) <= key), at + s).otherwise(at))
    return F.when(key.isNull(), 0).otherwise(found)


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """b, r (a row's bucket and place), guest, doc_id, text and the next document's text, in ascending doc_id.

    Null ids come first and rows with one id are ordered by text hash; after the last row comes the first. Buckets are cut at
    quantiles of the ids. The first rows of a bucket are also guests at the end of the one before, so nothing has to look
    beyond its own bucket, and texts are shuffled once.
    """
    ids = docs.select("doc_id")
    shape = ids.agg(F.count("*").alias("rows"), F.min("doc_id").alias("least"), F.count("doc_id").alias("known")).first()
    n = min(MOST_BUCKETS, -(-shape["rows"] // bucket_rows)) if shape["known"] else 1
    bounds: list[int] = []
    if n > 1:
        cuts = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 20 * n)).alias("c")).first()["c"]
        bounds = sorted({c for c in cuts if c > shape["least"]})
    first = F.col("doc_id").isNull() if shape["known"] < shape["rows"] else F.col("doc_id") == F.lit(shape["least"])
    rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"), bucket_of(F.col("doc_id"), bounds).alias("own"))
    none = F.lit(None).cast("int")
    opens = F.when(F.get(F.array(*map(F.lit, bounds)), F.col("own") - 1) == F.col("doc_id"), F.col("own") - 1) if bounds else none
    places = F.array(
        F.struct(F.col("own").alias("b"), F.lit(0).alias("guest")),
        F.struct(opens.alias("b"), F.lit(1).alias("guest")),
        F.struct(F.when(first, len(bounds)).alias("b"), F.lit(1).alias("guest")),
    )
    placed = rows.select("doc_id", "text", F.inline(places)).where("b is not null")
    order = Window.partitionBy("b").orderBy("guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return placed.select("b", F.row_number().over(order).alias("r"), "guest", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def fingerprint_rows(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, and words a, b of each row's fingerprint, ea, eb of its edited text's, na, nb of the next's."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs, bucket_rows).withColumn("edited", edited)
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    quarters = [F.conv(F.substring(sha, 16 * k + 1, 16), 16, -10).cast("long").alias(f"q{k}") for k in range(4)]
    texts = F.when(F.col("guest") == 1, F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")))).otherwise(
        F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    )
    carried = ["guest", "doc_id", "n_chars", "q0", "q1", "q2", "q3"]
    wide = rows.select("b", "r", "guest", "doc_id", F.length("text").cast("long").alias("n_chars"), *quarters, F.inline(texts))
    terms = wide.select("b", "r", "kind", *carried, F.explode_outer(term_hashes(F.col("t"))).alias("term"))
    sums = terms.groupBy("b", "r", "kind").agg(F.count("term").alias("n"), *vote_sums(F.col("term")), *[F.max(c).alias(c) for c in carried])
    prints = sums.select("b", "r", "kind", *carried, voted(0, F.col("n")).alias("x"), voted(1, F.col("n")).alias("y"))
    of_kind = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    pairs = prints.groupBy("b", "r").agg(
        *[F.max(c).alias(c) for c in carried],
        *[of_kind(c, kind).alias(name) for name, c, kind in (("a", "x", 0), ("b_", "y", 0), ("ea", "x", 1), ("eb", "y", 1))],
    )
    order = Window.partitionBy("b").orderBy("r")
    led = pairs.select("*", F.lead("a").over(order).alias("na"), F.lead("b_").over(order).alias("nb")).where("guest = 0")
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"q{k}"), 16, "0") for k in range(4)]))
    return led.select("doc_id", "n_chars", sha.alias("edited_sha256"), "a", F.col("b_").alias("b"), "ea", "eb", "na", "nb")


# ---- search -----------------------------------------------------------------------------------------------------


def block_spans(blocks: int) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """The mask of each block of 128 bits, and its single bits, as pairs of signed words (a, b)."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    split = lambda x: (signed(x & (1 << 64) - 1), signed(x >> 64))
    edges = [128 * k // blocks for k in range(blocks + 1)]
    return [(split((1 << hi) - (1 << lo)), [split(1 << i) for i in range(lo, hi)]) for lo, hi in zip(edges, edges[1:])]


def turned(bits: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Every choice of at most ``most`` of the bits."""
    chosen = [c for n in range(most + 1) for c in combinations(bits, n)]
    return [(sum(x for x, _ in c), sum(y for _, y in c)) for c in chosen]


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(a, b, found_a, found_b, found_rows): for every query fingerprint each distinct index fingerprint within the radius, once.

    Equal fingerprints are one row with a count on either side. A pair that agrees in several tables is kept in the first.
    """
    spans, most = block_spans(blocks), radius // blocks
    key = lambda x, y, ma, mb: (x.bitwiseAND(F.lit(ma)), y.bitwiseAND(F.lit(mb)))
    tables = []
    for t, ((ma, mb), _) in enumerate(spans):
        ka, kb = key(F.col("a"), F.col("b"), ma, mb)
        tables.append(F.struct(F.lit(t).alias("t"), ka.alias("ka"), kb.alias("kb")))
    held = index.groupBy("a", "b").agg(F.count("*").alias("rows")).select("a", "b", "rows", F.inline(F.array(*tables)))
    held = held.select("t", "ka", "kb", F.col("a").alias("found_a"), F.col("b").alias("found_b"), F.col("rows").alias("found_rows"))
    turns = [(t, da, db) for t, (_, bits) in enumerate(spans) for da, db in turned(bits, most)]
    turns = queries.sparkSession.createDataFrame(turns, "t int, da long, db long")
    asked = queries.select("a", "b").distinct().select("a", "b", F.inline(F.array(*tables)))
    asked = asked.join(F.broadcast(turns), "t").select("a", "b", "t", F.col("ka").bitwiseXOR(F.col("da")).alias("ka"), F.col("kb").bitwiseXOR(F.col("db")).alias("kb"))
    xa, xb = F.col("a").bitwiseXOR(F.col("found_a")), F.col("b").bitwiseXOR(F.col("found_b"))
    apart = [sum(F.bit_count(x) for x in key(xa, xb, ma, mb)) for (ma, mb), _ in spans]
    first = reduce(lambda rest, k: F.when(apart[k] <= most, k).otherwise(rest), reversed(range(blocks)), F.lit(-1))
    met = asked.join(held, ["t", "ka", "kb"]).where((F.bit_count(xa) + F.bit_count(xb) <= radius) & (F.col("t") == first))
    return met.select("a", "b", "found_a", "found_b", "found_rows")


def document_fingerprints(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document with its fingerprint, its edited text's and the next document's, and their likenesses.

    Null and empty texts have fingerprint zero. Repeated rows and null ids stay. A single document is its own next; an empty table
    gives none. ``n_near`` counts the other rows within ``NEAR_RADIUS`` bits for ids divisible by 20, and is null for the rest.
    """
    rows = stored(fingerprint_rows(docs, bucket_rows), "fingerprints")
    asked = F.col("doc_id") % QUERY_EVERY == 0
    near = within_radius(rows.where(asked), rows, NEAR_RADIUS, NEAR_BLOCKS).groupBy("a", "b").agg((F.sum("found_rows") - 1).alias("n_near"))
    found = rows.where(asked).join(near, ["a", "b"], "left")
    rest = rows.where(~F.coalesce(asked, F.lit(False))).withColumn("n_near", F.lit(None).cast("long"))
    return found.select(*rest.columns).union(rest).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex_of("a", "b").alias("fingerprint"),
        hex_of("ea", "eb").alias("edited_fingerprint"),
        likeness(("a", "b"), ("ea", "eb")).alias("near_edited"),
        likeness(("a", "b"), ("na", "nb")).alias("near_next"),
        "n_near",
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(read_table(spark, sf_dir, "documents"))
