"""Benchmark passages in training documents, by a positional inverted index. DataFrame functions only.

A test window is ten consecutive words of an item, or a shorter item whole. Three passes over the documents:

1. count the test vocabulary in the documents, so that the two rarest terms of every window are known;
2. store the postings (term, document, position) of those terms, shift each by its offset in the item, and intersect: where
   both lists of a window give one diagonal (position - offset), its document is a candidate;
3. in candidate documents only, intersect the postings of all the item's terms with the diagonal. Runs of matching offsets as long
   as a window are exact matches.

No two documents are compared, and no list is held: every step is an equi-join or an aggregate, and what is one group (a document,
an item and a diagonal) has no more rows than the item has words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotledger.llm.common import KEY, key_columns, read_table, stored, text_or_empty

# Words are runs of ASCII digits and lower-case letters and of everything beyond ASCII, after A-Z are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same before lower-casing
WINDOW_WORDS = 10

#: Test tables of up to this many words are broadcast; larger ones are joined by shuffle.
MOST_BROADCAST_WORDS = 2_000_000


def lower_ascii(word: Column) -> Column:
    """A-Z only. ``lower`` is the same, and quicker, where a word has one byte per code point."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(RUNS), F.lit(0))


def item_words(items: DataFrame) -> DataFrame:
    """e (an item text), item_id and its words; texts without words are left out. Written once: it is read by every step."""
    words = F.transform(raw_words(F.col("text")), lower_ascii)
    rows = items.select(F.xxhash64("item_id", "text").alias("e"), F.col("item_id").cast("string").alias("item_id"), words.alias("words"))
    return stored(rows.where(F.size("words") > 0).distinct(), "test-items")


def document_terms(docs: DataFrame) -> DataFrame:
    """One row per word: key, p (place) and term."""
    return docs.select(*KEY, F.posexplode(raw_words(F.col("text"))).alias("p", "raw")).select(*KEY, "p", lower_ascii(F.col("raw")).alias("term"))


class TestIndex:
    """The test windows' rarest terms, and the stored postings of those terms in the documents."""

    __test__ = False

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS):
        self.docs, self.items, self.window = docs.select("doc_id", "text", *key_columns()), item_words(items), window
        self.total = self.items.agg(F.sum(F.size("words"))).first()[0] or 0
        self.places = self.items.select("e", F.posexplode("words").alias("q", "term"))
        vocabulary = self.near(self.places.select("term").distinct())
        counts = document_terms(self.docs).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("c"))
        self.counts = stored(counts, "test-terms")
        width = F.least(F.lit(window), F.size("words"))
        starts = self.items.select("e", width.alias("w"), F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("o"))
        inside = starts.select("e", "o", F.explode(F.sequence(F.col("o"), F.col("o") + F.col("w") - 1)).alias("q"))
        rare = Window.partitionBy("e", "o").orderBy("c", "q")
        ranked = (
            inside.join(self.places, ["e", "q"])
            .join(self.near(self.counts), "term", "left")
            .fillna(0, ["c"])
            .withColumn("r", F.row_number().over(rare))
            .where("r <= 2")
        )
        pairs = ranked.groupBy("e", "o").agg(
            F.min("c").alias("c"), F.min_by("q", "r").alias("q1"), F.max_by("q", "r").alias("q2")
        )
        #: Windows that can occur at all: every term is somewhere in the documents.
        self.pairs = stored(pairs.where("c > 0").select("e", "q1", "q2").distinct(), "test-pairs")
        chosen = self.pairs.select("e", F.explode(F.array("q1", "q2")).alias("q")).distinct()
        self.anchors = stored(chosen.join(self.places, ["e", "q"]), "test-anchors")
        terms = self.near(self.anchors.select("term").distinct())
        self.postings = stored(document_terms(self.docs).join(terms, "term", "left_semi").select("term", *KEY, "p"), "postings")

    def near(self, table: DataFrame) -> DataFrame:
        """Broadcast what is as small as the test items, if those are small."""
        return F.broadcast(table) if self.total <= MOST_BROADCAST_WORDS else table

    def candidates(self) -> DataFrame:
        """key, e and diagonal where both rarest terms of some window stand at its offsets."""
        shifted = self.postings.join(self.near(self.anchors), "term").select(*KEY, "e", (F.col("p") - F.col("q")).alias("d"), "q")
        met = shifted.groupBy(*KEY, "e", "d").agg(F.collect_set("q").alias("qs"))
        wanted = self.pairs.groupBy("e").agg(F.collect_list(F.struct("q1", "q2")).alias("pairs"))
        both = F.exists("pairs", lambda x: F.array_contains("qs", x["q1"]) & F.array_contains("qs", x["q2"]))
        return met.join(self.near(wanted), "e").where(both).select(*KEY, "e", "d")

    def phrases(self) -> DataFrame:
        """key, e, item_id, first and last place of every stretch of words that windows of the item cover exactly."""
        found = stored(self.candidates(), "candidates")
        expected = found.join(self.near(self.items), "e").select(*KEY, "e", "d", F.posexplode("words").alias("q", "term"))
        expected = expected.withColumn("p", F.col("d") + F.col("q")).where("p >= 0")
        own = self.docs.join(found.select(*KEY).distinct(), KEY, "left_semi")
        own = document_terms(own).join(self.near(self.places.select("term").distinct()), "term", "left_semi")
        matched = expected.join(own, [*KEY, "p", "term"]).select(*KEY, "e", "d", "q").distinct()
        diagonal = Window.partitionBy(*KEY, "e", "d").orderBy("q")
        runs = matched.withColumn("run", F.col("q") - F.row_number().over(diagonal)).groupBy(*KEY, "e", "d", "run")
        runs = runs.agg(F.min("q").alias("first"), F.max("q").alias("last"))
        width = self.items.select("e", "item_id", F.least(F.lit(self.window), F.size("words")).alias("w"))
        long = runs.join(self.near(width), "e").where(F.col("last") - F.col("first") + 1 >= F.col("w"))
        return long.select(*KEY, "e", "item_id", (F.col("d") + F.col("first")).alias("first"), (F.col("d") + F.col("last")).alias("last"))

    def proximity(self, slop: int) -> DataFrame:
        """doc_id and item_id where the two rarest terms of a window stand up to ``slop`` words off their distance in the item.

        Positions are cut into strips as wide as the slop, so that partners are met by equality in three strips and no
        list is joined with another as a whole.
        """
        sides = []
        for q in ("q1", "q2"):
            picked = self.pairs.withColumn("q", F.col(q)).join(self.anchors, ["e", "q"]).select("term", "e", "q1", "q2", "q")
            side = self.postings.join(self.near(picked.distinct()), "term")
            sides.append(side.select(*KEY, "e", "q1", "q2", (F.col("p") - F.col("q")).alias("d")))
        width = slop + 1
        left = sides[0].withColumn("strip", F.explode(F.array(*[F.floor(F.col("d") / width) + s for s in (-1, 0, 1)])))
        right = sides[1].withColumn("strip", F.floor(F.col("d") / width)).withColumnRenamed("d", "d2")
        close = left.join(right, [*KEY, "e", "q1", "q2", "strip"]).where(F.abs(F.col("d") - F.col("d2")) <= slop)
        named = close.select(*KEY, "e").distinct().join(self.items.select("e", "item_id"), "e")
        return self.docs.select("doc_id", *KEY).join(named, KEY).select("doc_id", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the row's key for every row of ``docs``.

    Null texts have no words. Null and repeated ids stay, one row each, judged by their own text. An item without an id counts as one
    with an empty id. Items repeated under one id count once. Empty tables give no rows, or documents without hits.
    """
    index = TestIndex(docs, items, window)
    spans = stored(index.phrases(), "phrases")
    hit = spans.select(*KEY, F.explode(F.sequence("first", "last")).alias("p")).distinct().groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    ids = F.sort_array(F.collect_set(F.coalesce("item_id", F.lit(""))))
    held = spans.groupBy(*KEY).agg(ids.alias("ids")).select(*KEY, F.size("ids").alias("n_items"), F.array_join("ids", ",").alias("ids"))
    found = hit.join(held, KEY)
    rows = index.docs.select("doc_id", *KEY, F.regexp_count(text_or_empty(F.col("text")), F.lit(RUNS)).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(found, KEY, "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        *KEY,
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop(*KEY)


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
starts AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS o FROM i WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[o:o + n - 1], ' ') AS t FROM starts),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n),
m AS (SELECT DISTINCT doc_id, item_id, s, n FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM spots) JOIN wins USING (n, t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
