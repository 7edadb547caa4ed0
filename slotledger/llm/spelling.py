"""Groups of spelling variants: vocabulary words one edit apart, found by finite-state composition.

Acceptor of the words, one-edit transducer, acceptor again: the composition accepts (u, v) if both are words and differ by exactly one
inserted, deleted or replaced code point. It is enumerated in partitions, each an acceptor of its own: by the state that the acceptor is in
after what the pair shares. A pair whose longer word has m code points differs at some leftmost place; if that is at or beyond
h = (m - 1) // 2, the two share their first h code points, else their last m - h. So every word enters four cells, as the
longer and as the shorter one, by its first and by its last half, and each pair is accepted in exactly one of them.

A cell of more than ``MOST_WORDS`` words is taken apart exactly: pairs that differ at the next place share everything else and meet in
a cell of at most one word for each letter; all others also share the next code point. This goes on until no cell is larger.

In a cell, the sorted words become a minimised acceptor (equal right languages are one state). From a state without an edit, both copies
are in the same state, so the composition's states are pairs only after the edit, where it follows what both states accept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.llm.common import map_batches, read_table, stored

# Fixed values of the operator.
LEAST_LENGTH = 7
LEAST_COUNT = 2
DROPPED_EVERY = 31
FORM_RATIO = 10
_RUNS = re.compile(rf"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")  # shorter runs give no word

MOST_WORDS = 5_000
FLUSH_WORDS = 300_000


# ---- the vocabulary ---------------------------------------------------------------------------------------------


def text_words(doc_id, text: str) -> Counter:
    """How often a text has each word; of the runs that the checksum picks, one code point is left out."""
    start, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in Counter(_RUNS.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % DROPPED_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word and n of all documents, for words that occur at least ``least`` times."""

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = text_words(doc_id, text.as_py())
                for word, n in found.items():
                    counts[word] += n
                if len(counts) >= FLUSH_WORDS:
                    yield table(counts)
                    counts.clear()
        yield table(counts)

    rows = map_batches(docs.where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text"), run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---- cells ------------------------------------------------------------------------------------------------------


def _cell(m: Column, low: Column, high: Column, prefix: Column, suffix: Column) -> Column:
    """A word's place in a cell: pairs with a longer word of m code points whose leftmost difference is in [low, high).

    ``prefix`` and ``suffix`` say how many code points at either end the cell's words share.
    """
    word = F.col("word")
    shared = F.xxhash64(m, low, high, F.substring(word, F.lit(1), prefix), F.right(word, suffix))
    values = {"m": m, "low": low, "high": high, "prefix": prefix, "suffix": suffix}
    return F.struct(shared.alias("c"), *(v.cast("int").alias(k) for k, v in values.items()))


CELL = ["c", "m", "low", "high", "prefix", "suffix"]


def first_cells(words: DataFrame) -> DataFrame:
    """The four cells of every word."""
    cells = []
    for longer in (F.length("word"), F.length("word") + 1):
        half = F.floor((longer - 1) / 2).cast("int")
        cells.append(_cell(longer, half, longer, half, F.lit(0)))
        cells.append(_cell(longer, F.lit(0), half, F.lit(0), longer - half))
    return words.select("word", "n", F.inline(F.array(*cells)))


def finer_cells(cells: DataFrame) -> DataFrame:
    """The same pairs in cells that share one more code point; those that differ just there, in cells that share all the rest."""
    m, low, high, at_start = F.col("m"), F.col("low"), F.col("high"), F.col("suffix") == 0
    here = F.when(at_start, low).otherwise(high - 1)
    only_here = _cell(m, here, here + 1, here, m - 1 - here)
    ahead = _cell(m, low + 1, high, low + 1, F.lit(0))
    behind = _cell(m, low, high - 1, F.lit(0), m - high + 1)
    finer = F.array(only_here, F.when(at_start, ahead).otherwise(behind))
    return cells.select("word", "n", F.inline(finer)).where("low < high")


def bounded_cells(words: DataFrame, most: int = MOST_WORDS) -> list[DataFrame]:
    """Cells of at most ``most`` words, in one table for each time that large ones were taken apart."""
    out, cells = [], first_cells(words)
    while True:
        wide = F.col("prefix") + F.col("suffix") < F.col("m") - 1  # the others have at most one word for each letter
        large = cells.where(wide).groupBy("c").agg(F.count("*").alias("rows")).where(F.col("rows") > most)
        large = stored(large.select("c"), "large-cells")
        if large.isEmpty():
            return [*out, cells]
        out.append(cells.where(~wide).unionByName(cells.where(wide).join(large, "c", "left_anti")))
        cells = stored(finer_cells(cells.where(wide).join(large, "c", "left_semi")), "finer-cells")


# ---- acceptors and their composition ----------------------------------------------------------------------------


class Acceptor:
    """The minimised acceptor of sorted distinct words: for each state its arcs, whether it ends a word, and its words' lengths."""

    def __init__(self, words: list[str]):
        self.arcs: list[tuple] = []
        self.final: list[bool] = []
        self.lengths: list[int] = []  # a bit for each length
        self._states: dict[tuple, int] = {}
        self._tails: dict[str, int] = {}
        self._languages: dict[int, list[str]] = {}
        self._shared: dict[tuple[int, int], list[str]] = {}
        self.start = self._build(words, 0, len(words), 0)

    def _state(self, final: bool, arcs: tuple) -> int:
        found = self._states.get((final, arcs))
        if found is None:
            found = self._states[final, arcs] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            lengths = int(final)
            for _, target in arcs:
                lengths |= self.lengths[target] << 1
            self.lengths.append(lengths)
        return found

    def _tail(self, text: str) -> int:
        """The state from which exactly ``text`` is accepted."""
        found = self._tails.get(text)
        if found is None:
            found = self._state(True, ()) if not text else self._state(False, ((text[0], self._tail(text[1:])),))
            self._tails[text] = found
        return found

    def _build(self, words: list[str], i: int, stop: int, depth: int) -> int:
        if stop - i == 1:
            return self._tail(words[i][depth:])
        final, arcs = len(words[i]) == depth, []
        i += final
        while i < stop:
            letter, j = words[i][depth], i + 1
            while j < stop and words[j][depth] == letter:
                j += 1
            arcs.append((letter, self._build(words, i, j, depth + 1)))
            i = j
        return self._state(final, tuple(arcs))

    def language(self, q: int) -> list[str]:
        found = self._languages.get(q)
        if found is None:
            found = [""] if self.final[q] else []
            found += [letter + rest for letter, target in self.arcs[q] for rest in self.language(target)]
            self._languages[q] = found
        return found

    def shared(self, p: int, q: int) -> list[str]:
        """What both states accept: the composition after its edit."""
        if p == q:
            return self.language(p)
        if not self.lengths[p] & self.lengths[q]:
            return []
        if p > q:
            p, q = q, p
        found = self._shared.get((p, q))
        if found is None:
            found = [""] if self.final[p] and self.final[q] else []
            other = dict(self.arcs[q])
            for letter, target in self.arcs[p]:
                if letter in other:
                    found += [letter + rest for rest in self.shared(target, other[letter])]
            self._shared[p, q] = found
        return found

    def one_edit_pairs(self) -> Iterator[tuple[str, str]]:
        """Every pair of accepted words with one edit between them, once, the longer first."""
        stack = [("", self.start)]
        while stack:
            before, q = stack.pop()
            arcs = self.arcs[q]
            for k, (a, p) in enumerate(arcs):
                stack.append((before + a, p))
                for b, r in arcs[k + 1 :]:
                    for rest in self.shared(p, r):
                        yield before + a + rest, before + b + rest
                # The longer word has one more letter here, and the shorter goes on in this state; at the leftmost place it could be.
                for rest in self.shared(p, q):
                    if not rest.startswith(a):
                        yield before + a + rest, before + rest


def cell_pairs(words: list[str], m: int, low: int, high: int, prefix: int, suffix: int) -> Iterator[tuple[str, str]]:
    """The near pairs of a cell, the longer word first; ``words`` are distinct and share the ends."""
    head, tail = words[0][:prefix], words[0][len(words[0]) - suffix :]
    middles = sorted(w[prefix : len(w) - suffix] for w in words)
    for a, b in Acceptor(middles).one_edit_pairs():
        u, v = head + a + tail, head + b + tail
        if len(u) != m:
            continue
        if suffix:  # what follows may move the leftmost difference to the right
            at = next((i for i in range(len(v)) if u[i] != v[i]), len(v))
            if not low <= at < high:
                continue
        yield u, v


def near_words(cells: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: how many near words a word has in a cell, and the one of largest n."""

    def settled(rows: list[tuple]) -> list[tuple]:
        groups: dict[tuple, dict[str, int]] = {}
        for m, low, high, prefix, suffix, word, n in rows:  # a hash may stand for several cells
            key = (m, low, high, prefix, suffix, word[:prefix], word[len(word) - suffix :])
            groups.setdefault(key, {})[word] = n
        out = []
        for (m, low, high, prefix, suffix, _, _), counts in groups.items():
            if len(counts) == 1:
                continue
            found: dict[str, list] = {}
            for u, v in cell_pairs(list(counts), m, low, high, prefix, suffix):
                for word, other in ((u, v), (v, u)):
                    rank = (-counts[other], other)
                    if word in found:
                        entry = found[word]
                        entry[0] += 1
                        entry[1] = min(entry[1], rank)
                    else:
                        found[word] = [1, rank]
            out += [(word, k, -rank[0], rank[1]) for word, (k, rank) in found.items()]
        return out

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], ["word", "n_near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in (*CELL, "word", "n")]
            for c, *row in zip(*columns):
                if c != last:
                    if len(held) > 1:
                        out += settled(held)
                    last, held = c, []
                held.append(tuple(row))
            yield table(out)
        yield table(settled(held) if len(held) > 1 else [])

    ordered = cells.select(*CELL, "word", "n").repartition("c").sortWithinPartitions("c")
    return map_batches(ordered, run, "word string, n_near long, best_n long, best string")


# ---- forms and roots --------------------------------------------------------------------------------------------


def roots_of(forms: DataFrame) -> DataFrame:
    """word and the last form of each, from (word, form). A form is ten times as frequent, so chains are short; each round doubles a step."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "form-steps")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(steps.join(onward, "root", "left").select("word", "root", "next"), "form-steps")
        if moved.where("next is not null").isEmpty():
            return steps
        steps = stored(moved.select("word", F.coalesce("next", "root").alias("root")), "form-steps")


def spelling_groups(docs: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """word, n, form, form_n, root and n_near for every word of the vocabulary.

    Null texts have no words. A null id is an empty text in the checksum. Repeated rows count again. An empty table gives no
    row; other columns are ignored.
    """
    words = stored(vocabulary(docs), "spelling-words")
    first, *rest = [near_words(cells) for cells in bounded_cells(words, most)]
    for more in rest:
        first = first.unionByName(more)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("best")  # text is compared by bytes, which is by code point
    near = first.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    near = near.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.best").alias("best"))
    joined = words.join(near, "word", "left")
    has_form = F.col("best_n") >= FORM_RATIO * F.col("n")
    formed = stored(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.col("best")).alias("form"),
            F.when(has_form, F.col("best_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = roots_of(formed.where("form is not null"))
    out = formed.join(roots, "word", "left")
    return out.select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(read_table(spark, sf_dir, "documents"))
