"""Language identification by unigram pieces, summed over every segmentation.

The pieces come from a fixed public vocabulary. Each language has a probability for every piece, and a word's likelihood is the
sum over all ways to cut it into pieces, by the forward algorithm over many words at once. Probabilities are learned by
expectation maximisation (forward-backward) from word counts of at most ``train_docs`` documents per language, those with the
smallest hash of their id. Counts stay in Spark; the driver holds one number per piece and language.

A word is a run of letters in lower case with the vocabulary's word mark before it, however long. Pieces do not cross words, so a
text's likelihood is the product of its words', which each worker remembers. Words of over 48 letters take the same sums one word
at a time, in stretches of places with the last chances carried over, and are not remembered.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotledger.llm.common import KEY, SAMPLE_SLACK, crc_mod, hash_share, key_columns, map_batches, read_table, stored

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
TRAIN_DOCS = 1_000
ROUNDS = 3
UNKNOWN = 1e-7
SMOOTHING = 0.05
#: Longer words are not laid out whole.
LATTICE_LETTERS = 48
#: Places of a longer word that are in memory at a time.
PLACES_AT_ONCE = 4_096
MOST_WORDS = 200_000
#: Words whose lattices are in memory at a time.
WORDS_AT_ONCE = 4_000
#: Chances below this power of two are multiplied by its inverse, and how often is counted.
LEAST_POWER = -200
UNDETERMINED = "und"
SURE = 20.0

# Fixed value: the word mark of the vocabulary.
MARK = chr(0x2581)

_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Letter runs in lower case; none where the text has no letter."""
    found = _LETTERS.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


# ---- the vocabulary and its automaton in numpy ------------------------------------------------------------------


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of every prefix of every row, modulo 2**64."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + codes[:, j] + np.uint64(1)
    return out


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[np.ndarray, int]:
    """Sorted hashes of the pieces made of letters, and the length of the longest."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    pieces = [p for p in texts if p == MARK or p.lower() == p and re.fullmatch(rf"{MARK}?[^\W\d_]+", p)]
    by_length = defaultdict(list)
    for p in pieces:
        by_length[len(p)].append(p)
    hashes = np.concatenate([_prefix_hashes(_codes(ps))[:, -1] for ps in by_length.values()])
    return np.sort(hashes), max(by_length)


class Lattice:
    """Every piece of every word of one length: ``at(i, j)`` has the index of the piece between two places."""

    def __init__(self, path: str, words: list[str]):
        self.hashes, longest = vocabulary(path)
        self.prefix = _prefix_hashes(_codes([MARK + w for w in words]))
        self.length = self.prefix.shape[1] - 1
        self.longest = min(longest, self.length)
        self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(self.longest, _BASE))])

    def at(self, i: int, j: int) -> np.ndarray:
        """Index of the piece, or the vocabulary's size for an unknown letter, or one more for no piece."""
        h = self.prefix[:, j] - self.prefix[:, i] * self.powers[j - i]
        n = len(self.hashes)
        found = np.minimum(np.searchsorted(self.hashes, h), n - 1)
        return np.where(self.hashes[found] == h, found, n if j - i == 1 else n + 1)

    def forward(self, p: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], dict]:
        """Chances of every prefix, summed over its segmentations, how often each was scaled up, and the pieces met.

        ``p``: pieces x languages, with two rows more. A chance is its number times 2 ** LEAST_POWER for each time.
        """
        alpha, times, met = [np.ones((len(self.prefix), p.shape[1]))], [np.zeros((len(self.prefix), p.shape[1]), np.int32)], {}
        live = alpha[:]  # on the scale of the last place
        for j in range(1, self.length + 1):
            total = np.zeros_like(alpha[0])
            for i in range(max(0, j - self.longest), j):
                index = self.at(i, j)
                if j - i == 1 or (index <= len(self.hashes)).any():
                    met[i, j] = index
                    total += live[i] * p[index]
            total, scaled = _scaled_up(total, live, range(max(0, j + 1 - self.longest), j))
            live.append(total)
            alpha.append(total)
            times.append(times[-1] + scaled)
        return alpha, times, met


def _scaled_up(total: np.ndarray, live: list, places: range) -> tuple[np.ndarray, np.ndarray]:
    """The chances, with the small ones scaled up, and which these are; those of ``places``, still needed, follow."""
    small = total < 2.0**LEAST_POWER
    if not small.any():
        return total, small
    up = np.where(small, 2.0**-LEAST_POWER, 1.0)
    for i in places:
        live[i] = live[i] * up
    return total * up, small


class LongWord(Lattice):
    """The pieces of one word, for a stretch of places at a time."""

    def __init__(self, path: str, word: str):
        super().__init__(path, [word])

    def chances(self, p: np.ndarray, start: int, stop: int, ahead: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and chances of the pieces of each length (column) that end one place after each of ``start`` up to ``stop``.

        With ``ahead``, of those that start at these places. Pieces that would leave the word have no chance.
        """
        none = len(self.hashes) + 1
        index = np.full((stop - start, self.longest), none)
        for d in range(1, self.longest + 1):
            first, last = (start, min(stop, self.length + 1 - d)) if ahead else (max(start, d - 1), stop)
            if first < last:
                begin = np.arange(first, last) - (0 if ahead else d - 1)
                h = self.prefix[0, begin + d] - self.prefix[0, begin] * self.powers[d]
                found = np.minimum(np.searchsorted(self.hashes, h), none - 2)
                index[first - start : last - start, d - 1] = np.where(self.hashes[found] == h, found, none - 1 if d == 1 else none)
        return index, p[index]

    def stretches(self) -> list[tuple[int, int]]:
        return [(a, min(a + PLACES_AT_ONCE, self.length)) for a in range(0, self.length, PLACES_AT_ONCE)]

    def logs(self, p: np.ndarray) -> np.ndarray:
        """Log-likelihood in each language."""
        for last in _sums((self.chances(p, a, b)[1] for a, b in self.stretches()), self.longest, p.shape[1]):
            total, times = last
        return np.log(total) + times * (LEAST_POWER * np.log(2))

    def expected(self, p: np.ndarray, count: float, out: np.ndarray) -> None:
        """Add how often each piece is expected, ``count`` times, in one language."""
        alpha, times = np.ones(self.length + 1), np.zeros(self.length + 1, np.int64)
        for j, (total, scaled) in enumerate(_sums((self.chances(p, a, b)[1] for a, b in self.stretches()), self.longest, 1), 1):
            alpha[j], times[j] = total[0], scaled[0]
        beta, back = np.ones(self.length + 1), np.zeros(self.length + 1, np.int64)
        backward = (self.chances(p, a, b, ahead=True)[1][::-1] for a, b in reversed(self.stretches()))
        for j, (total, scaled) in enumerate(_sums(backward, self.longest, 1), 1):
            beta[self.length - j], back[self.length - j] = total[0], scaled[0]
        for a, b in self.stretches():
            index, chance = self.chances(p, a, b, ahead=True)
            ends = np.minimum(np.arange(a, b)[:, None] + np.arange(1, self.longest + 1), self.length)
            share = alpha[a:b, None] * chance[:, :, 0] * beta[ends] * (count / alpha[-1])
            share = np.ldexp(share, LEAST_POWER * (times[a:b, None] + back[ends] - times[-1]))
            known = index < len(self.hashes)
            out += np.bincount(index[known], share[known], minlength=len(out))


def _sums(stretches: Iterator[np.ndarray], longest: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chances of all prefixes one after another, each with how often it was scaled up. Only the last ``longest`` are held."""
    window, times = np.zeros((longest, width)), np.zeros(width, np.int64)
    window[0] = 1
    for stretch in stretches:
        for chances in stretch:
            total = (chances * window).sum(axis=0)
            window[1:] = window[:-1].copy()
            window[0] = total
            small = total < 2.0**LEAST_POWER
            if small.any():
                window[:, small] *= 2.0**-LEAST_POWER
                times = times + small
            yield window[0], times


def _by_length(words) -> dict[int, list]:
    """Places of the words that a lattice holds, by their length."""
    out = defaultdict(list)
    for i, w in enumerate(words):
        if len(w) <= LATTICE_LETTERS:
            out[len(w)].append(i)
    return out


def _long(words) -> list[int]:
    return [i for i, w in enumerate(words) if len(w) > LATTICE_LETTERS]


def _padded(p: np.ndarray) -> np.ndarray:
    """Probabilities with a row for unknown letters and one for what is no piece."""
    return np.concatenate([p, np.full((1, p.shape[1]), UNKNOWN), np.zeros((1, p.shape[1]))])


def word_logs(path: str, words: list[str], p: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language."""
    out = np.zeros((len(words), p.shape[1]))
    for places in _by_length(words).values():
        for start in range(0, len(places), WORDS_AT_ONCE):
            chosen = places[start : start + WORDS_AT_ONCE]
            alpha, times, _ = Lattice(path, [words[i] for i in chosen]).forward(p)
            out[chosen] = np.log(alpha[-1]) + times[-1] * (LEAST_POWER * np.log(2))
    for i in _long(words):
        out[i] = LongWord(path, words[i]).logs(p)
    return out


def expected_pieces(path: str, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, over all segmentations, in one language (``p`` has one column)."""
    n = len(vocabulary(path)[0])
    out = np.zeros(n)
    for places in _by_length(words).values():
        lattice = Lattice(path, [words[i] for i in places])
        alpha, times, met = lattice.forward(p)
        beta = [None] * lattice.length + [np.ones(len(places))]
        live, back = beta[:], [None] * lattice.length + [np.zeros(len(places), np.int32)]
        weight = counts[places] / alpha[-1][:, 0]
        for i in range(lattice.length - 1, -1, -1):
            total = sum(p[met[i, j], 0] * live[j] for j in range(i + 1, lattice.length + 1) if (i, j) in met)
            total, scaled = _scaled_up(total, live, range(i + 1, min(lattice.length, i - 1 + lattice.longest) + 1))
            beta[i] = live[i] = total
            back[i] = back[i + 1] + scaled
        for (i, j), index in met.items():
            known = index < n
            share = alpha[i][:, 0] * p[index, 0] * beta[j] * weight
            share = np.ldexp(share, LEAST_POWER * (times[i][:, 0] + back[j] - times[-1][:, 0]))
            out += np.bincount(index[known], share[known], minlength=n)
    for i in _long(words):
        LongWord(path, words[i]).expected(p, counts[i], out)
    return out


# ---- learning ---------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over the given documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts.update((lang, w) for w in words_of(text))
            keys = list(counts)
            columns = [[k[0] for k in keys], [k[1] for k in keys], list(counts.values())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    partial = map_batches(docs.select("lang", "text"), run, "lang string, word string, n long")
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def training_sample(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, lang and text to learn from: one row of each of ``train_docs`` ids a language, of all with an id, a language and a text."""
    usable = docs.where("doc_id is not null and lang is not null and text is not null")
    ids = usable.select("doc_id", "lang").distinct()
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))  # a row per language
    near = ids.withColumn("share", hash_share("doc_id")).join(F.broadcast(sizes), "lang")
    near = near.where(F.col("share") * F.col("n") <= SAMPLE_SLACK * train_docs)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("share", "doc_id")))
    chosen = ranked.where(F.col("rank") <= train_docs).select("doc_id", "lang")
    rows = usable.join(F.broadcast(chosen), ["doc_id", "lang"])
    return rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS, path: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """The languages in order, and piece probabilities, from documents with an id, a language and a text."""
    counts = stored(word_counts(training_sample(docs, train_docs)), "language-words")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    n = len(vocabulary(path)[0])
    p = np.full((n, len(langs)), 1 / n)
    for _ in range(rounds if langs else 0):
        table = counts.sparkSession.sparkContext.broadcast(_padded(p))
        spread = {lang: k for k, lang in enumerate(langs)}

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lang, word, count = (np.array(batch.column(c).to_pylist(), object) for c in ("lang", "word", "n"))
                for one in sorted(set(lang)):
                    mine, k = lang == one, spread[one]
                    seen = expected_pieces(path, word[mine].tolist(), count[mine].astype(float), table.value[:, k : k + 1])
                    index = np.flatnonzero(seen)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(index), k), pa.int32()), pa.array(index, pa.int32()), pa.array(seen[index], pa.float64())],
                        ["lang", "piece", "n"],
                    )

        sums = map_batches(counts, expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        seen = np.full((n, len(langs)), SMOOTHING)
        seen[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += sums["n"].to_numpy()
        p = seen / seen.sum(axis=0)
    return langs, p


# ---- scoring ----------------------------------------------------------------------------------------------------


class Memory:
    """Word likelihoods of one worker, in a table that starts over once it has ``MOST_WORDS`` rows."""

    def __init__(self, path: str, p: np.ndarray):
        self.path, self.p, self.rows = path, p, {}
        self.table = np.zeros((1024, p.shape[1]))

    def score(self, texts: list[list[str]]) -> np.ndarray:
        """Summed log-likelihoods of each text's words."""
        if len(self.rows) > MOST_WORDS:
            self.rows.clear()
        new = list({w for words in texts for w in words if w not in self.rows})
        out = np.zeros((len(texts), self.p.shape[1]))
        if _long(new):
            new = [w for w in new if len(w) <= LATTICE_LETTERS]
            for k, words in enumerate(texts):
                long = Counter(words[i] for i in _long(words))
                out[k] = sum(n * word_logs(self.path, [w], self.p)[0] for w, n in long.items())
            texts = [[w for w in words if len(w) <= LATTICE_LETTERS] for words in texts]
        first, need = len(self.rows), len(self.rows) + len(new)
        if need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(need - len(self.table), len(self.table)), self.p.shape[1]))])
        self.table[first:need] = word_logs(self.path, new, self.p)
        self.rows.update(zip(new, range(first, need)))
        for k, words in enumerate(texts):
            if words:
                out[k] += self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))].sum(axis=0)
        return out


@lru_cache(maxsize=2)
def _worker_memory(path: str, table) -> Memory:
    return Memory(path, table.value)


def languages(docs: DataFrame, langs: list[str], p: np.ndarray, path: str = VOCABULARY, step: int = 200) -> DataFrame:
    """doc_id, the row's key, lang_pred, score, letters and fit for every row, from the text alone.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. The score is the language's share of
    the likelihoods. ``letters`` counts letters; ``fit`` is the log-likelihood a letter (and word mark) in the best language, null
    where the language is ``und``. Repeated rows and null ids stay; ties go to the first language in order; an empty table gives none.
    """
    table = docs.sparkSession.sparkContext.broadcast(_padded(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _worker_memory(path, table)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                texts = [words_of(t) for t in part.column("text").to_pylist()]
                letters = [sum(map(len, words)) for words in texts]
                pred, score, fit = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [None] * len(texts)
                if langs:
                    logs = memory.score(texts)
                    most = logs.max(axis=1, keepdims=True)
                    logs -= most
                    share = np.exp(logs)
                    best, top = logs.argmax(axis=1), 1 / share.sum(axis=1)
                    for k, words in enumerate(texts):
                        if words:
                            pred[k], score[k], fit[k] = langs[best[k]], top[k], most[k, 0] / (letters[k] + len(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("doc_id", *KEY)),
                        *(pa.array(v, kind) for v, kind in zip((pred, score, letters, fit), (pa.string(), pa.float64(), pa.int64(), pa.float64()))),
                    ],
                    ["doc_id", *KEY, "lang_pred", "score", "letters", "fit"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", *key_columns(), "text")
    return map_batches(rows, run, f"doc_id {kind}, k long, h long, lang_pred string, score double, letters long, fit double")


def held_out(key):
    """Documents that are never learned from; rows without an id are not learned from either, but not held out."""
    return F.coalesce(crc_mod(key, 4) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, and predict every row."""
    langs, p = learn(docs.where(~held_out(F.col("doc_id"))))
    return languages(docs, langs, p).withColumn("held_out", held_out(F.col("doc_id")))


def least_fit(sample: DataFrame, langs: list[str], p: np.ndarray) -> float | None:
    """A fit far below that of every learned language: null where none was learned.

    For each prediction among the training documents, twice as low as their middle, or as far below their lowest hundredth as that is
    below the middle where this is lower; the lowest of these.
    """
    found = languages(sample, langs, p).where("fit is not null")  # a bounded number of ids for each language
    middle, low = F.percentile("fit", F.lit(0.5)), F.percentile("fit", F.lit(0.01))
    limits = found.groupBy("lang_pred").agg(F.least(2 * middle, 2 * low - middle).alias("limit"))
    return limits.agg(F.min("limit")).first()[0]


def foreign(docs: DataFrame) -> DataFrame:
    """The keys of texts in none of the learned languages: without a letter, or less likely a letter than ``least_fit``.

    The letters of a text must fall short of the limit by ``SURE`` in all, so that a few rare letters in a short text do not count.
    Where nothing was learned, only texts without a letter are known to be none.
    """
    known = docs.where(~held_out(F.col("doc_id")))
    langs, p = learn(known)
    limit = least_fit(training_sample(known), langs, p)
    found = languages(docs, langs, p)
    short = (F.lit(limit).cast("double") - F.col("fit")) * F.col("letters")
    return found.where((F.col("letters") == 0) | F.coalesce(short > SURE, F.lit(False))).select(*KEY)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")
