"""Quality scores from positive-unlabelled learning.

Trusted positives are the documents that the labels call good; everything else is unlabelled web text, and no document is
taken to be bad. A linear model is trained to minimise the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the logistic loss. The ``prior``, the share of good documents among the unlabelled,
is estimated from the same two samples (best bin: the smallest share of unlabelled over positives above a score that tells them
apart), never from labels that call a document bad. Text becomes a bounded vector: shares of character classes, repetition of words and lines, lengths, and a
hashed histogram of word shapes. Training uses at most ``train_rows`` positives and as many unlabelled documents, those with
the smallest hash of their id and one row of each id, so the driver holds two small matrices whatever the corpus; every document is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.llm.common import SAMPLE_SLACK, crc_mod, hash_share, map_batches, read_table, text_or_empty

TRAIN_ROWS = 4_000
SHAPES = 48
THRESHOLD = 0.3

_SHAPE = {c: "a" for c in range(ord("a"), ord("z") + 1)} | {c: "A" for c in range(ord("A"), ord("Z") + 1)}
_SHAPE |= {c: "0" for c in range(ord("0"), ord("9") + 1)}
_SHAPE |= {c: ("a" if chr(c).islower() else "A") for c in range(0xC0, 0x250) if chr(c).isalpha()}
_RUNS = re.compile(r"(.)\1+")
DESCRIPTORS = 16
WIDTH = DESCRIPTORS + SHAPES


def features(text: str) -> list[float]:
    """``WIDTH`` numbers of a whole text; an empty text gives zeros."""
    out = [0.0] * WIDTH
    words = text.split()
    if not words:
        return out
    shape = text.translate(_SHAPE)
    n, chars = len(words), len(text)
    counts = Counter(words)
    lines = text.split("\n")
    lower, upper, digit = shape.count("a"), shape.count("A"), shape.count("0")
    spaces = n - 1
    lengths = [len(w) for w in words]
    kinds = Counter(shape.split())
    repeats = sum(map(str.__eq__, words, words[1:]))
    out[:DESCRIPTORS] = [
        1.0,
        math.log1p(n) / 10,
        math.log1p(len(lines)) / 10,
        len(counts) / n,
        math.log(len(counts)) / max(1.0, math.log(n)),
        max(counts.values()) / n,
        repeats / n,
        1 - len(set(lines)) / len(lines),
        sum(lengths) / n / 10,
        max(lengths) / 50 if max(lengths) < 50 else 1.0,
        lower / chars,
        upper / chars,
        digit / chars,
        max(0, chars - lower - upper - digit - spaces) / chars,
        math.sqrt(upper / chars),
        math.sqrt(max(0, chars - lower - upper - digit - spaces) / chars),
    ]
    for kind, k in kinds.items():
        at = xxhash.xxh64_intdigest(_RUNS.sub(r"\1", kind).encode(), 10) % SHAPES
        out[DESCRIPTORS + at] += k / n
    for at in range(DESCRIPTORS, WIDTH):
        out[at] = math.sqrt(out[at])
    return out


def _vectors(rows: DataFrame, extra: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(extra), pa.array(vectors, pa.list_(pa.float64()))], [extra, "x"])

    return map_batches(rows.select(extra, "text"), run, f"{extra} int, x array<double>")


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scales(positives: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and scales of the features; the first, which is 1, stays."""
    everything = np.concatenate([positives, unlabelled])
    mean, scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
    mean[0], scale[0] = 0.0, 1.0
    return mean, scale


def descend(gradient, width: int, rounds: int = 600, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights by full-batch Adam; deterministic."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, rounds + 1):
        g = gradient(w) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def risk_step(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """The gradient of the risk; where its part for bad documents is below 0, the gradient that raises this part."""
    zp, zu = p @ w, u @ w
    sp, su = logistic(zp), logistic(zu)
    good = prior * (p * (sp - 1)[:, None]).mean(axis=0)
    bad = (u * su[:, None]).mean(axis=0) - prior * (p * sp[:, None]).mean(axis=0)
    bad_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return good + bad if bad_risk >= 0 else -bad


def train(positives: np.ndarray, unlabelled: np.ndarray, prior: float):
    """Weights that minimise the non-negative risk, and the means and scales of the features."""
    mean, scale = scales(positives, unlabelled)
    p, u = (positives - mean) / scale, (unlabelled - mean) / scale
    return descend(lambda w: risk_step(w, p, u, prior), p.shape[1]), mean, scale


def best_bin(good: np.ndarray, mixed: np.ndarray, doubt: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives in a mixture, from scores of both: unlabelled over positives at or above the best score to cut at.

    That cut has the least upper bound of the ratio, which keeps it off tails that hold few positives.
    """
    cuts = np.sort(good)
    above_good = 1 - np.searchsorted(cuts, cuts, side="left") / len(good)
    above_mixed = 1 - np.searchsorted(np.sort(mixed), cuts, side="left") / len(mixed)
    spread = sum(math.sqrt(math.log(4 / doubt) / (2 * len(x))) for x in (good, mixed))
    best = np.argmin((above_mixed + (1 + slack) * spread) / above_good)
    return float(min(1.0, above_mixed[best] / above_good[best]))


def class_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled: each half of the rows is measured by a classifier of the other half.

    0.5 where either has less than two rows.
    """
    if min(len(positives), len(unlabelled)) < 2:
        return 0.5
    found = []
    for half in (0, 1):
        p, u = positives[half::2], unlabelled[half::2]
        mean, scale = scales(p, u)
        p, u = (p - mean) / scale, (u - mean) / scale

        def gradient(w: np.ndarray) -> np.ndarray:
            return (p * (logistic(p @ w) - 1)[:, None]).mean(axis=0) + (u * logistic(u @ w)[:, None]).mean(axis=0)

        w = descend(gradient, p.shape[1])
        good, mixed = (((x[1 - half :: 2] - mean) / scale) @ w for x in (positives, unlabelled))
        found.append(best_bin(good, mixed))
    return sum(found) / 2


def fit(docs: DataFrame, labels: DataFrame, held_out, train_rows: int = TRAIN_ROWS):
    """A model from the rows outside ``held_out``: positives by label, and unlabelled rows of any kind.

    Labels that contradict each other are not trusted. Without positives the model gives every text 0.5.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    n_good = known.where("high = 1").count()
    pool = docs.where(F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).select("doc_id", text_or_empty(F.col("text")).alias("text"))

    def smallest(rows: DataFrame, n: int, kind: int, *salt) -> DataFrame:
        near = rows.select("doc_id", hash_share("doc_id", *salt).alias("share")).where(F.col("share") * n <= SAMPLE_SLACK * train_rows)
        return near.distinct().orderBy("share", "doc_id").limit(train_rows).select("doc_id", F.lit(kind).alias("kind"))

    chosen = smallest(known.where("high = 1"), n_good, 1)
    others = smallest(pool, pool.select("doc_id").distinct().count(), 0, F.lit("u"))
    rows = pool.join(F.broadcast(chosen.unionAll(others)), "doc_id")
    sample = rows.groupBy("doc_id", "kind").agg(F.min("text").alias("text"))  # at most twice train_rows rows
    table = _vectors(sample, "kind").toArrow()
    kinds = np.array(table["kind"].to_pylist(), int)
    x = np.array(table["x"].to_pylist(), float).reshape(-1, WIDTH)
    if not (kinds == 1).any():
        return np.zeros(WIDTH), np.zeros(WIDTH), np.ones(WIDTH)
    order = np.lexsort(x.T[::-1])  # rows arrive in any order; sums must not depend on it
    x, kinds = x[order], kinds[order]
    good, unlabelled = x[kinds == 1], x[kinds == 0]
    return train(good, unlabelled, min(max(class_prior(good, unlabelled), 1e-3), 1 - 1e-3))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out=lambda key: crc_mod(key, 5) == 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; null texts are empty, rows without an id are not held out.

    The score depends on the text alone. Empty texts get a score too. An empty table gives none; repeated rows stay.
    """
    w, mean, scale = fit(docs, labels, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()], float).reshape(-1, WIDTH)
            x[:, 0] = 1.0
            z = np.clip(((x - mean) / scale) @ w, -30, 30)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(1 / (1 + np.exp(-z)), pa.float64())],
                ["doc_id", "held_out", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), text_or_empty(F.col("text")).alias("text")
    )
    scored = map_batches(rows, run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
