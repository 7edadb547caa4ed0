"""The pipeline's near-duplicate stage against brute force on five-word shingles."""

import random

import numpy as np

import corpus_pipeline
from slotledger.llm import shingle_dedup
from slotledger.llm.near_dedup import signed

from llm.conftest import ODD_TEXTS
from llm.test_near import SPACE, lowered, roots_of


def plain_set(text):
    words = SPACE.findall(lowered(text))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept_of(rows):
    sets = sorted({plain_set(t) for _, t in rows}, key=sorted)
    roots = roots_of(range(len(sets)), lambda i, j: alike(sets[i], sets[j]))
    place, groups = {x: i for i, x in enumerate(sets)}, {}
    for i, t in rows:
        groups.setdefault(roots[place[plain_set(t)]], []).append(i)
    return sorted(min((i is None, i or 0) for i in g) for g in groups.values())


def edited_texts(rng):
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))]
        texts.append(" ".join(words))
        for n in (1, 2, 3):  # one to three edited words, on the base or on the last copy
            copy = words[:]
            for at in rng.sample(range(len(copy)), n):
                copy[at] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
            words = copy if rng.random() < 0.5 else words
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(2, 40))) for _ in range(40)]
    return texts


def test_stage_links_edited_copies(spark, small):
    rng = random.Random(12)
    rows = list(enumerate(edited_texts(rng)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.near_dedup(spark, docs, small).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == kept_of(rows)
    assert len(found) < len(rows) - 60


def test_stage_on_odd_rows_and_documents(spark, odd, none, small):
    found = corpus_pipeline.near_dedup(spark, odd, small).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == kept_of(ODD_TEXTS)
    assert corpus_pipeline.near_dedup(spark, none, small).count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = corpus_pipeline.near_dedup(spark, docs, small).collect()
    assert sorted((False, r.doc_id) for r in found) == kept_of([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_do_not_depend_on_a_stars_centre(spark):
    """Chains whose ends are not alike, so that no one vertex of a bucket is alike to all others."""
    rng = random.Random(13)
    words = [f"c{i}" for i in range(120)]
    texts = []
    for step in range(12):
        texts.append(" ".join(words))
        words[rng.randrange(120)] = f"d{step}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.k) for r in shingle_dedup.representatives(docs).collect()} == {0}
    assert len({r.s for r in shingle_dedup.grouped(docs).collect()}) == 12 and signed(1 << 63) < 0


def test_crowd_below_the_threshold_is_hardly_compared(spark, monkeypatch):
    """Texts that share a passage, 0.5 to 0.79 alike: they meet in the bands, and next to none of their pairs is compared."""
    rng, compared = random.Random(14), []
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"u{i}x{k}" for k in range(rng.randrange(12, 24)))) for i in range(300)]
    sets = {i: plain_set(t) for i, t in rows}
    likeness = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(40) for j in range(i)]
    assert 0.5 < min(likeness) and max(likeness) < 0.8
    rows += [(1000 + i, t + f" more{i}") for i, t in rows[:20]]
    exact = shingle_dedup.confirmed
    monkeypatch.setattr(shingle_dedup, "confirmed", lambda pairs, sets: compared.append(pairs.count()) or exact(pairs, sets))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.k for r in shingle_dedup.representatives(docs).collect()) == list(range(300))
    assert sum(compared) <= 20 + 10


def test_parities_never_exceed_the_difference():
    rng = random.Random(15)
    for _ in range(300):
        a, b = (np.unique(np.array([rng.randrange(400) * 7919 for _ in range(rng.randrange(200))], np.uint64)) for _ in range(2))
        apart = sum(int(x).bit_count() for x in (shingle_dedup.parities(a) ^ shingle_dedup.parities(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


def test_crowd_of_common_edits_is_hardly_compared(spark, monkeypatch):
    """Copies that took about half of the same twelve edits: every shingle is common, and few pairs are alike in 0.8."""
    rng, compared, rows = random.Random(16), [], []
    for i in range(80):
        words = [f"b{k}" for k in range(150)]
        for at in range(6, 150, 12):
            if rng.random() < 0.5:
                words[at] = f"e{at}"
        rows.append((i, " ".join(words)))
    exact = shingle_dedup.confirmed
    monkeypatch.setattr(shingle_dedup, "confirmed", lambda pairs, sets: compared.append(pairs.count()) or exact(pairs, sets))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((False, r.k) for r in shingle_dedup.representatives(docs).collect()) == kept_of(rows)
    assert sum(compared[-1:]) <= 20
