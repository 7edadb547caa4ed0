"""The fingerprint search over near copies, against brute force."""

import random

import pytest

from slotledger.llm import doc_fingerprints
from slotledger.llm.near_dedup import signed

from llm.test_near import plain_print
from llm.test_shingles import alike, plain_set

MEDIUM = "/root/testdata/sf0.01"


def apart(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


@pytest.mark.parametrize("radius,blocks", [(20, 7), (9, 4), (3, 5)])
def test_search_at_any_radius(spark, radius, blocks):
    rng = random.Random(14)
    centres = [rng.getrandbits(128) for _ in range(3)]
    values = [*centres, centres[0]]
    for centre in centres:
        for d in range(30):
            x = centre
            for b in rng.sample(range(128), d):
                x ^= 1 << b
            values.append(x)
    split = lambda v: (signed(v & (2**64 - 1)), signed(v >> 64))
    table = spark.createDataFrame([split(v) for v in values], "a long, b long")
    asked = spark.createDataFrame([split(v) for v in centres], "a long, b long")
    found = doc_fingerprints.within_radius(asked, table, radius, blocks).collect()
    assert sum(r.found_rows for r in found) == sum((v ^ c).bit_count() <= radius for c in centres for v in values)
    assert len(found) == sum((v ^ c).bit_count() <= radius for c in centres for v in set(values))


def test_near_copies_of_documents_are_found(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rng, last = random.Random(15), max(texts)
    for i in [i for i, t in texts.items() if i % 20 == 0 and 100 < len((t or "").split()) < 400][:15]:
        words = texts[i].split()
        words[rng.randrange(len(words))] = "edited"
        last += 1
        texts[last] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in doc_fingerprints.document_fingerprints(docs).collect()}
    prints = {i: r.fingerprint for i, r in found.items()}
    for i in [i for i in texts if i % 20 == 0]:
        assert found[i].n_near == sum(apart(prints[i], p) <= doc_fingerprints.NEAR_RADIUS for p in prints.values()) - 1
    sets = {i: plain_set(t) for i, t in texts.items()}
    pairs = [(i, j) for i in texts if i % 20 == 0 for j in texts if i != j and sets[i] != sets[j] and alike(sets[i], sets[j])]
    assert len(pairs) >= 15
    assert all(apart(prints[i], prints[j]) <= doc_fingerprints.NEAR_RADIUS for i, j in pairs)
    assert all(prints[i] == plain_print(texts[i] or "") for i in list(texts)[:20])
