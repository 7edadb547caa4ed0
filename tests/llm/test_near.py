"""Near duplicates, repeats, fingerprints and contamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from slotledger.llm import decontamination, doc_fingerprints, near_dedup, substring_dedup
from slotledger.llm.components import components

from llm.conftest import ODD_TEXTS, PASSAGE

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_fingerprint(text):
    words = SPACE.findall(lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(values, linked):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_near_duplicates_of_odd_rows(odd, none):
    found = near_dedup.near_duplicates(odd).collect()
    prints = [plain_fingerprint(t) for _, t in ODD_TEXTS]
    roots = roots_of(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 3)
    want = Counter()
    for (i, _), f in zip(ODD_TEXTS, prints):
        ids = [j for (j, _), g in zip(ODD_TEXTS, prints) if roots[g] == roots[f] and j is not None]
        want[i, f"{f:016x}", min(ids, default=None)] += 1
    assert Counter(map(tuple, found)) == want
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.representatives(odd).count() == len(set(roots.values()))


def test_covering_masks_meet_every_pair():
    rng = random.Random(3)
    masks = near_dedup.covering_masks()
    for _ in range(5000):
        bits = rng.sample(range(64), rng.randint(0, 3))
        difference = sum(1 << b for b in bits)
        assert any(difference & m == 0 for m in masks)


@pytest.mark.parametrize("small_bucket", [3, 40, 2048])
def test_links_of_crowds(spark, small_bucket):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(60)}
    for centre in (0, 2**64 - 1, rng.getrandbits(64)):
        for _ in range(100):
            x = centre
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            values.add(x)
    values = sorted(map(near_dedup.signed, values))
    table = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.vertex: r.root for r in components(near_dedup.links(table, 3, small_bucket)).collect()}
    want = roots_of(values, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert found == {v: r for v, r in want.items() if v != r}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (500, 501), (501, 500)], "a long, b long")
    found = {r.vertex: r.root for r in components(edges).collect()}
    assert found == {i: 0 for i in range(1, 301)} | {501: 500}


# ---- repeats ----------------------------------------------------------------------------------------------------


def plain_repeats(texts, window=35):
    lists = [SPACE.findall(t or "") for t in texts]
    seen = Counter(tuple(w[p : p + window]) for w in lists for p in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("crowd", [2, 16_000])
def test_repeats(spark, odd, none, crowd):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (34, 35, 36, 50, 90)]
    texts = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(80))]
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = p[: rng.randrange(len(p) - 6, len(p) + 1)]
        texts.append(" ".join(words))
    texts += ["x y " * 60, "z " * 34, "z " * 36, texts[0]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = [tuple(r)[1:] for r in substring_dedup.remove_repeats(docs, crowd).orderBy("doc_id").collect()]
    assert found == plain_repeats(texts)
    odd_found = Counter(tuple(r) for r in substring_dedup.remove_repeats(odd, crowd).collect())
    assert odd_found == Counter((i, *r) for (i, _), r in zip(ODD_TEXTS, plain_repeats([t for _, t in ODD_TEXTS])))
    assert substring_dedup.remove_repeats(none).count() == 0


# ---- fingerprints -----------------------------------------------------------------------------------------------


def plain_print(text):
    words = SPACE.findall(text)
    hashes = []
    for a, b in zip(words, words[1:]) if len(words) > 1 else [(w, None) for w in words]:
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
        hashes.append((h, xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)))
    words = [sum(1 << i for i in range(64) if 2 * sum(h[k] >> i & 1 for h in hashes) > len(hashes)) for k in (0, 1)]
    return f"{words[0]:016x}{words[1]:016x}"


def same(a, b):
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128


@pytest.mark.parametrize("bucket_rows", [1, 3, 2000])
def test_fingerprints(spark, odd, none, bucket_rows):
    texts = {40: "alpha beta gamma delta", 20: "alpha beta", 7: "", 60: "é" * 31, 100: "alpha beta gamma delta", 3: "one", 21: "a  b\tc\n"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in doc_fingerprints.document_fingerprints(docs, bucket_rows).collect()}
    ids = sorted(texts)
    assert sorted(found) == ids
    prints = {i: plain_print(t) for i, t in texts.items()}
    for i, j in zip(ids, ids[1:] + ids[:1]):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[j][:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints[i], plain_print(edited))
        assert (r.near_edited, r.near_next) == (same(r.fingerprint, r.edited_fingerprint), same(prints[i], prints[j]))
        near = sum(same(prints[i], p) >= 1 - 3 / 128 for p in prints.values()) - 1
        assert r.n_near == (near if i % 20 == 0 else None)
    every = doc_fingerprints.document_fingerprints(odd, bucket_rows).collect()
    assert Counter(r.doc_id for r in every) == Counter(i for i, _ in ODD_TEXTS)
    assert Counter(r.fingerprint for r in every) == Counter(plain_print(t or "") for _, t in ODD_TEXTS)
    assert doc_fingerprints.document_fingerprints(none).count() == 0
    one = doc_fingerprints.document_fingerprints(docs.where("doc_id = 40")).first()
    assert one.near_next == 1.0


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(6)
    centre = rng.getrandbits(128)
    values = [centre]
    for d in (0, 1, 2, 3, 3, 3, 4, 5, 8):
        x = centre
        for b in rng.sample(range(128), d):
            x ^= 1 << b
        values.append(x)
    values += [rng.getrandbits(128) for _ in range(50)]
    split = lambda v: (near_dedup.signed(v & (2**64 - 1)), near_dedup.signed(v >> 64))
    table = spark.createDataFrame([split(v) for v in values], "a long, b long")
    asked = spark.createDataFrame([split(centre)], "a long, b long")
    found = doc_fingerprints.within_radius(asked, table).collect()
    assert sum(r.found_rows for r in found) == sum((v ^ centre).bit_count() <= 3 for v in values)
    assert len(found) == len({v for v in values if (v ^ centre).bit_count() <= 3})


# ---- contamination ----------------------------------------------------------------------------------------------

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_contamination(texts, items):
    out = []
    lists = [ITEM_WORD.findall(lowered(t)) for t in texts]
    for words in lists:
        hit, ids = set(), set()
        for item_id, text in items:
            item = ITEM_WORD.findall(lowered(text))
            n = min(10, len(item))
            windows = {tuple(item[o : o + n]) for o in range(len(item) - n + 1)} if n else set()
            for s in range(len(words) - n + 1) if n else ():
                if tuple(words[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    ids.add("" if item_id is None else str(item_id))
        out.append((len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination(spark, odd, none):
    items = [
        (1, PASSAGE), (10, "The CAT sat on the mat"), (2, "two words"), (2, "two words"), (None, "no id here"), (4, None), (5, "..."),
        (6, "passage3 Passage4 passage5"), (7, "be be be"), (8, "nowhere at all to be seen"), (9, "ÀÉ 漢字"), (12, "be " * 12),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(odd, table)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = Counter((i, *r) for (i, _), r in zip(ODD_TEXTS, plain_contamination([t for _, t in ODD_TEXTS], items)))
    assert Counter(map(tuple, found.select(columns).collect())) == want
    assert decontamination.contamination(none, table).count() == 0
    clean = decontamination.contamination(odd, table.where("false")).collect()
    assert len(clean) == len(ODD_TEXTS) and not any(r.contaminated for r in clean)


def test_random_contamination(spark):
    rng = random.Random(7)
    word = lambda: rng.choice("abcde")
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 16)))) for i in range(12)]
    texts = [" ".join(word() for _ in range(rng.randrange(60))) + " " + rng.choice(items)[1][: rng.randrange(1, 30)] for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(docs, table).drop("k", "h").orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in found] == plain_contamination(texts, items)


def test_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "alpha one two three beta"), (2, "alpha beta"), (3, "beta alpha"), (4, "alpha " + "x " * 30 + "beta")], "doc_id long, text string"
    )
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    index = decontamination.TestIndex(docs, items)
    assert {r.doc_id for r in index.proximity(0).collect()} == {2}
    assert {r.doc_id for r in index.proximity(3).collect()} == {1, 2, 3}


def test_native_plans_hold_no_python(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    for df in (decontamination.contamination(docs, items), doc_fingerprints.document_fingerprints(docs), doc_fingerprints.fingerprint_rows(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
