"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from slotledger.llm import spelling

from llm.conftest import ODD_TEXTS


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(u, v):
    if len(u) < len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(u) == len(v) + 1 and any(u[:i] + u[i + 1 :] == v for i in range(len(u)))


def plain_groups(counts):
    words = sorted(counts)
    near = {w: [] for w in words}
    for i, u in enumerate(words):
        for v in words[i + 1 :]:
            if abs(len(u) - len(v)) < 2 and one_edit(u, v):
                near[u].append(v)
                near[v].append(u)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    rows = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, counts[w], form[w], counts.get(form[w]), root, len(near[w])))
    return rows


def found_rows(df):
    return sorted(tuple(r) for r in df.select("word", "n", "form", "form_n", "root", "n_near").collect())


def variants(seed):
    """Texts whose words have runs of one letter, edits at every place, frequent forms and chains of them."""
    rng, words = random.Random(seed), []
    for letters, size in (("ab", 8), ("abcé", 9), ("mno", 12), ("xyzÿ×", 7)):
        for _ in range(6):
            base = "".join(rng.choice(letters) for _ in range(size))
            words += [base] * rng.choice((2, 30, 400))
            for _ in range(rng.randrange(1, 25)):
                at, kind = rng.randrange(len(base) + 1), rng.randrange(3)
                other = base[:at] + (rng.choice(letters) if kind else "") + base[at + (kind != 1) :]
                words += [other] * rng.choice((1, 2, 3, 40))
    words += ["chainword"] * 3000 + ["chainwordx"] * 250 + ["chainwodx"] * 20 + ["chinwodx"] * 2
    rng.shuffle(words)
    return [(i, "~".join(w.upper() if rng.random() < 0.1 else w for w in words[i::60])) for i in range(60)]


def test_acceptor_is_minimal_and_composition_complete():
    rng = random.Random(5)
    for _ in range(300):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(1, 40))})
        acceptor = spelling.Acceptor(words)
        assert sorted(acceptor.language(acceptor.start)) == words
        assert len({frozenset(acceptor.language(q)) for q in range(len(acceptor.arcs))}) == len(acceptor.arcs)
        want = sorted(tuple(sorted((u, v))) for i, u in enumerate(words) for v in words[i + 1 :] if abs(len(u) - len(v)) < 2 and one_edit(u, v))
        assert sorted(tuple(sorted(p)) for p in acceptor.one_edit_pairs()) == want


@pytest.mark.parametrize("most", [spelling.MOST_WORDS, 12, 3])
def test_groups_equal_brute_force(spark, most):
    rows = variants(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups(plain_words(rows))
    assert any(r[2] and r[4] != r[2] for r in want), "no chain of forms"
    assert found_rows(spelling.spelling_groups(docs, most)) == want


def test_documents_and_odd_rows(spark, odd, none, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found_rows(spelling.spelling_groups(docs)) == plain_groups(plain_words(rows))
    assert found_rows(spelling.spelling_groups(odd)) == plain_groups(plain_words(ODD_TEXTS))
    assert spelling.spelling_groups(none).count() == 0
