"""The filter audit against the filters applied one document at a time."""

import re
from collections import Counter
from itertools import permutations

from slotledger.llm import filter_audit

from llm.conftest import ODD_TEXTS

LETTERS = "ABCDE"


def plain_fails(rows):
    """For each row the set of letters it fails."""
    firsts = {}
    for i, text, _ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        first = firsts.get(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": first is not None and (i is None or i > first),
        }
        out.append({k for k, v in fails.items() if v})
    return out


def plain_audit(rows, labels):
    fails, out = plain_fails(rows), {}
    for order in map("".join, permutations(LETTERS)):
        for part in {r[2] or "" for r in rows}:
            for step in range(1, 6):
                out[part, order, step] = Counter()
        for (i, _, part), bad in zip(rows, fails):
            alive = True
            for step, letter in enumerate(order, 1):
                c = out[part or "", order, step]
                c["unique_fails"] += bad == {letter}
                if letter not in bad:
                    c["kept"] += alive
                    continue
                c["removed" if alive else "redundant"] += 1
                c["good_lost"] += alive and labels.get(i, (0, 0))[0]
                c["toxic_lost"] += alive and labels.get(i, (0, 0))[1]
                alive = False
    by_letter = Counter()
    for (part, order, step), c in out.items():
        by_letter[part, order[step - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((p, o, s, *(int(c[n]) for n in names), by_letter[p, o[s - 1]]) for (p, o, s), c in out.items())


def found_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_odd_rows(spark, odd, none):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (10, 1, 1), (None, 1, 1), (99, 1, 1), (13, None, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [(i, t, "en" if i and i % 2 else None) for i, t in ODD_TEXTS]
    assert found_rows(filter_audit.filter_audit(odd, table)) == plain_audit(rows, {1: (1, 0), 2: (1, 1), 10: (1, 1)})
    assert filter_audit.filter_audit(none, table).count() == 0
    assert filter_audit.filter_audit(odd, table.where("false")).count() == 2 * 600


def test_documents(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    rows += [(i + 10**6, t, "xx") for i, t, _ in rows[:50]] + [(None, rows[0][1], "xx"), (-1, "Some CAPS # " * 300, "xx")]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    want = plain_audit(rows, known)
    assert found_rows(filter_audit.filter_audit(more, labels)) == want
    assert all(any(r[k] for r in want) for k in range(3, 10))


def test_fields_of_many_documents_do_not_run_over():
    wide = filter_audit.wide_integers()
    total = sum(w * (1 << 56) for w in wide)
    ones = sum(filter_audit.unpacked(w) for w in wide)
    assert (filter_audit.unpacked(total) == ones << 56).all()
    kept, removed = (ones[: filter_audit.STEPS * 5].reshape(-1, 5)[:, k] for k in (0, 1))
    last = removed.reshape(120, 5).sum(axis=1) + kept.reshape(120, 5)[:, -1]
    assert (last == filter_audit.CLASSES).all()


def test_more_parts_than_a_task_holds(spark):
    n = 3 * filter_audit.MOST_PARTS
    docs = spark.range(2 * n).select(
        filter_audit.F.col("id").alias("doc_id"), filter_audit.F.lit("x").alias("text"), filter_audit.F.concat(filter_audit.F.lit("p"), (filter_audit.F.col("id") % n).cast("string")).alias("lang")
    )
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = filter_audit.filter_audit(docs, labels).where("filter_order = 'ABCDE' and step = 1").collect()
    assert len(found) == n and all((r.kept, r.removed) == (0, 2) for r in found)
