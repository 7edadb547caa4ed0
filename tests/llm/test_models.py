"""Language, quality and the mix: accuracy on held-out rows, and rules that any result must keep."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from slotledger.llm import language, mixing, quality
from slotledger.llm.common import crc_mod

from llm.conftest import ODD_TEXTS

MEDIUM = "/root/testdata/sf0.01"


def test_forward_sums_all_segmentations():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=language.VOCABULARY)
    hashes, longest = language.vocabulary(language.VOCABULARY)
    known = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
            continue
        h = language._prefix_hashes(language._codes([piece]))[0, -1]
        at = int(np.searchsorted(hashes, h))
        if at < len(hashes) and hashes[at] == h:
            known[piece] = at
    assert max(map(len, known)) == longest
    rng = np.random.default_rng(8)
    p = rng.random((len(hashes), 2)) / 1000

    def brute(text):
        if not text:
            return np.ones(2)
        total = np.zeros(2)
        for n in range(1, len(text) + 1):
            piece = text[:n]
            share = p[known[piece]] if piece in known else np.full(2, language.UNKNOWN) if n == 1 else None
            if share is not None:
                total += share * brute(text[n:])
        return total

    words = ["the", "house", "über", "q漢x", "a"]
    found = language.word_logs(language.VOCABULARY, words, language._padded(p))
    for w, row in zip(words, found):
        assert np.allclose(row, np.log(brute(language.MARK + w)))
    counts = language.expected_pieces(language.VOCABULARY, ["the"], np.array([2.0]), language._padded(p)[:, :1])
    lengths = {i: len(x) for x, i in known.items()}
    assert math.isclose(sum(lengths[i] * counts[i] for i in np.flatnonzero(counts)), 2 * len(language.MARK + "the"), rel_tol=1e-4)


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    return language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()


def test_languages_of_held_out_documents(predicted):
    held = [r for r in predicted if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in predicted)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in predicted)


def test_languages_of_odd_rows(spark, odd, none):
    found = Counter((r.doc_id, r.lang_pred) for r in language.identify(odd).collect())
    assert sum(found.values()) == len(ODD_TEXTS)
    for doc_id in (3, 4, 5, 12):
        assert found[doc_id, "und"] == 1
    assert found[1, "en"] == 1
    assert language.identify(none).count() == 0
    unlabelled = language.identify(odd.withColumn("lang", language.F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


# ---- quality ----------------------------------------------------------------------------------------------------


def auc(scores, truth):
    order = np.argsort(np.argsort(scores)) + 1
    good = np.array(truth) == 1
    n, m = good.sum(), (~good).sum()
    return (order[good].sum() - n * (n + 1) / 2) / (n * m)


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert auc([r.score for r in held], [r.quality for r in held]) > 0.95
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", quality.F.when(crc_mod(labels["doc_id"], 5) == 0, 1 - labels["quality"]).otherwise(labels["quality"]))
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (7, None), (None, 1), (8, 0), (9, 1)], "doc_id long, quality int")
    found = quality.quality_scores(odd, labels).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in ODD_TEXTS)
    assert all(0 <= r.score <= 1 for r in found)
    assert quality.quality_scores(none, labels).count() == 0
    flat = quality.quality_scores(odd, labels.where("false")).collect()
    assert {r.score for r in flat} == {0.5}


def test_one_row_of_each_chosen_id_is_trained_on(spark, monkeypatch):
    docs = [(7, f"good text number {i}") for i in range(3000)] + [(i, f"text number {i}") for i in range(100, 160)]
    labels = spark.createDataFrame([(7, 1), (101, 0)], "doc_id long, quality int")
    brought = []
    vectors = quality._vectors

    def counted(rows, extra):
        brought.append(rows.count())
        return vectors(rows, extra)

    monkeypatch.setattr(quality, "_vectors", counted)
    quality.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels, lambda key: crc_mod(key, 5) == 0, train_rows=20)
    assert 0 < brought[0] <= 40


@pytest.mark.parametrize("seed, prior", [(1, 0.3), (2, 0.3), (3, 0.95), (4, 0.95)])
def test_steps_follow_the_non_negative_risk(seed, prior):
    rng = np.random.default_rng(seed)
    p, u, w = rng.normal(size=(7, 4)), rng.normal(size=(9, 4)) - 2 * (seed % 2), rng.normal(size=4)

    def loss(z):
        return sum(math.log1p(math.exp(-x)) for x in z) / len(z)

    def bad(w):
        return loss(-(u @ w)) - prior * loss(-(p @ w))

    def objective(w):
        return prior * loss(p @ w) + bad(w)

    aim = objective if bad(w) >= 0 else lambda w: -bad(w)
    steps = 1e-6 * np.eye(4)
    assert np.allclose(quality.risk_step(w, p, u, prior), [(aim(w + s) - aim(w - s)) / 2e-6 for s in steps], atol=1e-6)


def test_best_cut_by_brute_force():
    rng = np.random.default_rng(13)
    good, mixed = rng.normal(1, 1, 60).round(1), rng.normal(0, 1, 80).round(1)
    spread = sum(math.sqrt(math.log(40) / 2 / n) for n in (60, 80))
    ratios = [((mixed >= c).mean(), (good >= c).mean()) for c in good]
    best = min(ratios, key=lambda r: (r[0] + 1.01 * spread) / r[1])
    assert math.isclose(quality.best_bin(good, mixed), min(1, best[0] / best[1]))


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_from_positives_and_unlabelled_alone(share):
    rng = np.random.default_rng(14)
    good, bad = rng.normal(1, 0.5, (3000, quality.WIDTH)), rng.normal(-1, 0.5, (2000, quality.WIDTH))
    good[:, 0] = bad[:, 0] = 1.0
    n = int(2000 * share)
    mixed = np.concatenate([good[1000 : 1000 + n], bad[: 2000 - n]])
    assert abs(quality.class_prior(good[:1000], rng.permutation(mixed)) - share) < 0.06
    assert quality.class_prior(good[:1], mixed) == 0.5


def test_bad_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()} for x in (labels, labels.where("quality = 1")))
    assert a == b


def test_non_negative_risk_separates():
    rng = np.random.default_rng(9)
    good, bad = rng.normal(1, 0.4, (400, quality.WIDTH)), rng.normal(-1, 0.4, (400, quality.WIDTH))
    good[:, 0] = bad[:, 0] = 1.0
    w, mean, scale = quality.train(good[:200], np.concatenate([good[200:], bad[:100]]), 2 / 3)
    assert (((good - mean) / scale) @ w > 0).mean() > 0.95 and (((bad - mean) / scale) @ w < 0).mean() > 0.95


# ---- the mix ----------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("leaf_rows,fan", [(3, 2), (7, 100), (5_000, 1_000)])
def test_mix_meets_its_targets(spark, leaf_rows, fan):
    rng = np.random.default_rng(10)
    rows = [(i, f"s{i % 5}" if i % 6 else None, int(rng.integers(0, 60)) * (1 + 9 * (i % 5 == 3))) for i in range(600)]
    rows += [(900, "one", 50), (901, "nothing", 0), (None, "s1", 10), (7, "s2", rows[7][2])]
    table = spark.createDataFrame(rows, "key long, source string, size long")
    mixed = mixing.mix(table, leaf_rows=leaf_rows, fan=fan).collect()
    assert Counter((r.key, r.source, r.size) for r in mixed) == Counter(rows)
    sizes, taken, target, largest = Counter(), Counter(), {}, defaultdict(int)
    for r in mixed:
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.copies in (0, 1, 2)
    for source, want in plain_targets(dict(sizes)).items():
        assert math.isclose(target[source], want, rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[source] - want) <= largest[source] / 2 + 1e-6
    again = mixing.mix(table.repartition(7), leaf_rows=leaf_rows, fan=fan).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, mixed))


def test_pivot_keeps_expectations():
    runs = 4000
    sizes, chances = [5, 3, 8, 2, 6], [0.3, 0.5, 0.25, 0.9, 0.4]
    seen = np.zeros(5)
    for k in range(runs):
        taken, held, chance = mixing.pivot([f"{k}-{i}" for i in range(5)], sizes, chances, 0)
        open_ = [i for i, t in enumerate(taken) if t is None]
        assert open_ == ([] if held is None else [held])
        values = [chance if t is None else t for t in taken]
        assert math.isclose(sum(s * v for s, v in zip(sizes, values)), sum(s * c for s, c in zip(sizes, chances)), rel_tol=1e-6)
        seen += values
    assert np.allclose(seen / runs, chances, atol=0.03)


def test_mix_of_odd_rows(odd, none):
    found = mixing.document_mix(odd).collect()
    assert len(found) == len(ODD_TEXTS)
    taken = mixing.take_mix(odd)
    assert taken.columns == odd.columns
    assert Counter(r.doc_id for r in taken.collect()) == Counter({i: n for i in {r.doc_id for r in found} if (n := sum(r.copies for r in found if r.doc_id == i))})
    assert mixing.document_mix(none).count() == 0 and mixing.take_mix(none).count() == 0


# ---- long runs of unknown letters -------------------------------------------------------------------------------

UNKNOWN_RUN = "".join(chr(0xA000 + 7 * i) for i in range(100))  # Yi syllables


def test_unknown_runs_have_finite_logs():
    n = len(language.vocabulary(language.VOCABULARY)[0])
    p = language._padded(np.full((n, 2), 1 / n))
    assert language.words_of(UNKNOWN_RUN) == [UNKNOWN_RUN]
    words = [UNKNOWN_RUN[:48]]
    logs = language.word_logs(language.VOCABULARY, words, p)
    known = language.word_logs(language.VOCABULARY, [words[0][:20], words[0][:21]], p)
    a_letter = known[1] - known[0]  # one more unknown letter
    assert np.allclose(logs[0], known[0] + 28 * a_letter) and np.allclose(a_letter, math.log(language.UNKNOWN))
    mixed = words[0][:47] + "the"
    counts = language.expected_pieces(language.VOCABULARY, [words[0], mixed[:48]], np.array([2.0, 3.0]), p[:, :1])
    assert np.isfinite(counts).all() and math.isclose(counts.max(), 5.0, rel_tol=1e-3)  # the word mark of both


def test_long_words_take_the_same_sums(monkeypatch):
    path = language.VOCABULARY
    n = len(language.vocabulary(path)[0])
    rng = np.random.default_rng(11)
    p = language._padded(rng.random((n, 3)) / n)
    words = ["internationalisation" * 2, "überall", "a", UNKNOWN_RUN[:45], "the" + UNKNOWN_RUN[:30] + "house", "donaudampfschifffahrt"]
    counts = np.array([2.0, 1.0, 5.0, 3.0, 1.0, 4.0])
    logs, seen = language.word_logs(path, words, p), language.expected_pieces(path, words, counts, p[:, :1])
    monkeypatch.setattr(language, "LATTICE_LETTERS", 0)
    for places in (4_096, 7):
        monkeypatch.setattr(language, "PLACES_AT_ONCE", places)
        assert np.allclose(language.word_logs(path, words, p), logs, rtol=1e-12)
        assert np.allclose(language.expected_pieces(path, words, counts, p[:, :1]), seen, rtol=1e-9, atol=1e-300)


def test_a_word_of_any_length_is_one_word():
    path = language.VOCABULARY
    n = len(language.vocabulary(path)[0])
    p = language._padded(np.random.default_rng(12).random((n, 2)) / n)
    memory = language.Memory(path, p)
    long = "thehouseofthecat" * 2000
    found = memory.score([["the", long, long], ["the"], [long], []])
    alone = language.word_logs(path, ["the", long], p)
    assert np.isfinite(found).all() and np.allclose(found, [alone[0] + 2 * alone[1], alone[0], alone[1], [0, 0]])
    assert set(memory.rows) == {"the"}
    seen = language.expected_pieces(path, [long], np.array([1.0]), p[:, :1])
    cut = language.expected_pieces(path, ["thehouseofthecat" * 2], np.array([1.0]), p[:, :1])
    assert 900 * cut.sum() < seen.sum() < 1100 * cut.sum()


def test_a_repeated_id_is_one_training_document(spark):
    docs = [(7, f"text {i}", "en") for i in range(500)] + [(i, f"other text {i}", "en") for i in range(100, 150)] + [(None, "x", "en")]
    chosen = language.training_sample(spark.createDataFrame(docs, "doc_id long, text string, lang string"), 40).collect()
    assert len(chosen) == len({r.doc_id for r in chosen}) == 40


def test_unknown_runs_leave_other_documents_alone(spark):
    docs = [(i, f"the house of the {w} and the garden", "en") for i, w in enumerate(("cat", "dog", "bird", "tree") * 3)]
    docs += [(100 + i, f"das Haus von dem {w} und der Garten", "de") for i, w in enumerate(("Kater", "Hund", "Vogel", "Baum") * 3)]
    asked = [(200, f"{UNKNOWN_RUN} the house of the cat and the garden", None)]
    trained = next(i for i in range(300, 400) if zlib.crc32(str(i).encode()) % 4 != 2)
    schema = "doc_id long, text string, lang string"
    plain = {r.doc_id: r for r in language.identify(spark.createDataFrame(docs, schema)).collect()}
    for more in (asked, [*asked, (trained, f"{UNKNOWN_RUN} the house", "en")]):
        found = {r.doc_id: r for r in language.identify(spark.createDataFrame(docs + more, schema)).collect()}
        assert found[200].lang_pred == "en" and all(0 <= r.score <= 1 for r in found.values())
        assert {i: r.lang_pred for i, r in plain.items()} == {i: found[i].lang_pred for i in plain}
        assert all(math.isclose(found[i].score, plain[i].score, abs_tol=1e-3 if len(more) > 1 else 1e-12) for i in plain)
