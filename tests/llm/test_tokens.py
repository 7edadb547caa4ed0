"""Counts, files and chat formatting against the tokenizer library itself."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from slotledger.llm import chat, token_counts, token_files, tokens
from slotledger.llm.common import read_table

from conftest import rows  # noqa: E402
from llm.conftest import ODD_TEXTS

LIBRARY = Tokenizer.from_file(tokens.TOKENIZER_PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_chunks_give_the_library_ids():
    rng = random.Random(1)
    letters = ["a", "B", "é", "ß", "1", "²", "'s", "'", ",", "!!", " ", "  ", "\n", " \n", "\n ", "\t", " ", " ", "漢", "🙂", "ɐ", "<|endoftext|>", "\x1c", "\x85"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for text in [*texts, *(t or "" for _, t in ODD_TEXTS)]:
        assert np.frombuffer(tokens.text_ids(tokens.TOKENIZER_PATH, text), "<u4").tolist() == library_ids(text), repr(text)


def test_every_vocabulary_piece_encodes_alike():
    letters = tokens.byte_letters()
    for piece in LIBRARY.get_vocab():
        try:
            text = bytes(letters[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        for around in (text, f"a{text}b", f"a {text} b"):
            assert np.frombuffer(tokens.text_ids(tokens.TOKENIZER_PATH, around), "<u4").tolist() == library_ids(around), repr(around)


def test_whole_documents_give_the_library_ids(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()
    spaced = [(r.text or "").replace(". ", ".  ").replace(", ", ",\n ") for r in docs]  # adjacent white space in each
    for text in [*(r.text or "" for r in docs), *spaced]:
        assert np.frombuffer(tokens.text_ids(tokens.TOKENIZER_PATH, text), "<u4").tolist() == library_ids(text)


def test_chunks_are_cut_next_to_other_white_space_too():
    assert tokens.chunks("a b  c d\n e f ") == ["a", "b  c", "d\n e", "f "]
    assert tokens.chunks(" a b") == ["", "a", "b"]


def test_memory_starts_over_when_full():
    small = tokens.Remembered(tokens.TOKENIZER_PATH, len, {"the": 1}, most=2)
    long = "x1" * tokens.LONGEST_KEPT
    for w in ("cat", "dog", "bird", "the", "cat", long):
        assert small.values_of([w, w]) == [len(library_ids(" " + w))] * 2
        assert len(small) <= 3 and long not in small
    assert small.values_of([]) == []


def test_counts(odd, none):
    found = rows(token_counts.token_counts(odd, limit=20))
    want = [(i, len((t or "").encode()), len(library_ids(t)), len(library_ids(t)) > 20) for i, t in ODD_TEXTS]
    assert found == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert token_counts.token_counts(none).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**24, 2**32 - 1, 7], list(range(0, 3000, 7)) * 3])
def test_addressable_codes(ids):
    levels, bitmaps, ranks = token_files.encode_block(np.array(ids, np.uint32))
    assert token_files.decode_block(levels, bitmaps).tolist() == ids
    assert [token_files.id_at(levels, bitmaps, ranks, i) for i in range(len(ids))] == ids


def test_files_hold_every_document(spark, odd, none, tmp_path):
    token_files.write_tokens(odd, f"{tmp_path}/t", block_tokens=50)
    blocks = token_files.read_blocks(spark, f"{tmp_path}/t")
    found = [tuple(r) for r in token_files.documents_of(blocks).orderBy("start").collect()]
    start, want = 0, []
    by_id = {}
    for i, t in ODD_TEXTS:
        by_id.setdefault(i, []).append(t)
    assert [r[0] for r in found] == sorted((i for i, _ in ODD_TEXTS), key=lambda i: (i is not None, i or 0))
    for doc_id, at, n, crc in found:
        assert at == start
        start += n
        ids = [[*library_ids(t), 0] for t in by_id[doc_id]]
        assert (n, crc) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids]
        want.append(n)
    assert start == sum(len(library_ids(t)) + 1 for _, t in ODD_TEXTS)
    wanted = blocks.selectExpr("shard", "block", "explode(array(0L, n_tokens - 1, n_tokens)) as offset")
    ids = {(r.shard, r.block): token_files.decode_block(r.levels, r.bitmaps).tolist() for r in blocks.collect()}
    for r in token_files.tokens_at(blocks, wanted).collect():
        held = ids[r.shard, r.block]
        assert r.id == (held[r.offset] if r.offset < len(held) else None)
    assert token_files.token_digest(none).count() == 0


# ---- chat -------------------------------------------------------------------------------------------------------


def test_escapes_are_undone():
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice(["<", "|", "\\", "im_end", ">", "a"]) for _ in range(rng.randrange(12)))
        hidden = chat.escape(text)
        assert "<|" not in hidden and chat.unescape(hidden) == text


def test_conversations_come_back(spark):
    turns = [
        (1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<\\|x|> <|im_start|>"), (1, 2, "assistant", "more"),
        (2, 1, "assistant", None), (2, None, "user", ""), (2, 0, None, "no role\n"), (3, 0, "odd <|im_sep|>\nrole", "text"),
        (None, 0, "user", "nobody"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (5, 0, "assistant", "long " * 5000),
    ]
    table = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, part int")
    found = {r.conv_id: r for r in chat.chat_digest(table).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        learned = "".join(x or "" for _, _, r, x in own if r == "assistant")
        marks = sum(map(len, chat.MARKS))
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r.formatted_chars == sum(marks + len(chat.escape(a or "")) + len(chat.escape(b or "")) for _, _, a, b in own)
    assert len(found) == 6
    assert chat.chat_digest(table.where("false")).count() == 0


def test_parts_are_cut_between_turns(spark, tmp_path):
    table = spark.createDataFrame([(1, i, "assistant", f"turn number {i}") for i in range(50)], "conv_id long, turn long, role string, text string")
    chat.format_conversations(table, f"{tmp_path}/c", part_tokens=30)
    assert spark.read.parquet(f"{tmp_path}/c").count() > 5
    row = chat.read_conversations(spark, f"{tmp_path}/c").first()
    assert row.n_turns == 50 and row.loss_sha256 == hashlib.sha256("".join(f"turn number {i}" for i in range(50)).encode()).hexdigest()


def test_a_long_conversation_is_dealt_to_many_tasks(spark, tmp_path):
    texts = [chr(97 + i % 26) + " b" * (i % 7) for i in range(600)]
    turns = [(None, i // 3, "assistant" if i % 2 else "user", texts[i]) for i in range(600)]  # ties in turn, other texts
    turns += [(7, None, "user", t) for t in texts[:200]]
    random.Random(3).shuffle(turns)
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(6)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # else so small a table is one task
    try:
        chat.format_conversations(table, f"{tmp_path}/c")
    finally:
        spark.conf.set(key, before)
    parts = spark.read.parquet(f"{tmp_path}/c")
    assert parts.where("conv_id is null").select("stretch").distinct().count() > 1
    found = {r.conv_id: r for r in chat.read_conversations(spark, f"{tmp_path}/c").collect()}
    for conv in (None, 7):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] or 0, t[2], t[3]))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        learned = "".join(x for _, _, r, x in own if r == "assistant")
        assert (found[conv].n_turns, found[conv].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert found[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_chunks_not_remembered_are_one_text_for_the_library(monkeypatch):
    """Each chunk has the ids it has alone, and a word is not encoded again for the marks behind it or after a full memory."""
    rng, asked = random.Random(3), []
    letters = ["a", "Bc", "é", "1", "'s", "'", ",", "!!", "\n", "\t", "\xa0", "漢", "<|endoftext|>", "\x1c", "\x85", "."]
    parts = list({"".join(rng.choice(letters) for _ in range(rng.randrange(6))) for _ in range(2000)}) + ["two words", "word.", "word,", "word"]
    whole = tokens.encode_all
    monkeypatch.setattr(tokens, "encode_all", lambda path, texts: asked.extend(texts) or whole(path, texts))
    memory = tokens.Remembered(tokens.TOKENIZER_PATH, tokens.as_words, most=len(parts) + 10)
    for _ in range(2):
        for part, value in zip(parts, memory.values_of(parts), strict=True):
            assert np.frombuffer(value, "<u4").tolist() == library_ids(" " + part), repr(part)
    asked.clear()
    tokens.Remembered(tokens.TOKENIZER_PATH, len).values_of([f"word{i}" for i in range(500)])
    assert len(asked) == 1
    small = tokens.Remembered(tokens.TOKENIZER_PATH, len, most=2)
    for w in ("cat", "dog", "bird", "cat", "cat."):
        asked.clear()
        assert small.values_of([w]) == [len(library_ids(" " + w))]
    assert " cat" not in asked
