import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(12_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
ODD_TEXTS = [
    (1, "The cat sat on the mat, and the cat sat on the mat again."),
    (2, "The cat sat on the mat, and the cat sat on the mat again."),
    (2, "The cat sat on the mat, and the cat sat on the mat again."),
    (2, "another text under one id"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "one"),
    (7, "two words"),
    (8, f"begin {PASSAGE} end"),
    (9, f"{PASSAGE} other end\n\n  with   spaces \n and\r\nlines "),
    (10, LONG),
    (None, "no id here, but words"),
    (None, None),
    (11, "Ünïcödé ÀÉ 漢字 emoji 🙂 ١٢٣ <|endoftext|> <|im_end|>"),
    (12, "1234 5678 !!! ???"),
    (13, "be " * 100),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    rows = [(i, t, "en" if i and i % 2 else None, None if i == 6 else f"s{(i or 0) % 3}", 0, 1, 2, "x", 3) for i, t in ODD_TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, k int, h int, row string, fp int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
