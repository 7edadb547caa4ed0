"""The pipeline's language stage: what is in no learned language goes, and nothing goes because nothing was learned."""

import random
import zlib

import pytest

import corpus_pipeline
from slotledger.llm import language

from llm.conftest import ODD_TEXTS

GIBBERISH = 10_000_000


def test_gibberish_is_rejected_and_documents_stay(spark, small):
    rng = random.Random(16)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    letters = "bcdfghjklmnpqrstvwxzйщґђѣ漢字ꀀ"
    junk = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 12))) for _ in range(40)) for _ in range(5)]
    junk += ["".join(chr(0xA000 + 7 * i) for i in range(100)), "".join(rng.choice("qxzjkv") for _ in range(300))]
    more = spark.createDataFrame([(GIBBERISH + i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.union(more), small).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("where", ["false", "held"])
def test_nothing_learned_keeps_texts_with_letters(spark, odd, small, where):
    held = language.held_out(language.F.col("doc_id")) if where == "held" else language.F.lit(False)
    docs = odd.withColumn("lang", language.F.when(held, language.F.col("lang")))
    assert where == "false" or any(zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in ODD_TEXTS if i)
    kept = corpus_pipeline.language_id(spark, docs, small).collect()
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted((i or -1, t) for i, t in ODD_TEXTS if letters(t))
