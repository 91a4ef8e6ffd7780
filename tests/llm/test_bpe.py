import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm.bpe import DEFAULT_VOCABULARY, decode_column, encode_documents, token_report, vocabulary

PARTS = ["the", " The", "ing", "é", "漢字", "\n", "  ", "\t", "\x1c", "\x85", " ", "　", "'s", "'ll", "123", "٣", "$$$", "aaaaaaa", "<|endoftext|>", "<|endof", "🙂", "ⅷ", "́", "x" * 30, " \n ", "thhaed", "_", "‍"]


def test_equals_the_library():
    real, own, rng = Tokenizer.from_file(DEFAULT_VOCABULARY), vocabulary(DEFAULT_VOCABULARY), random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FF), rng.randint(0x4E00, 0x4F00)])) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("abehint ") for _ in range(200)) for _ in range(300)]
    for text, want in zip(texts, real.encode_batch(texts, add_special_tokens=False), strict=True):
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == want.ids, text
        assert own.decode(packed) == real.decode(want.ids, skip_special_tokens=False)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    real = Tokenizer.from_file(DEFAULT_VOCABULARY)
    for r in token_report(docs).collect():
        ids = real.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, "ab " * 50_000, 7), (2, "ab " * 50_000, 7)], "doc_id bigint, text string, n_tokens bigint")
    rows = encode_documents(docs).withColumn("back", decode_column("token_ids")).collect()
    assert [r.n_tokens for r in rows][:2] == [0, 0] and all(r.back == (r.text or "") for r in rows)
    assert encode_documents(docs).columns == ["doc_id", "text", "n_tokens", "token_ids"]
    assert token_report(docs.filter(F.lit(False))).count() == 0
