import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import langid
from ledgerloom.llm.langid import ALL_CHARS, Languages, language_report, learn, phrases, suffix_automaton


def brute_phrases(text, sample):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        n, i = n + 1, i + k
    return n


def test_cross_parsing_equals_search():
    rng = random.Random(5)
    for _ in range(400):
        sample = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))
        assert phrases(text, suffix_automaton(sample)) == brute_phrases(text, sample), (sample, text)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "12 .,", "en", 1), (5, "the cat " * 20_000, "en", 1), (6, "le chat dort", "fr", 1), (6, "le chat dort", "fr", 1), (None, "the", None, 1)], "doc_id bigint, text string, lang string, score int")
    rows = {(r.doc_id, r.lang_pred) for r in language_report(docs).collect()}
    assert (1, "und") in rows and (2, "und") in rows and {x for _, x in rows} <= {"und", "en", "fr"}
    assert language_report(docs.filter(F.lit(False))).count() == 0
    assert Languages({}).predict("word") == ("und", 0.0) and Languages({"b": "xy", "a": "xy"}).predict("xy")[0] == "a"


def test_every_label_is_learned(spark):
    word = lambda i: "".join(chr(0x4E00 + 40 * i + j) for j in range(30))
    rows = [(100 * i + k, f"{word(i)} {word(i)[k:]}", f"l{i}") for i in range(40) for k in range(3 if i else 1)] + [(None, word(50), "no id"), (5_000, "free text", None)]
    docs = spark.createDataFrame(rows, "k bigint, text string, lang string")
    found = learn(docs, F.lit(True), key="k")
    assert set(found.samples) == {f"l{i}" for i in range(40)} | {"no id"}
    assert all(found.predict(text)[0] == lang for _, text, lang in rows if lang)
    assert all(len(x) <= ALL_CHARS // 41 for x in found.samples.values())


def test_repeated_rows_are_one_sample(spark, monkeypatch):
    rows = [(7, "the cat sat", "en")] * 3000 + [(8, "a dog ran off", "en"), (9, "le chat dort", "fr")]
    docs = spark.createDataFrame(rows, "k bigint, text string, lang string").withColumns({n: F.lit(1) for n in ("l", "h", "t", "place")})
    found = learn(docs, F.lit(True), key="k")
    assert sorted(found.samples["en"].split("\n")[:2]) == ["a dog ran off", "the cat sat"] and len(found.samples["en"]) < 40
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        learn(docs, F.lit(True), key="k")


def test_report_equals_brute_force(spark):
    """Every prediction and score from the samples by plain searches, ties to the first language by name."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars < 1500")
    samples = learn(docs, langid.id_remainder("k", 4) != 2).samples
    short = {lang: text[:3000] for lang, text in samples.items()}
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: None, -2: "", -3: "12 - 3", -4: "ß"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.p for r in rows.select("doc_id", langid.predict_column(rows, Languages(short)).alias("p")).collect()}
    for i, text in texts.items():
        if text is None or not any(c.isalpha() for c in text):
            assert tuple(got[i]) == ("und", 0.0)
            continue
        folded = " ".join(text.lower().split())
        bits = {lang: brute_phrases(folded, sample) * math.log2(len(sample) + 2) for lang, sample in short.items()}
        best = min(bits.values())
        assert got[i].lang_pred == min(lang for lang, b in bits.items() if b == best)
        assert abs(got[i].score - 1 / sum(2 ** -min(60.0, b - best) for b in bits.values())) < 1e-9
