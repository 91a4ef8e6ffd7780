"""The stages, one after the other, on rows that are null, empty, very long, repeated, or have columns with clashing names."""

import corpus_pipeline

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, s_ string, p_ double, row string, sid bigint"


def row(i, text, lang="en", source="src1", extra="x"):
    return (i, text, lang, source, len(text or ""), extra, 0.5, extra, 7)


LONG = " ".join(f"w{i}" for i in range(200_000))
PLAIN = "the river runs past the old mill and the garden behind it towards the sea"
ROWS = [
    row(1, None), row(2, ""), row(3, " \t\n"), row(4, LONG), row(5, LONG), row(6, PLAIN), row(6, PLAIN), row(6, PLAIN, extra="y"), row(6, PLAIN + " password = abcdef123"),
    row(None, "one text without an id that is like no other text here at all"), row(7, "한국어 문장 하나", None, None, None), (8, None, None, None, None, None, None, None, None),
]


def staged(spark, docs, tmp_path):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        stage(spark, docs, D).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns[: len(before)] == before, name
        yield name, docs.collect()


def test_edges(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = dict(staged(spark, docs, tmp_path))
    assert len(got["toxicity"]) == len(ROWS)
    texts = [r.text for r in got["near_copies"]]
    assert texts.count(LONG) == 1 and texts.count(PLAIN) == 1 and texts.count("한국어 문장 하나") == 1
    assert texts.count(None) == 2 and texts.count("") == 1 and texts.count(" \t\n") == 1  # rows without a word are like no other
    assert [r.doc_id for r in got["near_copies"] if r.text == LONG] == [4]
    assert len(got["secrets"]) == len(got["near_copies"]) and not any("abcdef123" in (r.text or "") for r in got["secrets"])
    assert {(r.doc_id, r.text) for r in got["encoding"]} == {(r.doc_id, r.text) for r in got["mixing"]} <= {(r.doc_id, r.text) for r in got["secrets"]}
    assert all(r.s_ in ("x", "y", None) and r.p_ in (0.5, None) and r.sid in (7, None) for r in got["encoding"])


def test_empty(spark, tmp_path):
    for _, rows in staged(spark, spark.createDataFrame([], SCHEMA), tmp_path):
        assert rows == []
