import corpus_pipeline
from ledgerloom.llm.bpe import DEFAULT_VOCABULARY
from ledgerloom.llm.common import id_remainder
from ledgerloom.llm.raking import mixed
from ledgerloom.llm.toxicity import train
from test_partenum import plain_set
from test_secrets import brute
from tokenizers import Tokenizer

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{D}/labels.parquet")
    model = train(docs, labels, id_remainder("doc_id", 5) != 0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        if name == "mixing":
            chosen = {r.doc_id for r in mixed(docs).collect() if r.kept}
        stage(spark, docs, D).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in docs.collect()}
        if name != "encoding":
            assert docs.columns == columns
        if name == "toxicity":
            assert set(after) == {i for i, r in before.items() if model.score(r.text) < 0.5}
        elif name == "near_copies":
            sets, group = {i: plain_set(r.text, 5) for i, r in before.items()}, {i: i for i in before}
            for i in sorted(sets):
                for j in sorted(sets):
                    if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0:
                        low, high = sorted((group[i], group[j]))
                        group = {d: low if g == high else g for d, g in group.items()}
            assert set(after) == set(group.values())
        elif name == "secrets":
            assert set(after) == set(before)
            for i, r in after.items():
                spans, text, at = brute(before[i].text), [], 0
                for s, e, _ in spans:
                    if s >= at:
                        text += [before[i].text[at:s], "[SECRET]"]
                    at = max(at, e)
                assert r.text == "".join([*text, before[i].text[at:]]) and r.n_chars == len(r.text)
        elif name == "mixing":
            assert set(after) == chosen
        else:
            real = Tokenizer.from_file(DEFAULT_VOCABULARY)
            assert all(r.token_ids == real.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.token_ids) for r in after.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, D).collect()} == set(after)
