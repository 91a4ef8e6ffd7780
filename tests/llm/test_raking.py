import hashlib

import numpy as np
from pyspark.sql import functions as F
import pytest

from ledgerloom.llm import raking
from ledgerloom.llm.raking import Mix, described, fit, mixed, probabilities, sample


def plain_fit(tokens, targets, rounds=400):
    """Cell by cell."""
    w = {c: v for c, v in np.ndenumerate(tokens) if v > 0}
    for _ in range(rounds):
        for axis, target in enumerate(targets):
            sums = {}
            for c, v in w.items():
                sums[c[axis]] = sums.get(c[axis], 0) + v
            w = {c: v * target[c[axis]] / sums[c[axis]] for c, v in w.items()}
    return w


def test_fit_and_probabilities():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 50, (5, 4, 3)).astype(float)
    targets = [rng.random(n) + 0.1 for n in tokens.shape]
    targets = [t / t.sum() for t in targets]
    w = fit(tokens, targets)
    want = plain_fit(tokens, targets)
    assert all(abs(w[c] - v / sum(want.values())) < 1e-6 for c, v in want.items())
    for axis, t in enumerate(targets):
        assert np.abs(w.sum(axis=tuple(a for a in range(3) if a != axis)) - t).max() < 1e-6
    for share in (0.05, 0.5, 0.9, 1.0):
        p = probabilities(tokens, w, share)
        assert abs((p * tokens).sum() - share * tokens.sum()) < 1e-6 * tokens.sum() and p.max() <= 1
        open_ = (p < 1) & (tokens > 0)
        assert np.ptp((p * tokens / np.where(w > 0, w, 1))[open_]) < 1e-6 * tokens.sum() if open_.any() else True


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixed(docs).collect()
    assert len(rows) == docs.count()
    total, kept = sum(r.tokens for r in rows), sum(r.tokens for r in rows if r.kept)
    assert abs(sum(r.tokens * r.probability for r in rows) / total - raking.SHARE) < 1e-6 and abs(kept / total - raking.SHARE) < 0.05
    for r in rows:
        u = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:12], 16) / 2**48
        assert r.kept == (u < r.probability)
    assert {r.doc_id for r in sample(docs).collect()} == {r.doc_id for r in rows if r.kept}
    assert all(r.tokens == max(1, len(t.split(None))) for r, t in zip(sorted(rows), [x.text for x in docs.orderBy("doc_id").collect()], strict=True) if t.isascii())


def test_edges(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None, None, "a", 1), (None, "", "en", None, 1), (2, "x | y | z " * 30_000, "en", "a", 1), (2, "one two", "fr", "b", 1), (2, "one two", "fr", "b", 1)], "doc_id bigint, text string, lang string, source string, kept int")
    assert mixed(docs).count() == 5 and sample(docs).columns == docs.columns
    assert mixed(docs.limit(0)).count() == 0 and sample(docs.limit(0)).count() == 0
    assert {r.topic for r in described(docs).collect()} == {"empty", "table", "short"}
    monkeypatch.setitem(raking.MOST_LEVELS, "source", 1)
    assert {r.source for r in mixed(docs).collect()} == {"a", "(other)"}
    only = mixed(docs, Mix({"lang": {"en": 1.0}}, share=1.0)).collect()
    assert all(r.probability == (1.0 if r.lang == "en" else 0.0) for r in only)


def test_every_source_keeps_its_level(spark, monkeypatch):
    rows = [(i, "one two", "en", f"s{i}") for i in range(4200)] + [(i, "one two three", "fr" if i % 2 else "en", "big") for i in range(5000, 9000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for mix in (Mix(share=0.5), Mix({"source": {"s4150": 1.0, "big": 1.0}}, share=1.0)):
        got = {r.doc_id: r.probability for r in mixed(docs, mix).collect()}
        assert len(got) == len(rows)
        if mix.targets:
            assert {i for i, p in got.items() if p > 0} == {4150, *range(5000, 9000)}
        else:
            assert len({got[i] for i in range(4200)}) == 1 and got[0] > got[5000]
        with monkeypatch.context() as m:
            m.setattr(raking, "MOST_CELLS", 10)
            m.setattr(raking, "ROUNDS", 3)
            by_table = {r.doc_id: r.probability for r in mixed(docs, mix).collect()}
            m.setattr(raking, "MOST_CELLS", 100_000)
            by_driver = {r.doc_id: r.probability for r in mixed(docs, mix).collect()}
        assert by_table.keys() == by_driver.keys() and all(abs(p - by_driver[i]) < 1e-6 for i, p in by_table.items())


def test_names_do_not_clash(spark):
    rows = [(i, "one two three", "en" if i % 3 else None, "a" if i % 2 else "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    names = ("s_", "l_", "t_", "p_", "topic", "words", "chance", "probability", "tokens", "kept", "a.b")
    wide = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    got = sample(wide, Mix(share=0.5)).collect()
    assert got and got[0].__fields__ == wide.columns and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    assert {r.doc_id for r in got} == {r.doc_id for r in sample(docs, Mix(share=0.5)).collect()}


def test_a_folded_target_is_an_error(spark, monkeypatch):
    monkeypatch.setitem(raking.MOST_LEVELS, "source", 1)
    docs = spark.createDataFrame([(1, "one", "en", "a"), (2, "two two", "en", "b")], "doc_id bigint, text string, lang string, source string")
    with pytest.raises(ValueError, match="MOST_LEVELS"):
        sample(docs, Mix({"source": {"a": 1.0}}))
