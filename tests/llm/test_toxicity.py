import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import toxicity
from ledgerloom.llm.common import id_remainder


def dense_ftrl(samples, labels, alpha, beta, l1, l2, rounds, seed, width):
    """The same learner, one coordinate after the other."""
    z, n, order = {}, {}, np.random.default_rng(seed)

    def weight(i):
        zi, pull = z.get(i, 0.0), 0.0 if i == width else l1
        return 0.0 if abs(zi) <= pull else -(zi - np.sign(zi) * pull) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    for _ in range(rounds):
        for k in order.permutation(len(samples)):
            at = [*samples[k], width]
            w = [weight(i) for i in at]
            g = 1 / (1 + np.exp(-np.clip(sum(w), -30, 30))) - labels[k]
            for i, wi in zip(at, w, strict=True):
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * wi
                n[i] = old + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_equals_coordinatewise():
    texts = ["you fool", "good day", "you utter fool", "a good meal", "fool of a day", "good good day"] * 3
    y = np.array([1, 0, 1, 0, 1, 0] * 3)
    samples = [np.unique(toxicity.slots(t)) for t in texts]
    got = toxicity.ftrl(samples, y, np.ones(len(y)), l1=0.5, rounds=3)
    want = dense_ftrl(samples, y, 1.0, 1.0, 0.5, 0.5, 3, 1, 1 << toxicity.BITS)
    bias = want.pop(1 << toxicity.BITS)
    assert abs(bias - got.bias) < 1e-9 and set(want) == set(got.slot.tolist())
    assert all(abs(want[i] - w) < 1e-5 for i, w in zip(got.slot.tolist(), got.weight.tolist(), strict=True))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = labels.join(docs, "doc_id").select("doc_id", "text")
    rows = toxicity.toxicity_report(known, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.01 * len(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "word " * 50_000, 9), (2, "", 9)], "doc_id bigint, text string, score bigint")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id bigint, toxic int")
    rows = toxicity.toxicity_report(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.train(docs, labels.limit(0), id_remainder("doc_id", 5) != 0)
    assert none.bias == 0 and toxicity.drop_toxic(docs, none).columns == docs.columns
    assert toxicity.toxicity_report(docs.filter(F.lit(False)), labels).count() == 0


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_CHARS", 100)
    learned = []
    monkeypatch.setattr(toxicity, "ftrl", lambda samples, y, weight: learned.extend(y) or toxicity.Weights(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0))
    docs = spark.createDataFrame([(1, "bad word")] * 3000 + [(i, "good " * 8) for i in range(2, 40)], "doc_id bigint, text string").withColumns({n: F.lit(1) for n in ("y", "t", "at", "sum")})
    labels = spark.createDataFrame([(1, 1), *((i, 0) for i in range(2, 40))], "doc_id bigint, toxic int")
    toxicity.train(docs, labels, F.lit(True))
    assert sorted(learned) == [0, 0, 1]


def test_a_long_text_takes_no_label(spark):
    """One text beyond the sample's characters: the others are learned, and alone it is learned itself."""
    rng = np.random.default_rng(3)
    word = lambda base: " ".join(f"{base}{rng.integers(30)}" for _ in range(12))
    letters = lambda t: t.translate(str.maketrans("0123456789", "abcdefghij"))
    rows = [(i, letters(word("foul" if i % 2 else "fair"))) for i in range(400)]
    long = letters(word("foul")) + " " + "foul " * 1_700_000
    labels = spark.createDataFrame([(i, i % 2) for i in range(401)] + [(401, 1)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([*rows, (401, long)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert all(got[i].predicted == i % 2 for i in range(400))
    alone = toxicity.train(docs.filter("doc_id = 401 or doc_id % 2 = 0"), labels, F.lit(True))
    assert len(alone.slot) or alone.bias != 0


def test_scores_equal_the_plain_sum(spark):
    """The report's score is the bias and the weights of a text's distinct features, as the docstring lists them."""
    import math
    import re

    import xxhash

    mask = (1 << 64) - 1

    def features(text):
        words = re.findall(r"[^\W\d_]+", text.lower())
        full = [xxhash.xxh3_64_intdigest(w.encode()) >> toxicity.BITS << toxicity.BITS for w in words]
        stems = [xxhash.xxh3_64_intdigest(("\n" + w[: toxicity.STEM]).encode()) >> 64 - toxicity.BITS for w in words]
        one, two = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
        hashes = [h * one & mask for h in full]
        hashes += [((a * one & mask) ^ b) * two & mask for a, b in zip(full, full[1:])]
        hashes += [((a * two & mask) ^ b) * one & mask for a, b in zip(full, full[2:])]
        return {*stems, *(h >> 64 - toxicity.BITS for h in hashes)}

    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels, id_remainder("doc_id", 5) != 0)
    weight = dict(zip(model.slot.tolist(), model.weight.tolist(), strict=True))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in toxicity.toxicity_report(docs, labels).collect():
        total = model.bias + sum(weight.get(f, 0.0) for f in features(texts[r.doc_id]))
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, total))))) < 1e-5 and r.predicted == (r.score >= 0.5)
