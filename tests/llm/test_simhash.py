import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import simhash


def plain_print(text):
    votes = [0] * simhash.BITS
    words = text.lower().split()
    for w in set(words):
        h, weight = hashlib.blake2b(w.encode(), digest_size=32).digest(), simhash.weight(w, words.count(w))
        for i in range(simhash.BITS):
            votes[i] += weight if h[i // 8] >> (7 - i % 8) & 1 else -weight
    bits = "".join("1" if v > 0 else "0" for v in votes)
    return int(bits, 2).to_bytes(32, "big").hex()


def test_votes():
    for text in ["", "one", "A b a B c", "the quick " * 30 + "fox"]:
        assert simhash.written(simhash.fingerprint(text)) == plain_print(text)


def test_report_equals_walk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit(1).alias("lanes"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in simhash.fingerprint_report(docs).collect()}
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    wins = 0
    for (i, text), (j, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        made = simhash.edited(text, following)
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(made.encode()).hexdigest()
        assert r.fingerprint == simhash.written(prints[i]) and r.edited_fingerprint == simhash.written(simhash.fingerprint(made))
        assert r.near_next == simhash.likeness(prints[i], prints[j]) and r.near_edited == simhash.likeness(prints[i], simhash.fingerprint(made))
        wins += r.near_edited > r.near_next
        if i % 50 == 0:
            assert r.n_near == sum(simhash.likeness(prints[i], p) >= 1 - simhash.RADIUS / simhash.BITS for k, p in prints.items() if k != i)
        else:
            assert r.n_near is None
    assert wins >= 0.9 * len(rows)


def test_block_tables_lose_nothing(spark):
    rng, base = random.Random(4), np.frombuffer(bytes(range(32)), "<i8")
    rows = []
    for i in range(120):
        p = base.copy()
        for _ in range(rng.randint(0, 10)):
            p[rng.randrange(4)] ^= np.int64(1) << np.int64(rng.randrange(63))
        rows.append((i, p.tolist()))
    got = {r.doc_id: r.n_near for r in simhash.near_counts(spark.createDataFrame(rows, "doc_id bigint, lanes array<bigint>"), F.lit(True)).collect()}
    near = lambda a, b: simhash.likeness(np.array(a), np.array(b)) >= 1 - simhash.RADIUS / simhash.BITS
    assert got == {i: sum(near(a, b) for j, b in rows if j != i) for i, a in rows}


def test_edges(spark):
    docs = spark.createDataFrame([(None, "n", 1), (1, None, 1), (1, "x y", 1), (1, "x y", 1), (7, "word " * 60_000, 1)], "doc_id bigint, text string, part int")
    rows = simhash.fingerprint_report(docs).collect()
    assert len(rows) == 5 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    alone = simhash.fingerprint_report(docs.filter("doc_id = 7")).collect()
    assert alone[0].near_next == 1.0
    assert simhash.fingerprint_report(docs.limit(0)).count() == 0


def test_near_copies_are_found(spark):
    rng = random.Random(6)
    made = [[rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randrange(10**6)) for _ in range(400)] for _ in range(6)]
    texts = [" ".join(w) for w in made] + [" ".join(["changed" + str(i) if i % 50 == 7 else x for i, x in enumerate(w)]) for w in made]
    prints = [simhash.fingerprint(t) for t in texts]
    rows = [(i, p.tolist()) for i, p in enumerate(prints)]
    for i in range(12, 150):  # at 15 to 35 bits from the first, over the borders of lanes and blocks
        p = int.from_bytes(prints[0].tobytes(), "little")
        for b in rng.sample(range(256), rng.randint(15, 35)):
            p ^= 1 << b
        rows.append((i, np.frombuffer(p.to_bytes(32, "little"), "<i8").tolist()))
    got = {r.doc_id: r.n_near for r in simhash.near_counts(spark.createDataFrame(rows, "doc_id bigint, lanes array<bigint>"), F.col("doc_id") < 50).collect()}
    apart = lambda a, b: sum(int(x).bit_count() for x in (np.array(a) ^ np.array(b)).view(np.uint64).tolist())
    assert got == {i: sum(apart(a, b) <= simhash.RADIUS for j, b in rows if j != i) for i, a in rows if i < 50}
    assert all(got[i] >= 1 for i in range(12)) and 0 < got[0] < 138


def test_layouts_widen_with_the_corpus():
    found = [simhash.layout(simhash.RADIUS, n, n // 50) for n in (1000, 10**6, 10**9)]
    assert found == sorted(found, reverse=True) and found[-1] < found[0]
    for blocks in (5, 9, 13, 26):
        widths = [b - a for a, b in zip(simhash.ends_of(blocks), simhash.ends_of(blocks)[1:])]
        assert sum(widths) == simhash.BITS
        for turned in (0, 1, 2):
            for w in set(widths):
                assert sorted(simhash.masks(w, turned)) == [m for m in sorted(simhash.masks(max(widths), turned)) if m < 1 << w]


def test_any_layout_gives_the_same(spark, monkeypatch):
    rng, base = random.Random(8), random.Random(9).getrandbits(256)
    rows = []
    for i in range(80):
        p = base
        for b in rng.sample(range(256), rng.randint(0, 40)):
            p ^= 1 << b
        rows.append((i, np.frombuffer(p.to_bytes(32, "little"), "<i8").tolist()))
    docs = spark.createDataFrame(rows, "doc_id bigint, lanes array<bigint>")
    apart = lambda a, b: sum(int(x).bit_count() for x in (np.array(a) ^ np.array(b)).view(np.uint64).tolist())
    for radius, blocks in ((25, 13), (25, 9), (25, 7), (25, 26), (3, 5), (0, 5)):
        monkeypatch.setattr(simhash, "layout", lambda *a, n=blocks: n)
        got = {r.doc_id: r.n_near for r in simhash.near_counts(docs, F.col("doc_id") % 4 == 0, radius=radius).collect()}
        assert got == {i: sum(apart(a, b) <= radius for j, b in rows if j != i) for i, a in rows if i % 4 == 0}
