import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import partenum
from ledgerloom.llm.components import components
from ledgerloom.llm.partenum import Threshold, drop_near_copies, jaccard_components, shingles, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, num):
    sets = [plain_set(t, size) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, d), d)
    return sorted((d, len(s), least[g]) for (d, _), s, g in zip(rows, sets, group, strict=True))


def corpus(rng, n, copies):
    words = [f"w{i}" for i in range(300)] + ["Ab", "aB", "é"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(n)]
    base = rng.choices(words, k=100)
    for i in range(copies):  # a chain of near copies and a crowd around one text
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
        if i % 4 == 0:
            base[rng.randrange(100)] = f"x{i}"
    texts += ["", None, "   ", texts[0], texts[1], texts[1]]
    rng.shuffle(texts)
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("num", "second"), [(90, 1), (90, 3), (80, 1), (80, 3)])
def test_linked_sets_share_a_signature(num, second):
    rng, t = np.random.default_rng(num + second), Threshold(num)
    for _ in range(400):
        n = int(rng.integers(1, 150))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        cut = int(rng.integers(0, n // 4 + 2))
        b = np.concatenate([a[min(cut, n - 1) :], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 2))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if t.linked(len(np.intersect1d(a, b)), len(a), len(b)) and not np.array_equal(a, b):
            assert np.intersect1d(signatures(a, t, second), signatures(b, t, second)).size, (len(a), len(b))
            short, long = sorted((partenum.sketch(a), partenum.sketch(b)), key=len)
            long = long if len(long) == len(short) else long[: len(short)] ^ long[len(short) :]
            differ = sum(int(x).bit_count() for x in (short ^ long).view(np.uint64))
            assert differ <= t.differing(len(a) + len(b))


@pytest.mark.parametrize(("size", "num", "second", "few"), [(3, 90, 3, 8), (5, 80, 3, 8), (3, 90, 1, 2)])
def test_components_equal_all_pairs(spark, monkeypatch, size, num, second, few):
    monkeypatch.setattr(partenum, "FEW", few)
    rows = corpus(random.Random(size * num), 60, 60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in jaccard_components(docs, size, Threshold(num), second).collect())
    assert got == brute(rows, size, num)


@pytest.mark.parametrize(("pivots", "block"), [(0, 5), (0, 2048), (1, 7), (3, 2048)])
def test_blocks_across_components(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(partenum, "PIVOTS", pivots)
    monkeypatch.setattr(partenum, "BLOCK", block)
    words, rng, rows = [f"w{i}" for i in range(100)], random.Random(pivots + block), []
    for i in range(90):  # edits far enough apart that most pairs share signatures without being linked
        w = list(words)
        for at in rng.sample(range(100), rng.randint(0, 5)):
            w[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, Threshold(90), 3).collect())
    assert got == brute(rows, 3, 90)


def test_hot_signatures(spark, monkeypatch):
    for name, value in {"HOT_LEAST": 12, "HOT_RATE": 1, "SALTS": 3, "FEW": 4, "FEW_IDS": 0}.items():
        monkeypatch.setattr(partenum, name, value)
    words, rng, rows = [f"w{i}" for i in range(60)], random.Random(5), []
    for i in range(80):
        w = [f"v{i % 9}_{k}" for k in range(40)] if i % 2 else list(words)
        for at in rng.sample(range(len(w)), rng.randint(0, 3)):
            w[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert partenum.hot_signatures(docs, 3, Threshold(80), 3, "text")
    assert sorted(tuple(r) for r in jaccard_components(docs, 3, Threshold(80), 3).collect()) == brute(rows, 3, 80)


def test_sketches_of_two_lengths(spark):
    rng = np.random.default_rng(3)
    whole = rng.integers(0, 1 << 63, 1100).astype(np.uint64)
    a, b = np.unique(whole[:1020]), np.unique(whole[60:])
    assert len(partenum.sketch(b)) == 2 * len(partenum.sketch(a))
    one = spark.createDataFrame([(partenum.sketch(a).tolist(), partenum.sketch(b).tolist())], "a array<bigint>, b array<bigint>")
    got = one.select(partenum.differing_cells(one.a, one.b), partenum.differing_cells(one.b, one.a)).first()
    assert got[0] == got[1] and 100 < got[0] <= 140


def test_one_id_two_texts(spark):
    rows = [(7, "a b c d e f g", "x"), (7, "h i j k l m n", "x"), (7, "h i j k l m n", "x"), (8, "A b c d e f g", "x"), (9, "", "x"), (9, "", "x"), (None, "A B c d e f g", "y"), (None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `r` string").withColumns({n: F.lit(1) for n in ("t", "row", "sid", "bit", "id_", "t_", "a.b")})
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(7, "a b c d e f g"), (7, "h i j k l m n"), (9, ""), (9, ""), (None, None)], key=str)


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, "A b c d e f", 1), (3, None, 1), (4, "", 1), (None, "z", 1), (5, long, 1), (6, long + " more", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    kept = drop_near_copies(docs)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5] and kept.columns == docs.columns
    assert jaccard_components(docs.limit(0)).count() == 0
    assert len(shingles("a b", 3)) == 1 and len(shingles(" \x0b\x0c", 3)) == 0 and len(shingles("a\x1cb \x85", 1)) == 2
