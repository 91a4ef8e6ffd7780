"""The language model against a plain version that goes bit by bit with Python numbers."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import context_mixing as cm
from ledgerloom.llm.common import id_remainder, whole
from ledgerloom.llm.context_mixing import Model, Stream, learn, score_report, scored, words_of

WORD, M = re.compile(r"[^\x20\x09-\x0D]+"), (1 << 64) - 1


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def prefix(word):
    h = 0
    for i, b in enumerate(word):
        h += (b + 1) * pow(int(cm.ONE), i + 1, 1 << 64)
    return h & M


def walk(text):
    """For each half byte: its value and the first slot of its block in each context, and which token it is of."""
    words = [w.encode() for w in tokens(text)]
    data = b" ".join(words) + b" "
    at, k, before = 0, 0, 0
    for i, b in enumerate(data):
        so_far, found = data[at:i], []
        for p, (width, bits) in enumerate(cm.CONTEXTS):
            if width > 0:
                own = int.from_bytes(data[max(0, i - width) : i], "big")
            else:
                own = prefix(so_far) + (before * int(cm.TWO) if width else 0)
            h = own * int(cm.MULTIPLIERS[p]) & M
            found.append((h, p, bits))
        for half, value in enumerate((b >> 4, b & 15)):
            step = ((b >> 4) + 1) * int(cm.TWO) if half else 0
            yield value, [int(cm.OFFSETS[p]) + ((((h + step) & M) >> 64 - bits + 4) << 4) for h, p, bits in found], k
        if b == 32:
            before, at, k = prefix(so_far), i + 1, k + 1


def plain_counts(texts):
    n = defaultdict(lambda: [0, 0])
    for t in texts:
        for value, blocks, _ in walk(t):
            for b in blocks:
                for i in range(4):
                    n[b + (1 << i | value >> 4 - i)][value >> 3 - i & 1] += 1
    return n


def stretch(a, b):
    return min(10.0, max(-10.0, math.log((b + 0.4) / (a + 0.4))))


def often(n):
    return min(7, int(math.log2(n + 1)) * 2 // 3 + (n > 0))


def dots(counts, mixer, text, out=1, rounded=False):
    """(bit, dot, gate, token) of every bit; ``out``: each bit out of its own counts."""
    for value, blocks, k in walk(text):
        gate = 8 * often(max(0, sum(counts[blocks[cm.WORD] + 1]) - out)) + often(max(0, sum(counts[blocks[cm.LONGEST] + 1]) - out))
        for i in range(4):
            bit, x = value >> 3 - i & 1, []
            for b in blocks:
                n0, n1 = counts[b + (1 << i | value >> 4 - i)]
                x.append(stretch(max(0, n0 - out * (1 - bit)), max(0, n1 - out * bit)))
            if rounded:
                x = [round(v * cm.SCALE) / cm.SCALE for v in x]
            yield bit, sum(w * v for w, v in zip(mixer.weights[gate], x, strict=True)), gate, k, x


def cell(dot):
    return int(min(7.99, max(-7.99, dot)) * 8 + 64.5)


def plain_mixer(counts, sample):
    mixer = cm.Mixer()
    for _ in range(2):
        slope, bend = np.zeros((cm.GATES, cm.INPUTS)), np.zeros((cm.GATES, cm.INPUTS, cm.INPUTS))
        for t in sample:
            for bit, dot, gate, _, x in dots(counts, mixer, t):
                p, x = 1 / (1 + math.exp(-min(14, max(-14, dot)))), np.array(x)
                slope[gate] += (bit - p) * x
                bend[gate] += p * (1 - p) * np.outer(x, x)
        for g in range(cm.GATES):
            step = np.linalg.solve(bend[g] + 20 * np.eye(cm.INPUTS), slope[g] - 20 * (mixer.weights[g] - cm.Mixer().weights[g]))
            mixer.weights[g] += np.clip(step, -1, 1)
    hits, ones = np.zeros((cm.GATES, cm.CELLS)), np.zeros((cm.GATES, cm.CELLS))
    for t in sample:
        for bit, dot, gate, _, _ in dots(counts, mixer, t):
            hits[gate, cell(dot)] += 1
            ones[gate, cell(dot)] += bit
    p = np.clip((ones + 8 / (1 + np.exp(-(np.arange(129) - 64) / 8))) / (hits + 8), 1e-6, 1 - 1e-6)
    mixer.refine = np.log(p / (1 - p))
    return mixer


def plain_costs(counts, mixer, text):
    """Bits of each token, with weights of the text's own that are corrected after each piece."""
    v, bend, grown = [0.5, 0.5], 40.0, [0.0, 0.0]
    cost, n, piece = defaultdict(float), 0, cm.PIECE
    for bit, dot, gate, k, _ in dots(counts, mixer, text, 0, True):
        if n == 8 * piece:
            v, grown, piece = [a + min(0.25, max(-0.25, g / (2 * bend))) for a, g in zip(v, grown, strict=True)], [0.0, 0.0], 2 * piece
        n += 1
        dot = min(7.99, max(-7.99, dot))
        inputs = (dot, mixer.refine[gate, cell(dot)])
        z = min(13.8, max(-13.8, sum(a * b for a, b in zip(v, inputs, strict=True)) * (2 * bit - 1)))
        cost[k] += math.log2(1 + math.exp(-z))
        q = 1 / (1 + math.exp(z))
        for j, one in enumerate(inputs):
            grown[j] += q * (2 * bit - 1) * one
        bend += q * (1 - q) * dot * dot
    return [cost[k] for k in range(len(tokens(text)))]


def corpus(n=40):
    rng, words = random.Random(4), [f"{a}{b}{c}" for a in "bdk" for b in "aeiou" for c in ("n", "rst", "")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 90)))) for i in range(n)]
    return [*rows, (100, None), (101, ""), (102, "É \t ban\x0bBAN \x1c"), (103, rows[1][1]), (103, rows[1][1]), (None, "dan dan")]


def drawn(docs, n_bytes):
    """The texts of the rows that the weights are learned from."""
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(cm.DRAWS))
    return [r.text for r in docs.filter(draw < cm.draws_learned(n_bytes)).collect()]


@pytest.fixture(scope="module")
def learned(spark):
    rows, before = corpus(), cm.LEARNED_BYTES
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = docs.select("doc_id", whole("text").alias("text"))
    train = [t or "" for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    n_bytes = sum(len(w.encode()) + 1 for t in train for w in tokens(t))
    cm.LEARNED_BYTES = n_bytes // 2
    model, counts = learn(docs, id_remainder("doc_id", 10) != 0)
    sample = drawn(docs.filter(id_remainder("doc_id", 10) != 0), n_bytes)
    assert 0 < len(sample) < len(train)
    yield docs, rows, model, counts, train, sample
    cm.LEARNED_BYTES = before


def test_training_equals_the_plain_one(learned):
    _, _, model, counts, train, sample = learned
    found = plain_counts(train)
    mixer = plain_mixer(found, sample)
    assert np.abs(mixer.weights - model.mixer.weights).max() < 1e-3 and np.abs(mixer.refine - model.mixer.refine).max() < 1e-2
    words = Counter(w.encode() for t in train for w in tokens(t))
    assert {bytes(r.word): r.c for r in counts.collect()} == dict(words) and model.total == sum(words.values()) and model.distinct == len(words)
    n = np.zeros((cm.SIZES, cm.BINS))
    for t in sample:
        bits = defaultdict(float)
        for bit, dot, gate, k, _ in dots(found, model.mixer, t):
            z = 0.5 * min(7.99, max(-7.99, dot)) + 0.5 * model.mixer.refine[gate, cell(dot)]
            bits[k] += math.log2(1 + math.exp(-z * (2 * bit - 1)))
        for k, w in enumerate(tokens(t)):
            c = words[w.encode()] - 1
            ratio = math.log2((c + 0.1) / (model.total - 1 + 0.1 * (model.distinct + 1))) + bits[k]
            n[int(cm.size_of(np.array([c]))[0]), min(cm.BINS - 1, max(0, round(ratio * 4) + cm.BINS // 2))] += 1
    assert np.abs(cm.best_shares(n) - model.shares).max() < 0.02


def test_scores_equal_the_plain_ones(learned):
    docs, rows, model, counts, train, _ = learned
    found, words = plain_counts(train), Counter(w for t in train for w in tokens(t))
    want = []
    for i, t in rows:
        total, base = 0.0, 0.0
        for w, bits in zip(tokens(t), plain_costs(found, model.mixer, t), strict=True):
            c = words[w]
            share = model.shares[0 if not c else min(cm.SIZES - 1, int(math.log2(c)) + 1)]
            exact = (c + 0.1) / (model.total + 0.1 * (model.distinct + 1))
            base += math.log10(exact)
            total += math.log10((1 - share) * 2**-bits + (share * exact if c else 0))
        want.append((str(i), len(tokens(t)), sum(words[w] > 0 for w in tokens(t)), base, total))
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in scored(docs, model, counts).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], abs_tol=1e-6) and math.isclose(a[4], b[4], rel_tol=2e-3, abs_tol=1e-3), (a, b)


def test_order_of_words_counts(learned):
    _, rows, model, *_ = learned
    words = words_of(max((t or "" for _, t in rows), key=len))
    back = [*words[:-1][::-1], b""]
    one, other = (model.costs(Stream([w])).sum() for w in (words, back))
    assert abs(one - other) > 0.1


def test_a_text_scores_alike_in_any_company(learned, monkeypatch):
    _, rows, model, *_ = learned
    texts = [words_of(t) for _, t in rows]
    alone = np.concatenate([model.costs(Stream([w])) for w in texts])
    assert np.allclose(alone, model.costs(Stream(texts)), rtol=1e-4)
    monkeypatch.setattr(cm, "LONGEST_RUN", 700)
    assert np.allclose(alone, np.concatenate([model.costs(s) for _, _, s in cm.streams(texts)]), rtol=1e-4)


def test_bits_of_halves():
    n = np.random.default_rng(2).integers(0, 9, 32).astype(np.float32)
    n0, n1 = cm.bits_of(n)
    for b in (0, 16):
        for v in range(1, 16):
            t = v.bit_length() - 1
            for bit, found in ((0, n0), (1, n1)):
                assert found[b + v] == sum(n[b + h] for h in range(16) if 1 << t | h >> 4 - t == v and h >> 3 - t & 1 == bit)


def test_tables_of_counts():
    table = np.zeros(cm.CHUNK * 3, np.uint32)
    table[[1, 5, cm.CHUNK + 7]] = [3, 70_000, 256]
    back = np.zeros(cm.CHUNK * 3, np.int64)
    for chunk, *row in cm.tally_rows(table):
        cm.tally_add(back[chunk * cm.CHUNK : (chunk + 1) * cm.CHUNK], *row)
    assert (back == table).all()


def test_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(1, long, 1), (2, None, 1), (3, "", 1), (3, "", 1), (None, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang int").withColumns({n: F.lit(1) for n in ("row", "key", "c", "bits", "rare")})
    got = score_report(docs).collect()
    assert len(got) == 5 and all(r.score < 0 and math.isfinite(r.score) and r.n_tokens >= 1 for r in got)
    assert score_report(docs.limit(0)).count() == 0
    model, counts = learn(docs.limit(0), F.lit(True))
    assert isinstance(model, Model) and scored(docs.select("doc_id", whole("text").alias("text")), model, counts).filter("score < 0").count() == 5
    odd = docs.select(F.col("doc_id").alias("row"), whole("text").alias("a text"))
    assert scored(odd, model, counts, "row", "a text").columns[0] == "row"


def test_weights_of_counts_beyond_65535(spark, monkeypatch):
    """A text in a thousand copies: counts far beyond two bytes are learned from as they are."""
    rows = corpus(12)
    hot = "ban ban dan " * 60
    docs = spark.createDataFrame([(i, t) for i, t in rows if t is not None], "doc_id bigint, text string").unionByName(spark.range(1000, 2500).select(F.col("id").alias("doc_id"), F.lit(hot).alias("text")))
    found = plain_counts([t for _, t in rows if t is not None])
    for node, (n0, n1) in plain_counts([hot]).items():
        found[node] = [found[node][0] + 1500 * n0, found[node][1] + 1500 * n1]
    assert max(map(sum, found.values())) > 3 * 65535
    n_bytes = sum(len(w.encode()) + 1 for _, t in rows if t is not None for w in tokens(t)) + 1500 * (len(hot) + 1)
    monkeypatch.setattr(cm, "LEARNED_BYTES", n_bytes // 200)
    sample = drawn(docs, n_bytes)
    assert 1 < sum(t == hot for t in sample) < 40  # of copies a share is drawn, not all or none
    model, _ = learn(docs, F.lit(True))
    mixer = plain_mixer(found, sample)
    assert np.abs(mixer.weights - model.mixer.weights).max() < 2e-3 and np.abs(mixer.refine - model.mixer.refine).max() < 2e-2


def test_small_corpora_learn_from_all_texts(spark, sf, monkeypatch):
    """With the default settings; larger ones from rows that hold about LEARNED_BYTES."""
    monkeypatch.setattr(cm, "LEARNED_BYTES", 1 << 25)
    n_bytes = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert cm.draws_learned(n_bytes) == cm.DRAWS and cm.draws_learned(0) == cm.DRAWS
    for n_bytes in (10**9, 10**12, 10**14):
        assert 0.99 * cm.LEARNED_BYTES < n_bytes * cm.draws_learned(n_bytes) / cm.DRAWS < 1.01 * cm.LEARNED_BYTES
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = score_report(docs).filter("held_out").collect()
    assert sum(r.score for r in rows) > 1.2 * sum(r.base_score for r in rows)
