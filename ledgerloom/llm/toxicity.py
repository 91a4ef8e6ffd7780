"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters in lower case. A text's features are its distinct words, their stems (the first
STEM letters, for inflected forms), pairs of neighbours and pairs with one word between, hashed to 2**BITS
slots. Features of fewer than LEAST_TEXTS training texts are not learned, as they only recall those texts. Training goes through a bounded sample of labelled
texts one by one with a rate for each coordinate; the L1 term keeps the weights sparse, so what is sent to
the tasks is a few thousand (slot, weight) pairs. Scoring reads every whole text once, without a shuffle.

Null and empty texts have no feature and score as the bias alone. Null labels are left out; without any
label every score is the prior's 0.5. Repeated rows stay and score alike; of training rows with one id the
least text is learned. Very long texts are scored whole. In the sample they come after all others, where they fit. Ties of the sample go by hash and id. An empty table
gives an empty one. Only id and text are read; results don't clash with other columns.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_remainder, stage_table, whole, worker_store

BITS = 22
WORD = re.compile(r"[^\W\d_]+")
#: The training sample: at most so many texts of each label, those with the smallest hash of their id.
MOST_TOXIC, MOST_CLEAN = 4_000, 6_000
#: Characters of the training texts of each label: texts are taken in that order until they hold so many, those of more than
#: LONG characters after all others. The first one is always taken, so that no label is lost.
MOST_CHARS, LONG = 8_000_000, 100_000
STEM = 5
LEAST_TEXTS = 3
#: Hashes of words that a worker keeps.
KEPT_WORDS = 200_000


#: A word's hash in the upper bits, the slot of its stem in the lower ones.
FULL = (1 << 64) - (1 << BITS)


def hashed(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = hashed(word) & FULL | hashed("\n" + word[:STEM]) >> 64 - BITS
        return h


def word_hashes() -> WordHashes:
    return worker_store("toxicity words", WordHashes)


def slots(text: str) -> np.ndarray:
    """The slots of a text's features, with repeats."""
    words = WORD.findall(text.lower())
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    stems = (h & np.uint64((1 << BITS) - 1)).astype(np.int32)
    h &= np.uint64(FULL)
    shift = np.uint64(64 - BITS)
    one, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = [h * one, (h[:-1] * one ^ h[1:]) * two, (h[:-2] * two ^ h[2:]) * one]
    return np.concatenate([stems, (np.concatenate(mixed) >> shift).astype(np.int32)])


@dataclass(frozen=True)
class Weights:
    """Sparse weights by slot, and the bias."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float

    @functools.cached_property
    def dense(self) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.slot] = self.weight
        return table

    def score(self, text: str) -> float:
        found = slots(text)
        found = np.unique(found[self.dense[found] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.dense[found].sum(dtype=np.float64), -30, 30))))


def ftrl(samples: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, alpha=1.0, beta=1.0, l1=4.0, l2=0.5, rounds=8, seed=1) -> Weights:
    """Follow the regularised leader over the samples (distinct slots of each)."""
    n, z = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last slot is the bias
    seen = np.zeros(1 << BITS, np.int32)
    for at in samples:
        seen[at] += 1
    samples = [at[seen[at] >= LEAST_TEXTS] for at in samples]
    last, order = 1 << BITS, np.random.default_rng(seed)

    def weight(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        pull = np.where(at == last, 0.0, l1)
        return np.where(np.abs(zs) <= pull, 0.0, -(zs - np.sign(zs) * pull) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(rounds):
        for i in order.permutation(len(samples)):
            at = np.append(samples[i], last)
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = (p - labels[i]) * importance[i]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    every = np.flatnonzero(np.abs(z[:last]) > l1)
    w = weight(every)
    return Weights(every.astype(np.int32), w.astype(np.float32), float(weight(np.array([last]))[0]))


def train(docs: DataFrame, labels: DataFrame, rows: Column, text: str = "text", label: str = "toxic", key: str = "doc_id") -> Weights:
    """Weights from the labelled documents for which ``rows`` holds (a condition on the key)."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & rows).groupBy(key).agg((F.max(label) > 0).cast("int").alias("y"))
    order = F.xxhash64(key)
    chosen = known.filter("y = 1").orderBy(order, key).limit(MOST_TOXIC).unionByName(known.filter("y = 0").orderBy(order, key).limit(MOST_CLEAN))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}

    @F.pandas_udf("binary")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(slots(t)).astype("<i4").tobytes() for t in texts], dtype=object)

    own = docs.select(F.col(key), F.col(text).alias("t")).join(F.broadcast(chosen), key).groupBy(key, "y").agg(F.min(whole("t")).alias("t"))
    own = stage_table(own, "labelled")  # MOST_TOXIC and MOST_CLEAN rows at most
    sizes = own.select(key, "y", F.length("t").cast("bigint").alias("n"))  # texts don't pass the window
    before = Window.partitionBy("y").orderBy(F.col("n") > LONG, order, key).rowsBetween(Window.unboundedPreceding, -1)
    fitting = sizes.withColumn("sum", F.coalesce(F.sum("n").over(before), F.lit(0))).filter((F.col("sum") == 0) | (F.col("sum") + F.col("n") <= MOST_CHARS))
    found = own.join(F.broadcast(fitting.select(key)), key).select("y", features("t").alias("f")).collect()  # MOST_CHARS bounds them, and the slots of one text
    if not found:
        return Weights(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    y = np.array([r.y for r in found])
    prior = {v: totals[v] / max(1, (y == v).sum()) for v in totals}
    importance = np.array([prior[v] for v in y]) / max(prior.values())
    order = sorted(range(len(found)), key=lambda i: (bytes(found[i].f), y[i]))
    return ftrl([np.frombuffer(found[i].f, "<i4") for i in order], y[order], importance[order])


def score_column(docs: DataFrame, weights: Weights, text: str = "text") -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = sent.value
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(whole(text))


def drop_toxic(docs: DataFrame, weights: Weights, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows that score under ``limit``; columns stay as they are."""
    return docs.filter(score_column(docs, weights, text) < limit)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document its score by a model that never saw the labels of the held-out fifth."""
    weights = train(docs, labels, id_remainder("doc_id", 5) != 0)
    return docs.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), score_column(docs, weights).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
