"""The language model learns its weights, table and shares from all training texts, however many there are."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import context_mixing as cm


def test_no_text_is_left_out(spark, monkeypatch):
    """Counts a million times as large, as of a corpus of terabytes: still all rows are learned from."""
    seen, summed, shares, counted = [], cm.summed, cm.learn_shares, cm.count_words
    monkeypatch.setattr(cm, "summed", lambda texts, *rest: seen.append(texts.count()) or summed(texts, *rest))
    monkeypatch.setattr(cm, "learn_shares", lambda texts, *rest: seen.append(texts.count()) or shares(texts, *rest))
    monkeypatch.setattr(cm, "count_words", lambda texts: counted(texts).withColumn("c", F.col("c") * 10**9))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("ban dan"), F.col("id") % 7, F.repeat(F.lit("kin "), (F.col("id") % 5).cast("int"))).alias("text"))
    cm.learn(docs, F.col("doc_id") % 10 != 0)
    assert seen == [270] * 4


def test_shares_do_not_depend_on_which_words_are_frequent(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("ban dan"), F.col("id") % 7, F.col("id") % 41, "id").alias("text"))
    all_joined, none_joined = [], []
    for found, frequent in ((all_joined, 1), (none_joined, 1 << 18)):
        monkeypatch.setattr(cm, "FREQUENT", frequent)
        model, _ = cm.learn(docs, F.lit(True))
        found += [len(model.frequent), model.shares]
    assert all_joined[0] == 0 < none_joined[0] and np.array_equal(all_joined[1], none_joined[1])
