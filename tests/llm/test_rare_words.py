"""What keeps the language model's passes and shuffles small, with the same results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import context_mixing as cm


def test_rare_words_meet_their_counts_without_a_sort(spark):
    """Costs of rare words are floats, and no task sorts them to join them."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("ban dan"), F.col("id") % 7, "id").alias("text"))
    model, counts = cm.learn(docs, F.col("doc_id") % 10 != 0)
    rows = cm.scored(docs, model, counts)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    joined = plan[plan.index("ShuffledHashJoin") :]
    assert "Sort " not in joined and "bits:float" in joined
    assert rows.count() == 60 and rows.filter("n_known < n_tokens").count() == 5  # "0" is a remainder, too


@pytest.mark.parametrize("sizes", [[1], [32], [33, 1, 64], [65, 1000, 2, 31, 129, 128], [4097, 1]])
def test_turns(sizes):
    s = cm.Stream([[b"x" * (n - 2), b""] if n > 1 else [b""] for n in sizes])
    assert s.sizes.tolist() == sizes
    turns, of, ends = s.turns()
    turn = np.empty(len(turns), int)
    for t, (low, high) in enumerate(zip([0, *ends], ends, strict=False)):
        turn[turns[low:high]] = t
    want, texts = [], []
    for k, n in enumerate(sizes):
        piece = lambda i: max(0, (i // cm.PIECE).bit_length())
        want += [2 * piece(i) + (piece(i) == piece(n - 1)) for i in range(n)]
        texts += [k] * n
    assert sorted(turns.tolist()) == list(range(sum(sizes))) and turn.tolist() == want
    assert [texts[i] for i in turns] == of.tolist()
