import random

import pytest

from ledgerloom.operators import ledger
from ledgerloom.vocab import RETIRING_OPERATIONS

NODE = "id string, key string, status string, updated_at string, scope struct<session:string,project:string,workspace:string>, ord bigint, content string, label string, ledger string"
PATCH = "id string, operation string, target_ids array<string>"


def model(nodes, patches, session):
    """The rules, one record after the other."""
    retired = {t for p in patches if p[1] in RETIRING_OPERATIONS for t in p[2]}
    live = [n for n in nodes if n[0] not in retired and (n[2] == "active" or (n[2] == "active_session" and session and n[4][0] == session))]
    rank = lambda n: 4 if n[2] == "active_session" and n[4][0] == session else 3 if n[4][1] else 2 if n[4][2] else 1
    best, free = {}, []
    for n in live:
        if not n[1]:
            free.append(n)
        elif n[1] not in best or (rank(n), n[3] or "") > (rank(best[n[1]]), best[n[1]][3] or ""):
            best[n[1]] = n
    return [n[0] for n in free] + [n[0] for n in best.values()]


def test_random_ledgers(spark):
    rng = random.Random(11)
    for turn in range(6):
        nodes = [(f"mem_{i}", rng.choice([None, "", "a", "b", "c"]), rng.choice(["active", "active", "active_session", "expired"]), rng.choice(["2024-01-01T00:00:00.000Z", "2024-01-01T00:00:00+00:00", "2023"]), tuple(rng.choice([None, "", "s"]) for _ in range(3)), i, f"c{i}", "l", "x") for i in range(40)]
        patches = [(f"patch_{i}", rng.choice(["supersede", "create", "rollback", "forget"]), [f"mem_{rng.randrange(45)}"]) for i in range(8)]
        view = ledger.effective_order(spark.createDataFrame(nodes, NODE), spark.createDataFrame(patches, PATCH), "s" if turn % 2 else None)
        assert [r.id for r in view.orderBy("place").collect()] == model(nodes, patches, "s" if turn % 2 else None)


def test_guard_fires_without_nodes(spark):
    patches = spark.createDataFrame([("patch_1", "invent", ["mem_1"])], PATCH)
    with pytest.raises(ledger.UnknownOperationError):
        ledger.effective_view(spark.createDataFrame([], NODE), patches)


def test_summary_cuts_after_five(spark):
    rows = [(f"mem_{i}", None, "active", "", (None, None, None), i, "  " if i == 1 else f" n{i} ", "l", "x") for i in range(8)]
    assert ledger.summary(spark.createDataFrame(rows, NODE), order="ord").first().summary == "n0 / n2 / n3 / n4"
    long = [("mem_1", None, "active", "", (None, None, None), 1, "y" * 600, "l", "x")]
    assert ledger.summary(spark.createDataFrame(long, NODE), order="ord").first().summary == "y" * 479 + "…"


def test_a_foreign_session_does_not_rank_and_order_is_the_views(spark):
    nodes = [
        ("mem_a", "k", "active", "2024", ("other", None, None), 0, "A", "la", "x"), ("mem_b", "k", "active", "2023", (None, "p", None), 1, "B", "lb", "x"), ("mem_c", None, "active", "2022", (None, None, None), 2, "C", "lc", "x"),
    ]
    view = ledger.effective_order(spark.createDataFrame(nodes, NODE), spark.createDataFrame([], PATCH), "s")
    assert [r.id for r in view.orderBy("place").collect()] == ["mem_c", "mem_b"]
    patches = spark.createDataFrame([("patch_2", "x", 1), ("patch_10", "x", 0)], "id string, ledger string, ord int")
    one = ledger.container_envelope(view, patches).first()
    assert (one.node_ids, one.patch_ids, one.labels, one.summary) == (["mem_c", "mem_b"], ["patch_10", "patch_2"], ["lc", "lb"], "C / B")
    files = spark.createDataFrame([("x", "text", "sum")], "ledger string, content string, h string")
    from pyspark.sql import functions as F

    whole = ledger.with_container(ledger.container_envelope(view, patches), files, F.col("h"), {"summary": F.lit("own")}).first()
    assert (whole.container_text, whole.container_checksum, whole.summary) == ("text", "sum", "own")
