import random
from collections import defaultdict

import pytest

from ledgerloom.llm.sharding import directory, shard_names, write_shards


def brute(sizes, limit):
    """Split oversized buckets bit by bit."""
    found = {}

    def place(rows, depth):
        total = sum(b for _, b in rows)
        if total <= limit or len(rows) == 1:
            found.update({h: (depth, h >> (60 - depth), total) for h, _ in rows})
            return
        halves = defaultdict(list)
        for h, b in rows:
            halves[h >> (59 - depth) & 1].append((h, b))
        for own in halves.values():
            place(own, depth + 1)

    if sizes:
        place(list(sizes.items()), 0)
    return found


@pytest.mark.parametrize("limit", [10, 300, 10**6])
def test_directory(spark, limit):
    rng = random.Random(limit)
    sizes = {rng.getrandbits(60): rng.randint(0, 50) for _ in range(80)}
    base = rng.getrandbits(60) >> 30 << 30
    sizes |= {base | rng.getrandbits(20): 20 for _ in range(20)}  # long common prefixes
    got = {r.h: (r.depth, r.prefix, r.shard_bytes) for r in directory(spark.createDataFrame(list(sizes.items()), "h bigint, bytes bigint"), limit).collect()}
    assert got == brute(sizes, limit)


def test_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a" * 50, "x"), (1, "a" * 50, "x"), (None, "é" * 30, "y"), (2, None, "z"), (3, "", "z"), (4, "b" * 5000, "w")], "doc_id bigint, text string, shard string")
    rows = shard_names(docs, 100).collect()
    assert len(rows) == 6 and sum(r.n_bytes for r in rows) == 5160
    totals = defaultdict(int)
    for r in rows:
        totals[r.shard] += r.n_bytes
    assert all(totals[r.shard] == r.shard_bytes and (r.shard_bytes <= 100 or r.oversize) for r in rows)
    assert {r.doc_id for r in rows if r.oversize} == {4}
    write_shards(docs, str(tmp_path / "out"), 100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 6 and {r.shard for r in back.select("shard").distinct().collect()} == set(totals)
    assert shard_names(docs.limit(0)).count() == 0


def test_shards_of_a_table_with_clashing_names(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "x", "old"), (2, None, "y", "old"), (None, "b" * 50, "z", None)], "doc_id bigint, text string, _id string, shard string")
    write_shards(docs, str(tmp_path / "out"), limit=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r._id for r in back.collect()) == ["x", "y", "z"] and all(r.shard != "old" for r in back.collect())
