"""The table of usage: batches again, late, and from a stream that begins anew; only touched buckets are written."""

import os
import random

import pytest
from ledgerloom.operators import search
from ledgerloom.operators.usage_table import UsageTable, usage_sink

SCHEMA = "k string, at int, n int"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def held(spark, table, **how):
    return {r.k: (r.at, r.n) for r in table.read(spark, SCHEMA, **how).collect()}


def test_any_order_of_batches(spark, tmp_path):
    rng = random.Random(2)
    batches = [[(f"k{rng.randint(0, 12)}", rng.randint(0, 1000), i) for i in range(b * 20, b * 20 + 20)] for b in range(4)]
    want = {}
    for k, at, n in sum(batches, []):
        if k not in want or (at, n) > want[k]:
            want[k] = (at, n)
    for name, order in (("a", [0, 1, 2, 3]), ("b", [3, 3, 1, 0, 1, 2, 0])):
        table = UsageTable(f"file://{tmp_path}/{name}", "k", "at", "n", buckets=5)
        for b in order:
            usage_sink(table.path, "k", "at", "n", buckets=5)(rows(spark, batches[b]), b)
        assert held(spark, table) == want and len(table.manifests()) == 2


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = UsageTable(str(tmp_path / "t"), "k", "at", buckets=16)
    assert table.read(spark, SCHEMA).count() == 0 and table.merge(rows(spark, [])) == -1
    table.merge(rows(spark, [(f"k{i}", 1, i) for i in range(60)] + [(None, 1, 7)]))
    before = table.manifest()["folders"]
    assert table.merge(rows(spark, [("k3", 2, 99)])) == 1
    after = table.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and held(spark, table)["k3"] == (2, 99) and held(spark, table, version=0)["k3"] == (1, 3)
    assert held(spark, table)[None] == (1, 7) and len(held(spark, table)) == 61
    os.makedirs(tmp_path / "t/data/dead/bucket_=1")  # of a batch that died
    table.clean(keep=1)
    assert table.manifests() == [1] and len(held(spark, table)) == 61 and len(os.listdir(tmp_path / "t/data")) == 2
    assert UsageTable(table.path, "k", "at", buckets=3).manifest()["buckets"] == 16


def test_a_stream_with_a_new_checkpoint(spark, tmp_path):
    for turn, data in enumerate(([("a", 1, 1), ("b", 5, 2)], [("a", 3, 3), ("b", 4, 4)])):
        rows(spark, data).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(usage_sink(str(tmp_path / "t"), "k", "at", "n", buckets=2)).option("checkpointLocation", str(tmp_path / f"state{turn}")).trigger(availableNow=True).start().awaitTermination()
    assert held(spark, UsageTable(str(tmp_path / "t"), "k", "at", "n")) == {"a": (3, 3), "b": (5, 2)}


def test_a_search_that_fails_as_a_whole(spark):
    branches = spark.createDataFrame([(1, "x", 0, None), (1, "y", 1, "down"), (2, "y", 1, "late"), (2, "x", 0, "first")], "query_id int, bucket string, bucket_ord int, reason string")
    hits = spark.createDataFrame([(1, "x", 0, "h", 0.5), (1, "y", 0, "lost", 0.9), (1, "x", 1, "g", 0.7), (2, "x", 0, "i", 1.0)], "query_id int, bucket string, hit_ord int, id string, score double")
    got = sorted((r.query_id, r.bucket_count, r.sources_searched, r.error, r.id, r.place) for r in search.search(hits, branches).collect())
    assert got == [(1, 1, ["x", "y"], None, "g", 1), (1, 1, ["x", "y"], None, "h", 2), (2, 0, ["x", "y"], "first", None, None)]
    search.require_answers(branches.filter("query_id = 1"))
    with pytest.raises(search.SearchError, match="first"):
        search.require_answers(branches)
