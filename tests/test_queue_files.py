"""The queue's folder as a stream: offsets by time and name, states written anew, forgotten items."""

import json
import os

from ledgerloom.streaming import outbox, queue_files


def put(folder, name, content, ns):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(content)
    os.utime(folder / name, ns=(ns, ns))


def test_offsets(tmp_path):
    reader = queue_files.QueueReader(str(tmp_path / "q"), 0)
    start = reader.initialOffset()
    assert reader.latestOffset() == start and reader.partitions(start, start) == []
    for name, ns in (("b.json", 10), ("a.json", 10), ("c.json", 5), ("config.json", 7), ("x.lease", 8), ("a.json.state.json", 12)):
        put(tmp_path / "q", name, name, ns)
    end = reader.latestOffset()
    assert end == {"ns": 12, "name": "a.json.state.json"}
    assert [n for p in reader.partitions(start, end) for n, _, _ in reader.read(p)] == ["c.json", "a.json", "b.json", "a.json.state.json"]
    put(tmp_path / "q", "c.json", "again", 20)
    again = queue_files.QueueReader(str(tmp_path / "q"), 0)  # after a restart
    assert [r[:2] for p in again.partitions(end, {"ns": 20, "name": "c.json"}) for r in again.read(p)] == [("c.json", "again")]
    part = again.partitions(end, {"ns": 20, "name": "c.json"})[0]
    (tmp_path / "q/c.json").unlink()  # delivered before it is read
    assert list(again.read(part)) == []


def test_states_of_any_text():
    assert queue_files.state_of('{"attempts": 3, "next_attempt_at": "t", "last_error": "e", "last_status": 1}') == (3, "t", "e")
    for text in ("", "{", "[]", "null", '{"attempts": "3", "next_attempt_at": 1, "last_error": {}}', '{"attempts": true}'):
        assert queue_files.state_of(text) == (0, queue_files.NEVER, None)


def test_states_before_and_behind_their_items(spark, tmp_path):
    """A state may come first, change, or never come; after ``keep`` an item is forgotten and starts anew."""
    day, queue, rows = 86_400 * 10**9, tmp_path / "q", []
    state = lambda n: json.dumps({"attempts": n, "next_attempt_at": f"t{n}"})

    def run():
        rows.clear()
        outbox.use_timers(spark)
        files = queue_files.read_queue_stream(spark, str(queue), 0)
        stream = queue_files.listing(files, keep=86_400, late="0 seconds").writeStream.foreachBatch(lambda found, n: rows.extend(tuple(r) for r in found.collect()))
        stream.option("checkpointLocation", str(tmp_path / "state")).outputMode("update").trigger(availableNow=True).start().awaitTermination()
        return sorted(rows)

    put(queue, "a.json.state.json", state(1), day)
    put(queue, "b.json", "{}", day)
    assert run() == [("b.json", 0, queue_files.NEVER, None)]
    put(queue, "a.json", "{}", day + 1)
    put(queue, "b.json.state.json", state(2), day + 2)
    assert run() == [("a.json", 1, "t1", None), ("b.json", 2, "t2", None)]
    put(queue, "z.json", "{}", 9 * day)
    run()
    put(queue, "b.json", "{}", 9 * day + 1)  # after its state was forgotten
    assert ("b.json", 0, queue_files.NEVER, None) in run()


def test_many_items(spark, tmp_path):
    """Many items come through whole; a batch's folder is listed once."""
    from ledgerloom.plans import files
    from pyspark.sql import functions as F

    ids = spark.range(0, 5000, 1, 1)
    root = str(tmp_path / "q")
    written = ids.select(F.concat(F.lit("i"), "id", F.lit(".json")).alias("name"), F.lit("{}").alias("content"))
    assert files.write_files(written, root) == 5000
    reader, asked = queue_files.QueueReader(root, 0), []
    whole = reader.listed
    reader.listed = lambda *offsets: asked.append(offsets) or whole(*offsets)
    start = reader.initialOffset()
    end = reader.latestOffset()
    assert sum(len(p.files) for p in reader.partitions(start, end)) == 5000 and len(asked) == 1
    assert sum(len(p.files) for p in reader.partitions(start, end)) == 5000 and len(asked) == 2  # once more, after a failure
    outbox.use_timers(spark)
    rows = []
    stream = queue_files.listing(queue_files.read_queue_stream(spark, root, 0)).writeStream.foreachBatch(lambda found, n: rows.extend(found.collect()))
    stream.option("checkpointLocation", str(tmp_path / "state")).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert len({r.name for r in rows}) == len(rows) == 5000


def test_every_customer_is_listed(spark, tmp_path):
    """Keys of every remainder, and odd ones; one without a key names no file."""
    import compare
    from ledgerloom.plans import registry

    keys = [*range(1, 64), -1, -2, -6, -7, -42, 0, None]
    spark.createDataFrame([(k,) for k in keys], "c_custkey bigint").write.parquet(str(tmp_path / "customer.parquet"))
    con = compare.duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    found = registry.queries()["stream_outbox_list"](spark, str(tmp_path))
    assert found.count() == len(keys) - 1
    assert compare.differences(found, con, registry.oracle_sql()["stream_outbox_list"]) == ""
