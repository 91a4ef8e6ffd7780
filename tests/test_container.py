import hashlib
import json

from pyspark.sql import functions as F

from ledgerloom.sources import container, records

MAGIC = "LOOM"


def build(body, magic=MAGIC, version="0.1", **header):
    lines = body.split("\n")
    counts = {}
    section = None
    for line in lines:
        if line.startswith("@"):
            section = line[1:].strip()
        elif line.strip():
            counts[section] = counts.get(section, 0) + 1
        if section and line.startswith("@"):
            counts.setdefault(section, 0)
    known = {k: v for k, v in counts.items() if k in ("nodes", "patches", "edges", "sessions")}
    head = {"container": "ledger", "format_id": "ledger/1", "generated_at": "", "versions": {}, "sections": [{"name": k, "count": v} for k, v in known.items()], "counts": known, "content_sha256": hashlib.sha256(body.encode()).hexdigest()} | header
    return f"{magic}\t{version}\n{json.dumps(head)}\n{body}\n"


CASES = {
    None: build('@nodes\n{"id":"a"}\n\n@patches\n@nodes\n{"id":"b"}'),
    "empty": "",
    "malformed magic line": "LOOM 0.1\n{}",
    "bad magic": build("@nodes", magic="LOON"),
    "unsupported version": build("@nodes", version="9"),
    "missing header": "LOOM\t0.1",
    "invalid header JSON": "LOOM\t0.1\n{oops\n",
    "header must be an object": "LOOM\t0.1\n[1]\n",
    "unsupported container": build("@nodes", container="x"),
    "record before any section": build('{"id":"a"}\n@nodes'),
    "invalid record JSON": build("@nodes\n{oops", content_sha256="0"),
    "record must be an object": build("@nodes\n[1]"),
    "checksum mismatch": build('@nodes\n{"id":"a"}', content_sha256="0", counts={}),
    "count mismatch": build('@nodes\n{"id":"a"}', counts={"nodes": 2}),
    "count mismatch ": build("@nodes\n@edges", counts={"nodes": 0}, sections=[{"name": "nodes", "count": 0}, {"name": "edges", "count": 0}]),
    "forbidden key": build('@nodes\n{"id":"a"}\n@notes\n{"x":[{"Org_ID":1}]}'),
}


def test_first_problem(spark, tmp_path):
    for i, text in enumerate(CASES.values()):
        (tmp_path / f"{i:02}.txt").write_bytes(text.encode())
    read = container.read_containers(spark, str(tmp_path))
    files = read.unionByName(spark.createDataFrame([("x/01.txt", "")], read.schema))  # file sources pass over empty files
    got = {r.path.rpartition("/")[2]: r.problem for r in container.verify(files, MAGIC).collect()}
    assert got == {f"{i:02}.txt": k and k.strip() for i, k in enumerate(CASES)}
    first = files.filter(files.path.endswith("00.txt"))
    assert [(r.section, r.record) for r in container.records(first).orderBy("pos").collect()] == [("nodes", '{"id":"a"}'), ("nodes", '{"id":"b"}')]


def test_queue_and_transcripts(spark, tmp_path):
    for name in ("b.json", "a.json", "a.json.state.json", "config.json", "x.txt"):
        (tmp_path / name).write_text("{}")
    assert [r.name for r in records.read_queue(spark, str(tmp_path)).collect()] == ["a.json", "b.json"]
    (tmp_path / "t.jsonl").write_text('{"message":{"model":"m","usage":{"input_tokens":3}}}\n\n{bad\n[1]\n')
    rows = records.read_transcripts(spark, str(tmp_path / "t.jsonl")).collect()
    assert len(rows) == 1 and rows[0].message.usage.input_tokens == "3"


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n  "id": "x",\n  "n": 1\n}')
    (tmp_path / "b.json").write_text('[{"id": "y"}, {"id": "z", "n": 3}]')
    want = {("x", 1), ("y", None), ("z", 3)}
    assert {(r.id, r.n) for r in records.read_json(spark, str(tmp_path), "id string, n bigint").collect()} == want
    assert {(r.id, r.n) for r in records.read_json(spark, str(tmp_path)).collect()} == want


def test_whole_json(spark):
    cases = {'{"a":1}': '{"a":1}', ' [1,2] ': "[1,2]", "null": "null", '{"a":1}}': None, '{"a":1} x': None, "1,2": None, "{},null": None, '{"a":1}]}': None, "": None, "{": None, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in rows.select("t", F.to_json(records.whole_json(F.col("t"))).alias("x")).collect()} == cases
