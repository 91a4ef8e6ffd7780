"""References of records, and order within groups that no task holds."""

import json
import random

import pytest
from ledgerloom import vocab
from ledgerloom.operators import blocks, ledger, validate
from pyspark.sql import functions as F

VERSIONS = {"node": "n/1", "patch": "p/1", "edge": "e/1", "session": "s/1"}


@pytest.fixture
def many_parts(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain(nodes, patches, edges, sessions):
    """All problems of a ledger in the order of reading, as the records' format states them; other rules aren't broken here."""
    ids, patch_ids, out = {n["id"] for n in nodes}, {p["id"] for p in patches}, []
    for n in nodes:
        relations = n["relations"]
        if not isinstance(relations, dict):
            out.append(f"node {n['id']}: relations must be object")
            continue
        for name, refs in relations.items():
            if not isinstance(refs, list):
                out.append(f"node {n['id']}: relations.{name} must be list")
            else:
                out += [f"node {n['id']}: relations.{name} missing node {r}" for r in refs if r not in ids]
    for p in patches:
        if p["operation"] != "create" and not p["target_ids"]:
            out.append(f"patch {p['id']}: target_ids required for {p['operation']}")
        out += [f"patch {p['id']}: missing target node {r}" for r in p["target_ids"] or [] if r not in ids]
        out += [f"patch {p['id']}: missing new node {r}" for r in p["new_node_ids"] or [] if r not in ids]
    for e in edges:
        for end in ("from", "to"):
            if e[end] not in ids:
                out.append(f"edge {e['id']}: missing {end} node {'undefined' if e[end] is None else e[end]}")
        if e["source_patch_id"] and e["source_patch_id"] not in patch_ids:
            out.append(f"edge {e['id']}: missing source patch {e['source_patch_id']}")
    return out + [f"session {s['id']}: unknown status {s['status']}" for s in sessions if s["status"] not in vocab.SESSION_STATUSES]


def records(rng, ledgers):
    kinds = {k: [] for k in vocab.KINDS}
    for at in range(120):
        here, some = rng.choice(ledgers), lambda: [f"mem_{rng.randint(0, 40)}" for _ in range(rng.randint(0, 3))]
        relations = rng.choice([{}, {"refines": some(), "b c": some()}, {"note": "mem_1", "z": some(), "a": {"x": 1}}, [1], None, 3])
        kinds["node"].append({"ledger": here, "ord": at, "id": f"mem_{at % 37}", "relations": relations})
        kinds["patch"].append({"ledger": here, "ord": at, "id": f"patch_{at}", "operation": rng.choice(["create", "update", "forget"]), "target_ids": rng.choice([some(), None]), "new_node_ids": rng.choice([some(), None])})
        kinds["edge"].append({"ledger": here, "ord": at, "id": f"edge_{at}", "from": rng.choice([*some(), None]), "to": rng.choice([*some(), "mem_1"]), "source_patch_id": rng.choice([None, "", f"patch_{at}", "patch_x"])})
        kinds["session"].append({"ledger": here, "ord": at, "id": f"s{at}", "status": rng.choice(["active", "lost", "ended"])})
    return kinds


def frames(spark, kinds):
    def made(kind, fields, names, **more):
        rows = [(r["ledger"], r["ord"], r["id"], *(json.dumps(r[f]) if f == "relations" and r[f] is not None else r[f] for f in fields)) for r in kinds[kind]]
        types = {"relations": "string", "target_ids": "array<string>", "new_node_ids": "array<string>"}
        frame = spark.createDataFrame(rows, "ledger int, ord int, id string" + "".join(f", `{f}` {types.get(f, 'string')}" for f in fields))
        return frame.withColumns({"schema_version": F.lit(VERSIONS[kind]), "present": F.array(*map(F.lit, names))} | {k: F.lit(v) for k, v in more.items()})

    nodes = made("node", ["relations"], vocab.NODE_FIELDS, type="task", status="active", content="x", label="l").withColumn("span_sources", F.array().cast("array<string>"))
    return (
        nodes, made("patch", ["operation", "target_ids", "new_node_ids"], vocab.PATCH_FIELDS, new_content="c"),
        made("edge", ["from", "to", "source_patch_id"], vocab.EDGE_FIELDS, type="blocks"), made("session", ["status"], vocab.SESSION_FIELDS),
    )


def test_problems_of_references(spark, many_parts):
    kinds = records(random.Random(3), [1, 1, 1, 2, 3])
    found = validate.all_problems(*frames(spark, kinds), VERSIONS)
    texts = {r.ledger: (r.problems, r.n_problems) for r in validate.problem_text(found, size=5).collect()}
    for here in (1, 2, 3):
        want = plain(*([r for r in kinds[k] if r["ledger"] == here] for k in vocab.KINDS))
        assert texts[here] == ("; ".join(want), len(want))
    blocks_of = validate.problem_blocks(found, size=5).collect()
    assert max(r.n_problems for r in blocks_of) == 5 and sum(r.n_problems for r in blocks_of) == sum(n for _, n in texts.values())


def test_places_in_a_hot_group(spark, many_parts):
    """Nearly all rows in one group, equal rows, null groups: every place once, in order, and over several partitions."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 9 + ["b", None]), rng.randint(0, 50), f"v{i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, k int, v string").repartition(7)
    got = blocks.placed(frame, "g", ("k",)).collect()
    for g in ("hot", "b", None):
        own = sorted((r.place_, r.k) for r in got if r.g == g)
        assert [p for p, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)
    assert sorted(r.v for r in got) == sorted(r[2] for r in rows)
    cut = blocks.ordered_blocks(frame, "g", ("k", "v"), "v", 100).filter("g = 'hot'").orderBy("block").collect()
    assert sum((r["items"] for r in cut), []) == [v for _, _, v in sorted((g, k, v) for g, k, v in rows if g == "hot")] and {len(r["items"]) for r in cut[:-1]} == {100}
    parts = frame.repartitionByRange("g", "k").withColumn("p", F.spark_partition_id()).filter("g = 'hot'").select("p").distinct().count()
    assert parts > 3


def test_ids_of_an_envelope(spark, many_parts):
    view = spark.createDataFrame([("l", i * 7 % 1000, f"mem_{i * 7 % 1000}", None, "c") for i in range(1000)], "ledger string, place int, id string, label string, content string")
    patches = spark.createDataFrame([("l", i, f"patch_{i}") for i in range(3)], "ledger string, ord int, id string")
    one = ledger.container_envelope(view, patches).first()
    assert one.node_ids == [f"mem_{i}" for i in range(1000)] and one.n_nodes == 1000 and one.patch_ids == ["patch_0", "patch_1", "patch_2"]
    assert max(len(r["items"]) for r in ledger.id_blocks(view, "ledger", "place", 64).collect()) == 64
