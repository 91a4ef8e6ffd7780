import hashlib
import random
import re
import zlib
from collections import defaultdict

import compare
import pytest
from ledgerloom.llm.prefix_trie import CHUNK, TRIE_SQL, conversation_trie, smaller_before

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture
def blocks(spark):
    """Rows are dealt over many blocks, as on a cluster."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def brute(rows):
    """All prefixes of all rebuilt conversations."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32], role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        whole = (own.get(c - c % 20 if c >= 0 else c + -c % 20, [])[:h]) + own[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in members}
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, ids in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(ids) - 1) * words[p]
    return sorted(
        (ids[0], len(p), members[p[:-1]][0] if p else -1, len(ids), len(children[p]) if p in children else 0, leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
        for p, ids in members.items()
    )


def said(frame):
    return sorted(tuple(-1 if v is None else v for v in r) for r in frame.collect())


def talk(rng, n, texts, longest=7):
    rows = []
    for _ in range(n):
        c, turns = rng.choice([rng.randint(-25, 9 * n), 20 * rng.randint(0, n // 3)]), rng.randint(1, longest)
        rows += [(c, t, rng.choice(["user", None, "assistant"][: 1 + t % 3]), rng.choice(texts)) for t in range(turns)]
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_nodes_equal_brute_force(spark, blocks, seed):
    rng = random.Random(seed)
    rows = talk(rng, (30, 120, 200, 200)[seed], ["a b", "a", "", None, "é 漢  x", "one two three"][: 2 + seed])
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", block string, depth int")
    assert said(conversation_trie(frame)) == brute(rows)


def test_copies_over_many_blocks(spark, blocks):
    """A third of all conversations are copies; long ones share most of their turns; others are a prefix of them."""
    rng = random.Random(9)
    deep = [(t, "user", f"turn {t} of many") for t in range(60)]
    rows = [(20 * i + k, *t) for i, k in enumerate([0] * (3 * CHUNK)) for t in deep[:5]]  # the talks below replace a few
    rows += [(1_000_000 + 20 * i, *t) for i in range(40) for t in [*deep[: rng.randint(4, 60)], (99, "user", rng.choice("xyz"))]]
    rows += [(2_000_000 + i, *t) for i in range(30) for t in deep[: i % 6]]
    rows += talk(rng, 300, ["p", "q r", "s"])
    got = said(conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows)
    assert max(r[3] for r in got if r[1] == 5) > 2 * CHUNK


def test_edges(spark, blocks):
    rows = [
        (None, 0, "user", "left out"), (0, None, None, None), (0, 1, "user", "b"), (0, 1, "user", "a"), (0, 1, "user", "a"), (7, None, "user", "z"), (7, None, "assistant", "y"),
        (41, 0, "user", "no head"), (43, 5, "user", "x " * 100_000), (60, 0, "u", "v"), (80, 3, "1:u", "v"),
    ]
    got = said(conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and sum(r[1] == 0 for r in got) == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_trie(empty).count() == 0 and conversation_trie(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0
    alone = spark.createDataFrame([(3, 0, "user", "hello there")], SCHEMA)
    assert said(conversation_trie(alone)) == brute([(3, 0, "user", "hello there")])


def test_nearest_smaller_values():
    rng = random.Random(1)
    for _ in range(200):
        values = [rng.randint(-1, 5) for _ in range(rng.randint(0, 12))]
        assert smaller_before(values) == [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]


def test_nodes_equal_sql(spark, sf):
    from ledgerloom.llm.queries import queries

    assert compare.differences(queries()["op11_prefix_trie"](spark, sf), compare.connect(sf), TRIE_SQL) == ""
