import json
import random

from pyspark.sql import functions as F

from ledgerloom.functions import text

KEY = "sk-" + "a" * 20


def test_boundaries_and_spaces(spark):
    cases = {
        f"한{KEY}글": "한[REDACTED_OPENAI_KEY]글",
        f"x{KEY}": f"x{KEY}",
        "Bearer " + "t" * 20 + "==": "Bearer [REDACTED_TOKEN]==",
        "bearer　" + "t" * 20: "Bearer [REDACTED_TOKEN]",
        "ghp_" + "b" * 20 + "é": "[REDACTED_GITHUB_TOKEN]é",
        "me@x.org,": "[REDACTED_EMAIL],",
        "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.x for r in rows.select("t", text.redact(F.col("t")).alias("x")).collect()}
    assert got == cases and all(text.redact_text(k) == v for k, v in cases.items())
    strict = spark.createDataFrame([("/home/ann/x /Users/bob　y",)], "t string").select(text.redact(F.col("t"), "strict").alias("x")).first().x
    assert strict == "/home/[REDACTED_USER]/x /Users/[REDACTED_USER]　y"
    assert spark.range(1).select(text.redact(F.lit(KEY), "off").alias("x")).first().x == KEY


def test_numbers_and_cuts(spark):
    texts = [" 12 ", "12f", "NaN", "0x10", "-1.5e3", "", None, "Infinity", "1e999", "."]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.n for r in rows.orderBy("i").select(text.number(F.col("t")).alias("n")).collect()] == [12.0, None, None, 16.0, -1500.0, None, None, None, None, None]
    emoji = spark.range(1).select(text.cut(F.lit("a\U0001f600b"), 3).alias("x"), text.cut(F.lit("abcd"), 3).alias("y")).first()
    assert emoji.x == "a\U0001f600" and emoji.y == "abc"
    assert spark.range(1).select(text.trimmed(F.lit("  x　")).alias("x"), text.trimmed(F.lit("﻿")).alias("y")).first()[:] == ("x", None)


def test_json_walks(spark):
    one = spark.range(1).select(text.redact_json(F.lit('{"me@x.org":["me@x.org",{"k":"v"}]}')).alias("x"), text.redact_json(F.lit("{oops")).alias("y"), text.keys_at_any_depth(F.lit('[{"a":{"TOKEN":1}},{"bucket":2}]'), ("token", "bucket")).alias("z")).first()
    assert one.x == '{"me@x.org":["[REDACTED_EMAIL]",{"k":"v"}]}' and one.y is None and one.z == ["TOKEN", "bucket"]


def test_numbers_of_any_base_and_length(spark):
    cases = {"0x1fffffffffffff": 9007199254740991.0, "0b101": 5.0, "0O17": 15.0, " 0xFFFFFFFFFFFFFFFFFFFF ": float(0xFFFFFFFFFFFFFFFFFFFF), "0x": None, "0b2": None, "0x" + "f" * 300: None, "-0x10": None, "0x" + "0" * 40 + "1": 1.0}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in rows.select("t", text.number(F.col("t")).alias("n")).collect()} == cases


def _walked(value, mode):
    if isinstance(value, str):
        return text.redact_text(value, mode)
    if isinstance(value, list):
        return [_walked(v, mode) for v in value]
    return {k: _walked(v, mode) for k, v in value.items()} if isinstance(value, dict) else value


def _keys(value, wanted):
    if isinstance(value, dict):
        return {k for k in value if k.lower() in wanted}.union(*(_keys(v, wanted) for v in value.values()))
    return set().union(*(_keys(v, wanted) for v in value)) if isinstance(value, list) else set()


def test_json_of_any_shape(spark):
    """Escapes, keys that look like values and values that look like keys, depth 60, long strings: as a recursive walk gives them."""
    rng = random.Random(5)
    strings = ["", "a", KEY, 'q"u', "back\\", "me@x.org", 'x": "y', "\n\t\u0001", "/home/ann/é", "Token", "bucket", "漢😀", "{", "]", "k:"]

    def make(depth):
        kind = rng.randint(0, 5 if depth else 3)
        if kind < 3:
            return (rng.choice(strings), rng.choice([1, -2.5, 1e300, True, None]), rng.choice(strings) + rng.choice(strings))[kind]
        if kind < 5:
            return {rng.choice(strings) + str(i % 2 and rng.random()): make(depth - 1) for i in range(rng.randint(0, 4))}
        return [make(depth - 1) for _ in range(rng.randint(0, 4))]

    values = [make(5) for _ in range(300)]
    deep = "me@x.org"
    for i in range(60):
        deep = {"Token": deep} if i % 2 else [deep]
    values += [deep, {"long": "x\\\"" * 20_000 + "me@x.org"}]
    rows = [(i, json.dumps(v, ensure_ascii=bool(i % 2), indent=i % 3 or None), ("off", "default", "strict")[i % 3]) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, t string, mode string")
    for r in frame.select("i", "mode", text.redact_json(F.col("t"), F.col("mode")).alias("x"), text.keys_at_any_depth(F.col("t"), ("token", "bucket")).alias("k")).collect():
        assert json.loads(r.x) == _walked(values[r.i], r.mode), rows[r.i]
        assert r.k == sorted(_keys(values[r.i], ("token", "bucket")))
    broken = spark.createDataFrame([('{"a":"me@x.org"',), ("",), (None,), ('{"token":1',)], "t string")
    assert all(r.x is None and r.k == [] for r in broken.select(text.redact_json(F.col("t")).alias("x"), text.keys_at_any_depth(F.col("t"), ("token",)).alias("k")).collect())
