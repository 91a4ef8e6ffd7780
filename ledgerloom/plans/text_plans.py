"""Queries for redaction and scalar functions. The tables hold few secrets, so each text gets some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import backoff_seconds
from ledgerloom.functions.text import keys_at_any_depth, number, redact, redact_json
from ledgerloom.operators import events as ev
from ledgerloom.plans.registry import query, table
from ledgerloom.vocab import FORBIDDEN_KEYS

_W = r"\t\n\x{000B}\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def _sql_redact(text: str, strict: bool = False) -> str:
    rules = [
        (r"\bsk-[A-Za-z0-9_-]{20,}\b", "[REDACTED_OPENAI_KEY]"),
        (r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", "[REDACTED_GITHUB_TOKEN]"),
        (rf"(?i)\bBearer[{_W}]+[A-Za-z0-9._~+/=-]{{20,}}\b", "Bearer [REDACTED_TOKEN]"),
        (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    ]
    if strict:
        rules += [(rf"/Users/[^/{_W}]+", "/Users/[REDACTED_USER]"), (rf"/home/[^/{_W}]+", "/home/[REDACTED_USER]")]
    for pattern, mark in rules:
        text = f"regexp_replace({text}, '{pattern}', '{mark}', 'g')"
    return text


_INJECTED = "text || ' sk-' || md5(CAST(doc_id AS VARCHAR)) || ' 한ghp_' || md5(text) || '글 bearer' || chr(160) || md5(lang) || '== /Users/' || lang || '/x /home/' || source || ' a.b@c.de'"


def _injected(docs: DataFrame):
    return F.concat(
        F.col("text"), F.lit(" sk-"), F.md5(F.col("doc_id").cast("string")), F.lit(" 한ghp_"), F.md5("text"), F.lit("글 bearer" + chr(160)), F.md5("lang"),
        F.lit("== /Users/"), F.col("lang"), F.lit("/x /home/"), F.col("source"), F.lit(" a.b@c.de"),
    )


@query(f"SELECT doc_id, md5({_sql_redact(_INJECTED)}) AS redacted FROM documents")
def redact_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(redact(_injected(docs))).alias("redacted"))


@query(f"SELECT doc_id, md5({_sql_redact(_INJECTED, True)}) AS redacted FROM documents")
def redact_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(redact(_injected(docs), "strict")).alias("redacted"))


@query(f"SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN {_INJECTED} WHEN 1 THEN {_sql_redact(_INJECTED)} ELSE {_sql_redact(_INJECTED, True)} END) AS redacted FROM documents")
def redact_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mode = F.element_at(F.array(F.lit("off"), F.lit("default"), F.lit("strict")), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select("doc_id", F.md5(redact(_injected(docs), mode)).alias("redacted"))


@query("""SELECT conv_id, turn, '{"a":["[REDACTED_EMAIL]",{"sk-key":"x [REDACTED_OPENAI_KEY]","n":' || turn || '}],"who":"' || role || '"}' AS redacted FROM conversations""")
def redact_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String values at any depth; keys stay."""
    text = F.concat(F.lit('{"a":["me@x.org",{"sk-key":"x sk-'), F.md5(F.col("conv_id").cast("string")), F.lit('","n":'), F.col("turn").cast("string"), F.lit('}],"who":"'), F.col("role"), F.lit('"}'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", redact_json(text).alias("redacted"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'mail [REDACTED_EMAIL]' END AS summary,
CASE WHEN event_id % 2 = 0 THEN '/home/[REDACTED_USER]/w' ELSE '/home/u' || user_id || '/w' END AS cwd, substr('[REDACTED_OPENAI_KEY] ' || repeat('t', 130), 1, 120) AS title FROM events""")
def redact_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank texts become null; titles are redacted before they are cut."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(
        "event_id", F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("mail u"), k.cast("string"), F.lit("@x.org"))).alias("summary"), F.lit("").alias("intent"),
        F.concat(F.lit("/home/u"), F.col("user_id").cast("string"), F.lit("/w")).alias("cwd"), F.concat(F.lit("sk-"), F.md5(k.cast("string")), F.lit(" "), F.repeat(F.lit("t"), F.lit(130))).alias("title"),
        F.struct(F.when(k % 2 == 0, "strict").otherwise("default").alias("redaction")).alias("content_policy"),
    )
    return ev.redact_event(rows).select("event_id", "summary", "cwd", "title")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(user_id AS DOUBLE) WHEN 1 THEN CAST(event_id AS DOUBLE) + 0.5 WHEN 4 THEN 16.0 WHEN 5 THEN 1000.0 END AS number FROM events""")
def number_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from texts such as ' 12 ', 12f, NaN, 0x10."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    texts = F.element_at(F.array(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit("\t")), F.concat(k.cast("string"), F.lit(".5")), F.concat(k.cast("string"), F.lit("f")), F.lit("NaN"), F.lit("0x10"), F.lit("1e3")), (k % 6 + 1).cast("int"))
    return e.select("event_id", number(texts).alias("number"))


@query("SELECT event_id, CAST(least(21600, 30 * pow(2, greatest(0, event_id % 12 - 1))) AS BIGINT) AS seconds FROM events")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", backoff_seconds(F.col("event_id") % 12).alias("seconds"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Token,user_id' WHEN 1 THEN 'BUCKET' ELSE '' END AS found FROM events")
def forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden keys at any depth, in any case."""
    k = F.col("event_id")
    deep = F.concat(F.lit('{"p":'), F.col("props"), F.lit(',"list":[{"user_id":1,"deep":{"Token":"t"}}]}'))
    text = F.when(k % 3 == 0, deep).when(k % 3 == 1, F.concat(F.lit('[{"BUCKET":'), F.col("props"), F.lit("}]"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(keys_at_any_depth(text, FORBIDDEN_KEYS), ",").alias("found"))
