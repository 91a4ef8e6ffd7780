"""Queries on session activity: conversations as transcripts, events as payloads and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import activity, usage
from ledgerloom.operators import events as ev
from ledgerloom.operators.outbox import revoked
from ledgerloom.plans.registry import query, table
from ledgerloom.sources.records import config_of, parse_payload, transcript_lines
from ledgerloom.sources.records import payload_keys as sorted_keys


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines made of conversations: assistants' turns carry usage; some lines are broken or blank."""
    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    name = F.concat(F.when(n % 2 == 0, " ").otherwise(""), F.lit("t"), (n % 4).cast("string"))
    model = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("m"), F.col("turn").cast("string"))).otherwise(" ").alias("model")
    content = F.array(F.struct(F.lit("tool_use").alias("type"), name.alias("name")), F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("name"))).alias("content")
    usage_of = lambda kind: F.struct(n.cast(kind).alias("input_tokens"), (n % 7).cast("bigint").alias("cache_creation_input_tokens"), (n % 5).cast(kind).alias("cache_read_input_tokens"), F.when(n % 2 == 0, n.cast("double")).alias("output_tokens"))
    line_of = lambda kind: F.to_json(F.struct(F.struct(model, content, F.when(F.col("role") == "assistant", usage_of(kind)).alias("usage")).alias("message")))
    said = F.when(n % 3 == 0, line_of("string")).otherwise(line_of("bigint"))
    line = F.when(F.col("turn") % 11 == 10, "{broken").when(F.col("turn") % 11 == 9, " ").otherwise(said)
    return transcript_lines(c.select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), line.alias("value")))


@query("""WITH u AS (SELECT conv_id AS session, turn, length(text) AS n FROM conversations WHERE role = 'assistant' AND turn % 11 NOT IN (9, 10))
SELECT session, max_by('m' || turn, turn) FILTER (turn % 3 <> 0) AS model, CAST(sum(n + n % 7) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN n % 2 = 0 THEN n ELSE 0 END) AS BIGINT) AS output_tokens,
CAST(sum(n + n % 7 + CASE WHEN n % 2 = 0 THEN n ELSE 0 END) AS BIGINT) AS total_tokens, CAST(nullif(sum(n % 5), 0) AS BIGINT) AS cached_tokens, count(*) AS requests, count(*) AS turns FROM u GROUP BY session""")
def transcript_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.transcript_usage(transcript(spark, sf_dir).select("session", "ord", "message.model", "message.usage"))


@query("""WITH t AS (SELECT conv_id AS session, 't' || (length(text) % 4) AS name, turn FROM conversations WHERE turn % 11 NOT IN (9, 10)),
c AS (SELECT session, name, count(*) AS n, min(turn) AS seen FROM t GROUP BY ALL) SELECT session, string_agg(name || ':' || n, ',' ORDER BY n DESC, seen) AS tools FROM c GROUP BY session""")
def tool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = transcript(spark, sf_dir).select("session", "ord", F.explode("message.content").alias("c")).filter("c.type = 'tool_use'").select("session", "ord", "c.name")
    return activity.tool_counts(uses).select("session", F.array_join(F.transform("tools", lambda t: F.concat_ws(":", t["name"], t["count"].cast("string"))), ",").alias("tools"))


@query("""WITH p AS (SELECT event_id, ['a' || (event_id % 3), 'b', 'a' || (user_id % 3), ''] AS names FROM events), u AS (SELECT event_id, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM p),
c AS (SELECT event_id, name, count(*) AS n, min(pos) AS seen FROM u WHERE name <> '' GROUP BY ALL) SELECT event_id, string_agg(name || ':' || n, ',' ORDER BY seen) AS tools FROM c GROUP BY event_id""")
def payload_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and objects with a name; blanks around a name don't count."""
    k, u = (F.col("event_id") % 3).cast("string"), (F.col("user_id") % 3).cast("string")
    text = F.concat(F.lit('{"tools_used":["a'), k, F.lit('",{"name":" b "},"  a'), u, F.lit('"," ",{"x":1},7]}'))
    rows = table(spark, sf_dir, "events").select("event_id", activity.payload_tool_names(F.parse_json(text)).alias("names"))
    found = activity.payload_tools(rows, "event_id")
    return found.select("event_id", F.array_join(F.transform("tools", lambda t: F.concat_ws(":", t["name"], t["count"].cast("string"))), ",").alias("tools"))


def _payload() -> object:
    k, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    kinds = (
        F.lit('{"model":" m ","usage":{},"tokenUsage":{"input_tokens":5},"total_cost_usd":"2.5"}'),
        F.concat(F.lit('{"usage":7,"token_usage":{"prompt_tokens":" '), k, F.lit(' ","completion_tokens":'), u, F.lit(',"cost_usd":0.5,"requests":3}}')),
        F.concat(F.lit('{"usage":{"input_tokens":"12f","output_tokens":'), u, F.lit(',"total_tokens":99,"model":"x","cached_input_tokens":4},"num_requests":2}')),
        F.concat(F.lit('{"usage":[1],"tokenUsage":{"inputTokens":5,"outputTokens":7.0,"cacheReadInputTokens":"0x10"},"cost_usd":true,"message":{"model":"n"}}')),
        F.concat(F.lit('{"message":{"usage":{"input_tokens":'), k, F.lit(',"cache_read_input_tokens":1,"tokens":9}}}')),
        F.lit("no json"),
    )
    return F.element_at(F.array(*kinds), (F.col("event_id") % 6 + 1).cast("int"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'm' WHEN 2 THEN 'x' WHEN 3 THEN 'n' END AS model, CASE event_id % 6 WHEN 1 THEN event_id WHEN 3 THEN 5 WHEN 4 THEN event_id END AS input_tokens,
CASE event_id % 6 WHEN 1 THEN user_id WHEN 2 THEN user_id WHEN 3 THEN 7 END AS output_tokens, CASE event_id % 6 WHEN 1 THEN event_id + user_id WHEN 2 THEN user_id WHEN 3 THEN 12 WHEN 4 THEN event_id END AS total_tokens,
CASE event_id % 6 WHEN 2 THEN 4 WHEN 3 THEN 16 WHEN 4 THEN 1 END AS cached_tokens, CASE event_id % 6 WHEN 0 THEN 2.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS cost_usd, CASE event_id % 6 WHEN 1 THEN 3 WHEN 2 THEN 2 END AS requests FROM events""")
def payload_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first object wins even when empty, fields by any of their names, the total always recomputed."""
    rows = table(spark, sf_dir, "events").select("event_id", _payload().alias("payload"))
    return activity.payload_usage(rows, "event_id").select("event_id", "model", "input_tokens", "output_tokens", "total_tokens", F.col("cached_tokens").cast("int").alias("cached_tokens"), "cost_usd", F.col("requests").cast("int").alias("requests"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 1 OR event_id % 2 = 0 THEN 'hook_payload' WHEN user_id % 2 = 0 THEN 'transcript' ELSE 'none' END AS source FROM events")
def activity_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", activity.activity_source((k % 3 != 1) | (k % 2 == 0), F.col("user_id") % 2 == 0).alias("source"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'k' WHEN 1 THEN 'raw' END AS first_key FROM events""")
def payload_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON, text that is none, and blanks."""
    k = F.col("event_id")
    text = F.when(k % 3 == 0, F.col("props")).when(k % 3 == 1, F.concat(F.lit("not json "), F.col("event_type"))).otherwise("  ")
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(F.json_object_keys(F.to_json(parse_payload(text))), F.lit(1)).alias("first_key"))


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN json_extract_string(props, '$.k') END AS setting FROM events""")
def config_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A setting of configurations, some of them broken or missing."""
    k = F.col("event_id") % 4
    text = F.when(k < 2, F.col("props")).when(k == 2, F.concat(F.col("props"), F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(config_of(text), "$.k", "string").alias("setting"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a,b,z' ELSE 'k' END AS keys FROM events""")
def payload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 2 == 0, F.lit('{"z":1,"a":{"q":2},"b":[]}')).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(sorted_keys(text), ",").alias("keys"))


@query("""SELECT event_id, 'ai_job_summary' AS event_kind, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'source:' || CASE WHEN event_type[1] = 'c' THEN 'hook' ELSE 'manual' END || ',job:' || event_type END AS tags,
CASE WHEN event_id % 3 = 0 THEN 'strict' ELSE 'default' END AS redaction FROM events""")
def event_construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind whatever the caller says, default tags, policy."""
    k = F.col("event_id")
    command = F.when(F.startswith("event_type", F.lit("c")), "hook run").otherwise("cli")
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("session_ended").alias("event_kind"), ev.source_of(command).alias("source"), F.col("event_type").alias("job_type"), F.when(k % 2 == 0, F.array(F.lit("own"))).alias("tags"), F.when(k % 3 == 0, "strict").alias("redaction"))
    return ev.construct(rows).select("event_id", "event_kind", F.array_join("tags", ",").alias("tags"), "content_policy.redaction")


@query("SELECT event_id, 'envelope/1' AS schema_version, 'memory' AS kind, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE props END AS summary, event_type || ',format:ledger' AS tags FROM events")
def envelope_construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "own").alias("summary"), F.col("props").alias("payload"), F.array("event_type").alias("tags"))
    return ev.envelope(rows, "envelope/1", "memory", "ledger").select("event_id", "schema_version", "kind", "summary", F.array_join("tags", ",").alias("tags"))


@query("""SELECT doc_id, 'event_kind=' || 'ai_job_summary' || ';' || CASE WHEN doc_id % 2 = 0 THEN 'lang=' || lang || ';' ELSE '' END || CASE WHEN doc_id % 3 > 0 THEN 'node_ids=' || array_to_string(range(doc_id % 3), ',') || ';' ELSE '' END || 'source=' || source AS metadata FROM documents""")
def metadata_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed keys, filled optional ones, joined lists."""
    k = F.col("doc_id")
    ids = F.when(k % 3 > 0, F.transform(F.sequence(F.lit(0), k % 3 - 1), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    flat = ev.flat_metadata({"source": F.col("source"), "event_kind": F.lit(ev.EVENT_KIND)}, {"lang": F.when(k % 2 == 0, F.col("lang")).otherwise("")}, {"node_ids": ids})
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(flat)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return table(spark, sf_dir, "documents").select("doc_id", pairs.alias("metadata"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'daily_log' END || '-' || strftime(ts, '%Y-%m-%d') || '-' || event_id || '.json' AS file, strftime(ts, '%Y-%m-%dT%H-%M-%S') || '-000Z-' || event_id || '.json' AS queued FROM events")
def event_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    created, k = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'"), F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select("event_id", ev.file_name(F.when(F.col("event_id") % 2 == 0, "x"), created, k).alias("file"), ev.queue_name(created, k).alias("queued"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN '' WHEN event_id % 4 = 2 AND user_id % 2 = 0 THEN 'p' || user_id ELSE 'cfg' END AS bucket FROM events")
def route_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session, environment (even blank), payload, configuration."""
    k, u = F.col("event_id") % 4, F.col("user_id")
    session, env = F.when(k == 0, F.concat(F.lit(" "), "event_type")).otherwise(" "), F.when(k == 1, "")
    payload = F.when((k == 2) & (u % 2 == 0), F.concat(F.lit("p"), u.cast("string"))).otherwise(" ")
    return table(spark, sf_dir, "events").select("event_id", ev.route(session, env, payload, F.lit("cfg"), "default").alias("bucket"))


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("session_id"), "ts", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("model"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 100).alias("input_tokens"), F.lit(None).cast("bigint").alias("output_tokens"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 100).alias("total_tokens"), F.lit(None).cast("double").alias("cost_usd"), F.concat(F.repeat(F.col("event_type"), F.lit(60)), F.lit(" u@x.org")).alias("title"))


@query("SELECT event_id, user_id AS session_id, event_type AS model, event_id % 100 AS total_tokens, substr(repeat(event_type, 60) || ' [REDACTED_EMAIL]', 1, 200) AS title FROM events WHERE event_id % 5 <> 0")
def usage_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upload of usage; titles are redacted first, then cut."""
    return ev.usage_row(usage_events(spark, sf_dir)).select("event_id", "session_id", "model", "total_tokens", "title")


@query("SELECT event_id // 3 AS key, min(event_id) AS first_id FROM events GROUP BY ALL")
def usage_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload an event."""
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("key"), F.col("event_id").alias("first_id"))
    return usage.dedupe(rows, "key", "first_id")


@query("SELECT user_id AS session_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_id % 100, (ts, event_id)) AS total_tokens FROM events WHERE event_id % 5 <> 0 GROUP BY user_id")
def usage_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last totals of each session."""
    rows = usage_events(spark, sf_dir).filter("total_tokens is not null").select("session_id", "event_id", "total_tokens", "ts")
    return usage.latest(rows, "session_id", "ts", "event_id").select("session_id", "event_id", "total_tokens")


@query("""WITH e AS (SELECT user_id, event_id, value FROM events) SELECT user_id, max(event_id) AS event_id FROM e GROUP BY user_id""")
def usage_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging new rows into a table of latest ones."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id")
    old = usage.latest(rows.filter("event_id % 2 = 0"), "user_id", "event_id")
    return usage.upsert(old, rows.filter("event_id % 2 = 1"), "user_id", "event_id")


@query("SELECT user_id, bool_or(event_id % 97 = 1) AS revoked FROM events GROUP BY user_id")
def auth_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(revoked(F.when(F.col("event_id") % 97 == 1, 401).otherwise(200)).alias("revoked"))


@query("""SELECT event_id, substr(repeat('e' || event_id, 90), 1, CASE event_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 300 END) AS kept FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 3 = 2""")
def delivery_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of errors without an answer, of answers, and of successes."""
    k = F.col("event_id")
    status = F.when(k % 3 == 0, 0).when(k % 3 == 1, 503).otherwise(201)
    return table(spark, sf_dir, "events").select("event_id", ev.delivery_error(status, F.repeat(F.concat(F.lit("e"), k.cast("string")), F.lit(90))).alias("kept"))


@query("""SELECT CAST(event_id AS VARCHAR) AS id, 'ai_job_summary' AS event_kind, 'failed' AS job_status, 'hook hook ' || event_type AS title, substr('[REDACTED_OPENAI_KEY] ' || repeat('x' || user_id, 300), 1, 500) AS summary, 'source:hook,job:hook' AS tags FROM events""")
def failure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of failed hooks: errors redacted before they are cut."""
    k = F.col("event_id").cast("string")
    error = F.concat(F.lit("sk-"), F.md5(k), F.lit(" "), F.repeat(F.concat(F.lit("x"), F.col("user_id").cast("string")), F.lit(300)))
    rows = table(spark, sf_dir, "events").select(k.alias("id"), F.col("ts").alias("created_at"), F.lit("hook").alias("source"), F.col("event_type").alias("command"), error.alias("error"))
    return ev.failure_event(rows).select("id", "event_kind", "job_status", "title", "summary", F.array_join("tags", ",").alias("tags"))
