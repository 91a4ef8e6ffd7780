"""Queries on what leaves the ledger, on events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import documents, uploads, usage_table
from ledgerloom.plans.outbox_plans import ITEMS, drained
from ledgerloom.plans.registry import query, table
from ledgerloom.session import shared_dir
from ledgerloom.sources import upload_sink


@query("""SELECT strftime(ts, '%Y-%m-%dT%H-%M-%S') || '-000Z-' || event_id || '.json' AS name, 'mail [REDACTED_EMAIL]' AS summary, CASE WHEN event_id % 2 = 0 THEN '/home/[REDACTED_USER]/w' ELSE '/home/u' || user_id || '/w' END AS cwd FROM events""")
def enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events redacted, written to the queue and read back."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(
        k.cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("created_at"), F.concat(F.lit("mail u"), k.cast("string"), F.lit("@x.org")).alias("summary"), F.lit("").alias("intent"), F.lit("t").alias("title"),
        F.concat(F.lit("/home/u"), F.col("user_id").cast("string"), F.lit("/w")).alias("cwd"), F.struct(F.when(k % 2 == 0, "strict").otherwise("default").alias("redaction")).alias("content_policy"),
    )
    path = f"{shared_dir(spark)}/queue"
    uploads.enqueue(rows, path)
    return spark.read.parquet(path).select("name", F.get_json_object("content", "$.summary").alias("summary"), F.get_json_object("content", "$.cwd").alias("cwd"))


@query(f"WITH {ITEMS} SELECT event_id, outcome FROM d WHERE outcome NOT IN ('delivered')")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that stay and items in quarantine, together all that were not delivered."""
    path = f"{shared_dir(spark)}/quarantine"
    stay = uploads.quarantine(drained(spark, sf_dir), path)
    return stay.select("event_id", "outcome").unionByName(spark.read.parquet(path).select("event_id", "outcome"))


@query("SELECT user_id, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def usage_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of usage merged one after the other: one of them twice, the last one first, and one by a stream that begins anew."""
    rows, path = table(spark, sf_dir, "events").select("user_id", "event_id", "value"), f"{shared_dir(spark)}/usage"
    for batch in (2, 0, 0):
        usage_table.usage_sink(path, "user_id", "event_id", buckets=8)(rows.filter(F.col("event_id") % 3 == batch), batch)
    usage_table.usage_sink(path, "user_id", "event_id")(rows.filter("event_id % 3 = 1"), 0)
    return usage_table.UsageTable(path, "user_id", "event_id").read(spark, "user_id bigint, event_id bigint, value double")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'job' || user_id ELSE 'e' || event_id END AS id FROM events")
def job_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    jobs = F.when(k == 1, F.array(F.struct(F.concat(F.lit("job"), F.col("user_id").cast("string")).alias("job_id")))).otherwise(F.array().cast("array<struct<job_id:string>>"))
    return table(spark, sf_dir, "events").select("event_id", uploads.job_id(F.when(k == 0, "own"), jobs, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("id"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'n' || user_id WHEN event_id % 3 = 0 THEN 'flat' END AS org FROM events")
def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    nested = F.when(k % 2 == 0, F.concat(F.lit(" n"), F.col("user_id").cast("string"))).otherwise(" ")
    return table(spark, sf_dir, "events").select("event_id", uploads.identity(nested, F.when(k % 3 == 0, "flat ")).alias("org"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN FALSE ELSE ts + INTERVAL 24 HOUR <= TIMESTAMP '2024-01-15 00:00:00' END AS due FROM events")
def refresh_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due a day after the event; a time that can't be read never is."""
    after = F.date_format(uploads.hours_later(F.col("ts").cast("timestamp"), 24), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, sf_dir, "events").select("event_id", uploads.refresh_due(F.when(F.col("event_id") % 3 == 2, "soon").otherwise(after), F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("due"))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN CAST(trunc((event_id - 50) + CASE WHEN event_id >= 50 THEN 0.7 ELSE -0.7 END + CASE WHEN event_id = 50 THEN 0 ELSE 0 END) AS BIGINT) END AS n FROM events")
def integer_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of numbers cut towards zero."""
    k = F.col("event_id") - 50
    text = F.concat(F.when(k < 0, F.concat(F.lit("-"), (-k).cast("string"))).otherwise(k.cast("string")), F.when(F.col("event_id") % 4 == 3, "px").otherwise(".7"))
    return table(spark, sf_dir, "events").select("event_id", uploads.whole_number(text).alias("n"))


@query("""SELECT event_id, array_to_string(list_concat(CASE WHEN event_id % 3 = 0 THEN [] ELSE ['a' || user_id, 'b'] END, ['ours:new']), ',') AS groups, CASE WHEN event_id % 3 > 0 THEN 'a' || user_id || ',b' END AS removed FROM events""")
def keep_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Our entries replaced, or removed; foreign ones stay."""
    mine = lambda g: F.startswith(g, F.lit("ours:"))
    groups = F.when(F.col("event_id") % 3 > 0, F.array(F.concat(F.lit("a"), F.col("user_id").cast("string")), F.lit("ours:old"), F.lit("b")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(uploads.keep_foreign(groups, F.array(F.lit("ours:new")), mine), ",").alias("groups"), F.array_join(uploads.without_ours(groups, mine), ",").alias("removed"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'upload requires a filename' WHEN 1 THEN 'upload requires text or base64' WHEN 2 THEN 'upload accepts either text or base64, not both' END AS problem,
CASE event_id % 5 WHEN 3 THEN props WHEN 4 THEN 't' || event_id END AS content, CASE WHEN event_id % 2 = 0 THEN 'text/html' ELSE 'text/plain' END AS content_type,
'chunk_size=' || event_id || CASE WHEN event_id % 2 = 1 THEN ';collection_id=c' ELSE '' END AS fields FROM events""")
def upload_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to upload a text or base64, with their problems and fields."""
    k, text = F.col("event_id") % 5, F.concat(F.lit("t"), F.col("event_id").cast("string"))
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(k == 0, " ").otherwise("f.txt").alias("filename"), F.when(k.isin(2, 4), text).alias("text"), F.when(k.isin(2, 3), F.base64(F.encode("props", "UTF-8"))).alias("content_base64"),
        F.when(F.col("event_id") % 2 == 0, "text/html").alias("content_type"), none.alias("ocr_strategy"), F.concat(F.col("event_id").cast("string"), F.lit(".9")).alias("chunk_size"), F.lit("many").alias("chunk_overlap"), F.when(F.col("event_id") % 2 == 1, " c").alias("collection_id"),
    )
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return uploads.upload_form(rows).select("event_id", "problem", F.decode("bytes", "UTF-8").alias("content"), "content_type", fields.alias("fields"))


@query("""WITH b AS (SELECT user_id % 40 AS n, * FROM events),
u AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN n < 25 THEN 'b' || n WHEN event_id % 2 = 0 THEN md5(CAST(n AS VARCHAR)) ELSE 'default' END AS bucket_id,
  CASE WHEN n < 25 AND event_id % 3 > 0 THEN 'c' || n || '-' || event_type END AS collection_id,
  CASE WHEN event_id % 3 > 0 THEN event_type ELSE 'daily_log' END AS collection, strftime(ts, '%Y-%m-%d') AS day, * EXCLUDE (event_id) FROM b)
SELECT event_id, bucket_id, collection_id, collection || '-' || day || '-' || event_id || '.json' AS file_name,
  'mail [REDACTED_EMAIL]' AS summary, '{"deep":[{"who":"[REDACTED_EMAIL]"}],"n":' || user_id || '}' AS event_metadata, '[REDACTED_OPENAI_KEY] done' AS title,
  'collection=' || collection || ';event_kind=ai_job_summary;harness=h;job_status=completed;job_title=[REDACTED_OPENAI_KEY] done;job_type=' || event_type || CASE WHEN event_id::BIGINT % 5 = 0 THEN
  ';ledger_node_ids=mem_' || user_id || ',mem_x;ledger_schema_version=l/1;memory_format=ledger' ELSE '' END || CASE WHEN event_id::BIGINT % 2 = 0 THEN ';repo=r' ELSE '' END || ';source=hook' AS metadata FROM u""")
def upload_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents, written by tasks, committed, and read back."""
    e, k, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id") % 40
    none, text = F.lit(None).cast("string"), k.cast("string")
    rows = e.select(
        text.alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("created_at"), F.lit("hook").alias("source"), F.lit("h").alias("harness"), F.lit("ai_job_summary").alias("event_kind"),
        *(none.alias(c) for c in ("org_id", "user_id", "session_id", "schema_version", "kind", "intent", "cwd", "branch", "service")),
        F.when(u < 25, F.concat(F.lit("name"), u.cast("string"))).when(k % 2 == 0, F.md5(u.cast("string"))).alias("bucket"), F.when(k % 3 > 0, F.col("event_type")).alias("collection"),
        F.col("event_type").alias("job_type"), F.lit("completed").alias("job_status"), F.concat(F.lit("sk-"), F.md5(text), F.lit(" done")).alias("title"), F.concat(F.lit("mail u"), text, F.lit("@x.org")).alias("summary"),
        F.when(k % 2 == 0, "r").alias("repo"), F.struct(F.lit("default").alias("redaction")).alias("content_policy"),
        F.concat(F.lit('{"deep": [{"who": "u'), text, F.lit('@x.org"}], "n": '), F.col("user_id").cast("string"), F.lit("}")).alias("metadata"),
        F.when(k % 5 == 0, F.concat(F.lit('{"schema_version":"l/1","node_ids":["mem_'), F.col("user_id").cast("string"), F.lit('","mem_x"]}'))).alias("ledger"),
    )
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    buckets = n.select(F.concat(F.lit("b"), F.col("n").cast("string")).alias("id"), F.concat(F.lit("name"), F.col("n").cast("string")).alias("name"), F.col("n").alias("ord"))
    collections = e.filter(u < 25).select(u.alias("n"), "event_type").distinct().select(
        F.concat(F.lit("b"), F.col("n").cast("string")).alias("bucket_id"), F.concat(F.lit("c"), F.col("n").cast("string"), F.lit("-"), "event_type").alias("id"), F.col("event_type").alias("name"), F.col("n").alias("ord"),
    )
    path = f"{shared_dir(spark)}/uploads"
    upload_sink.write_uploads(documents.uploads(rows, buckets, collections), path)
    back = upload_sink.read_uploads(spark, path, documents.UPLOAD)
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(F.from_json("metadata", "map<string,string>"))), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")
    return back.select("event_id", "bucket_id", "collection_id", "file_name", F.get_json_object("content", "$.summary").alias("summary"), F.get_json_object("content", "$.metadata").alias("event_metadata"), F.get_json_object("content", "$.title").alias("title"), pairs.alias("metadata"))
