"""Events as documents to upload: where they go, what they hold, and what is said about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.events import file_name, flat_metadata, redact_event
from ledgerloom.operators.search import is_bucket_id, resolve, resolve_within

# An event's blocks of JSON, the parts of its ledger block, and where it goes by default.
BLOCKS = ("metadata", "service", "ledger")
LEDGER = "struct<schema_version:string,session_id:string,node_ids:array<string>,patch_ids:array<string>,source_labels:array<string>>"
BUCKET, COLLECTION = "default", "daily_log"
UPLOAD = "event_id string, bucket_id string, collection_id string, file_name string, content string, metadata string"


def uploads(events: DataFrame, buckets: DataFrame, collections: DataFrame, memory_format: str = "ledger") -> DataFrame:
    """One row (UPLOAD) an event: bucket and collection by id, file name, the redacted event as JSON, and its flat metadata as JSON.

    ``events``: id, created_at, source, harness, event_kind, org_id, user_id, session_id, bucket, collection, schema_version, kind, job_type,
    job_status, title, summary, intent, cwd, repo, branch, content_policy and BLOCKS as JSON texts. ``buckets``: id, name, ord;
    ``collections``: bucket_id, id, name, ord. A bucket that nobody knows stays as it is named, such a collection has no id.
    """
    hidden = redact_event(events, BLOCKS).withColumns({"asked_": F.coalesce("bucket", F.lit(BUCKET)), "named_": F.coalesce("collection", F.lit(COLLECTION))})
    placed = resolve(hidden, buckets, "asked_", fallback=True).withColumn("bucket_id", F.when(is_bucket_id(F.col("asked_")), F.col("asked_")).otherwise(F.col("resolved"))).drop("resolved")
    placed = resolve_within(placed, collections, "bucket_id", "named_").withColumnRenamed("resolved", "collection_id")
    block = F.from_json("ledger", LEDGER)
    always = {"source": F.col("source"), "harness": F.col("harness"), "event_kind": F.col("event_kind"), "collection": F.col("named_"), "job_type": F.col("job_type"), "job_status": F.col("job_status"), "job_title": F.col("title")}
    filled = {c: F.col(c) for c in ("org_id", "user_id", "session_id", "repo", "branch")} | {
        "envelope_schema_version": F.col("schema_version"), "envelope_kind": F.col("kind"), "memory_format": F.when(F.col("ledger").isNotNull(), memory_format),
        f"{memory_format}_schema_version": block["schema_version"], f"{memory_format}_session_id": block["session_id"],
    }
    flat = flat_metadata(always, filled, {f"{memory_format}_{c}": block[c] for c in ("node_ids", "patch_ids", "source_labels")})
    own = [c for c in events.columns if c not in BLOCKS]
    content = F.to_json(F.struct(*own, *(F.try_parse_json(F.col(c)).alias(c) for c in BLOCKS if c in events.columns)))
    return placed.select(F.col("id").alias("event_id"), "bucket_id", "collection_id", file_name(F.col("collection"), F.col("created_at"), F.col("id"), COLLECTION).alias("file_name"), content.alias("content"), F.to_json(flat).alias("metadata"))
