"""Events, their envelopes, their redaction, and what is uploaded of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import cut, first_filled, redact, redact_json
from ledgerloom.vocab import EVENT_KIND

# UTF-16 units of titles, and of errors: of no answer, of an answer, of a check, of a failed hook.
TITLE, USAGE_TITLE = 120, 200
NO_ANSWER, ANSWER, CHECK, FAILURE = 200, 300, 240, 500


def construct(rows: DataFrame, keep_kind: bool = False) -> DataFrame:
    """Events from rows with id, created_at, source, job_type and tags: one kind (unless ``keep_kind``), default tags, policy."""
    kind = F.coalesce("event_kind", F.lit(EVENT_KIND)) if keep_kind and "event_kind" in rows.columns else F.lit(EVENT_KIND)
    policy = F.struct(F.lit(False).alias("raw_transcript"), F.lit("selected").alias("artifacts"), F.coalesce("redaction", F.lit("default")).alias("redaction"))
    tags = F.coalesce("tags", F.array(F.concat(F.lit("source:"), "source"), F.concat(F.lit("job:"), "job_type")))
    return rows.withColumns({"event_kind": kind, "content_policy": policy, "tags": tags})


def envelope(events: DataFrame, schema_version: str, kind: str, format_name: str) -> DataFrame:
    """Events with schema version, kind and format tag; the summary is the event's own, else its payload's."""
    mark = F.array(F.lit(f"format:{format_name}"))
    return events.withColumns({"schema_version": F.lit(schema_version), "kind": F.lit(kind), "summary": F.coalesce("summary", "payload"), "tags": F.array_union(F.col("tags"), mark)})


def source_of(command: Column) -> Column:
    return F.when(F.startswith(command, F.lit("hook")), "hook").otherwise("manual")


def status_of(command: Column) -> Column:
    return F.when(F.contains(command, F.lit("fail")), "failed").otherwise("completed")


def redact_event(events: DataFrame, blocks: tuple[str, ...] = ("metadata",)) -> DataFrame:
    """Hide secrets in title, summary, intent and folder by each event's own mode; blank ones become null. Redaction comes before the title is cut.

    ``blocks`` name columns of JSON text; those that are there are redacted at any depth. A block that is no JSON is redacted as a text.
    """
    mode = F.col("content_policy.redaction")
    hidden = {c: F.nullif(redact(F.col(c), mode), F.lit("")) for c in ("summary", "intent", "cwd")}
    nested = {c: F.coalesce(redact_json(F.col(c), mode), redact(F.col(c), mode)) for c in blocks if c in events.columns}
    return events.withColumns(hidden | nested | {"title": cut(redact(F.col("title"), mode), TITLE)})


def flat_metadata(fixed: dict[str, Column], optional: dict[str, Column], lists: dict[str, Column]) -> Column:
    """map<string,string>: fixed keys always, optional ones when filled, arrays comma-joined when not empty."""
    pairs = [(k, F.coalesce(v, F.lit(""))) for k, v in fixed.items()]
    loose = [(k, v) for k, v in optional.items()] + [(k, F.array_join(v, ",")) for k, v in lists.items()]
    always = F.create_map(*(x for k, v in pairs for x in (F.lit(k), v)))
    if not loose:
        return always
    return F.map_concat(always, F.map_filter(F.create_map(*(x for k, v in loose for x in (F.lit(k), v))), lambda k, v: F.coalesce(v, F.lit("")) != ""))


def queue_name(created_at: Column, event_id: Column) -> Column:
    return F.concat(F.regexp_replace(created_at, "[:.]", "-"), F.lit("-"), event_id, F.lit(".json"))


def file_name(collection: Column, created_at: Column, event_id: Column, default: str = "daily_log") -> Column:
    return F.concat(F.concat_ws("-", F.coalesce(collection, F.lit(default)), F.substring(created_at, 1, 10), event_id), F.lit(".json"))


def route(session: Column, environment: Column, payload: Column, config: Column, default: str) -> Column:
    """The first bucket that is set; the environment's counts even when blank."""
    return F.coalesce(first_filled(session), environment, first_filled(payload), first_filled(config), F.lit(default))


# An event's usage, and what else is uploaded beside it.
USAGE = ("model", "input_tokens", "output_tokens", "cached_tokens", "total_tokens", "cost_usd", "tools", "turns")
BESIDE_USAGE = ("harness", "user_id", "status", "repo", "branch")


def usage_row(events: DataFrame) -> DataFrame:
    """What is uploaded of an event's usage, if it has any: its title redacted and cut, the count of requests left out."""
    title = cut(redact(F.col("title")), USAGE_TITLE)
    there = [c for c in USAGE if c in events.columns]
    known = F.coalesce(*(F.col(c).cast("string") for c in (*there, *(["requests"] if "requests" in events.columns else [])))).isNotNull()
    return events.filter(known).select("event_id", "session_id", *(c for c in BESIDE_USAGE if c in events.columns), *there, title.alias("title"))


def delivery_error(status: Column, error: Column) -> Column:
    """What is kept of an upload's error: of one without an answer (status 0) less than of an answer's text; nothing of a success."""
    return F.when(status.between(200, 299), None).when(status == 0, cut(error, NO_ANSWER)).otherwise(cut(error, ANSWER))


def failure_event(failures: DataFrame) -> DataFrame:
    """Events of hooks that failed, from rows with id, created_at, source, command and error: the error is redacted, then cut, and the job counts as failed."""
    rows = failures.withColumns({"job_type": F.lit("hook"), "job_status": F.lit("failed"), "title": F.concat("source", F.lit(" hook "), "command"), "tags": F.lit(None).cast("array<string>"), "redaction": F.lit(None).cast("string")})
    return construct(rows.withColumn("summary", cut(redact(F.col("error")), FAILURE)).drop("error"))
