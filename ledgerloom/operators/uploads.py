"""What leaves the ledger: queued events, quarantined items, upload forms, and the small rules beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import first_filled, number, trimmed
from ledgerloom.operators.events import queue_name, redact_event


def queued(events: DataFrame) -> DataFrame:
    """(name, content): events as queued items, redacted, as pretty JSON."""
    hidden = redact_event(events)
    return hidden.select(queue_name(F.col("created_at"), F.col("id")).alias("name"), F.to_json(F.struct(*hidden.columns), {"pretty": "true"}).alias("content"))


def enqueue(events: DataFrame, path: str) -> None:
    """Append redacted events to the queue's table; Spark commits a write as a whole or not at all."""
    queued(events).write.mode("append").parquet(path)


def quarantine(drained: DataFrame, path: str) -> DataFrame:
    """Append the quarantined items, state and all, to their table, and give those that stay in the queue. Nothing is deleted."""
    drained.filter("outcome = 'quarantined'").write.mode("append").parquet(path)
    return drained.filter("outcome not in ('quarantined', 'delivered')")


def job_id(own: Column, jobs: Column, event_id: Column) -> Column:
    """The id of an upload: its own, else its first job's, else the event's."""
    return F.coalesce(own, F.try_element_at(jobs, F.lit(1))["job_id"], event_id)


def identity(nested: Column, flat: Column) -> Column:
    """An identity's field: the nested one, else the flat one; blanks don't count."""
    return first_filled(nested, flat)


def refresh_due(refresh_after: Column, now: Column) -> Column:
    """Whether a time that can be read has come."""
    return F.coalesce(F.try_to_timestamp(refresh_after) <= now, F.lit(False))


def hours_later(at: Column, hours: Column | int) -> Column:
    return at + F.make_dt_interval(hours=F.lit(hours) if isinstance(hours, int) else hours)


def whole_number(text: Column) -> Column:
    """A number from its text, cut towards zero."""
    return number(text).cast("bigint")


def keep_foreign(groups: Column, ours: Column, is_ours) -> Column:
    """An array with our entries replaced by ``ours`` at its end; all others stay as they are. A null array is an empty one."""
    return F.concat(F.coalesce(F.filter(groups, lambda g: ~is_ours(g)), F.array().cast("array<string>")), ours)


def without_ours(groups: Column, is_ours) -> Column:
    """An array without our entries; null if none is left."""
    kept = F.filter(groups, lambda g: ~is_ours(g))
    return F.when(F.size(kept) > 0, kept)


def upload_form(args: DataFrame) -> DataFrame:
    """Upload requests with ``problem`` (null if there is none), ``bytes`` and the filled fields of their form.

    ``args``: filename, text, content_base64, content_type, ocr_strategy, chunk_size, chunk_overlap, collection_id, all texts. Either text or base64 must be there, not both.
    """
    filled = {c: trimmed(F.col(c)).isNotNull() for c in ("filename", "text", "content_base64")}
    problem = (
        F.when(~filled["filename"], "upload requires a filename").when(~filled["text"] & ~filled["content_base64"], "upload requires text or base64").when(filled["text"] & filled["content_base64"], "upload accepts either text or base64, not both")
    )
    content = F.when(filled["content_base64"], F.try_to_binary("content_base64", F.lit("base64"))).otherwise(F.encode("text", "UTF-8"))
    form = {
        "ocr_strategy": trimmed(F.col("ocr_strategy")), "chunk_size": whole_number(F.col("chunk_size")).cast("string"), "chunk_overlap": whole_number(F.col("chunk_overlap")).cast("string"), "collection_id": trimmed(F.col("collection_id")),
    }
    fields = F.map_filter(F.create_map(*(x for k, v in form.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    return args.withColumns({"problem": problem, "bytes": F.when(problem.isNull(), content), "content_type": F.coalesce(trimmed(F.col("content_type")), F.lit("text/plain")), "fields": fields})
