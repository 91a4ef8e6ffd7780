"""Session activity from transcripts and hook payloads. Unknown counts stay null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import number, trimmed
from ledgerloom.sources.records import whole_json


def transcript_usage(lines: DataFrame, session: str = "session") -> DataFrame:
    """Token sums of a transcript's messages that carry usage, one row a session. A repeated message counts again.

    ``lines`` has the session, ``ord``, the model and the four token counts under ``usage``, as texts: numbers, or texts of numbers.
    """
    names = ("input_tokens", "cache_creation_input_tokens", "output_tokens", "cache_read_input_tokens")
    used = lines.filter("usage is not null").select(session, "ord", "model", *(F.coalesce(number(F.col(f"usage.{n}")), F.lit(0.0)).cast("bigint").alias(n) for n in names))
    zero, model = F.col, trimmed(F.col("model"))
    return used.groupBy(session).agg(
        F.max_by(model, F.when(model.isNotNull(), F.col("ord"))).alias("model"),
        F.sum(zero("input_tokens") + zero("cache_creation_input_tokens")).alias("input_tokens"),
        F.sum(zero("output_tokens")).alias("output_tokens"),
        F.sum(zero("input_tokens") + zero("cache_creation_input_tokens") + zero("output_tokens")).alias("total_tokens"),
        F.nullif(F.sum(zero("cache_read_input_tokens")), F.lit(0)).alias("cached_tokens"),
        F.count("*").alias("requests"),
        F.count("*").alias("turns"),
    )


def tool_counts(uses: DataFrame, session: str = "session") -> DataFrame:
    """(session, tools): names with counts, the most frequent first, ties by first use. ``uses`` has name and ord."""
    one = uses.withColumn("name", trimmed(F.col("name"))).filter("name is not null").groupBy(session, "name").agg(F.count("*").alias("count"), F.min("ord").alias("at"))
    return one.groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("less"), "at", "name", "count"))), lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"))).alias("tools"))


def payload_tools(payloads: DataFrame, key: str, names: str = "names") -> DataFrame:
    """(key, tools): counts of a payload's array of names, in order of first appearance."""
    one = payloads.select(key, F.posexplode(names).alias("pos", "name")).withColumn("name", trimmed(F.col("name"))).filter("name is not null")
    each = one.groupBy(key, "name").agg(F.count("*").alias("count"), F.min("pos").alias("at"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "count"))), lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"))).alias("tools"))


def payload_tool_names(payload: Column) -> Column:
    """The names in a payload's (a variant's) ``tools_used``, whose entries are texts or objects with a name; null for any other entry."""
    text = lambda x, at: F.when(F.schema_of_variant(F.try_variant_get(x, at, "variant")) == "STRING", F.try_variant_get(x, at, "string"))
    return F.transform(F.try_variant_get(payload, "$.tools_used", "array<variant>"), lambda x: F.coalesce(trimmed(text(x, "$")), text(x, "$.name")))


# Where usage may be, and the names of its fields, the first first.
USAGE_OBJECTS = ("$.usage", "$.token_usage", "$.tokenUsage", "$.message.usage")
USAGE_FIELDS = {
    "input_tokens": ("input_tokens", "inputTokens", "prompt_tokens"),
    "output_tokens": ("output_tokens", "outputTokens", "completion_tokens"),
    "cached_tokens": ("cache_read_input_tokens", "cached_input_tokens", "cacheReadInputTokens"),
    "cost_usd": ("payload:cost_usd", "cost_usd", "payload:total_cost_usd"),
    "requests": ("payload:num_requests", "requests"),
}


def payload_usage(payloads: DataFrame, key: str, text: str = "payload") -> DataFrame:
    """(key, model and counts) of hook payloads: the first object that may hold usage wins, even when empty; of a field's names the first that is a number.

    The total is always the sum of input and output. Each payload is parsed once.
    """
    parsed = payloads.select(key, whole_json(F.col(text)).alias("v"))
    first = F.coalesce(*(F.try_variant_get("v", at, "map<string,variant>") for at in USAGE_OBJECTS), F.create_map().cast("map<string,variant>"))
    held = parsed.select(key, "v", first.alias("u"))
    raw = lambda name: F.try_variant_get("v", f"$.{name[8:]}", "string") if name.startswith("payload:") else F.try_variant_get(F.try_element_at("u", F.lit(name)), "$", "string")
    every = sorted({n for names in USAGE_FIELDS.values() for n in names})
    models = [trimmed(F.try_variant_get("v", "$.model", "string")), trimmed(raw("model")), trimmed(F.try_variant_get("v", "$.message.model", "string"))]
    texts = held.select(key, F.coalesce(*models).alias("model"), *(raw(n).alias(n) for n in every))
    numbers = texts.select(key, "model", *(number(F.col(f"`{n}`")).alias(n) for n in every))
    found = numbers.select(key, "model", *(F.coalesce(*(F.col(f"`{n}`") for n in names)).alias(field) for field, names in USAGE_FIELDS.items()))
    counts = [F.col(c).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens", "cached_tokens", "requests")]
    total = F.when(F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull(), F.coalesce("input_tokens", F.lit(0.0)) + F.coalesce("output_tokens", F.lit(0.0))).cast("bigint")
    return found.select(key, "model", *counts, total.alias("total_tokens"), "cost_usd")


def activity_source(payload: Column, transcript: Column) -> Column:
    """Where usage comes from: a payload that says anything, even its model alone, keeps the transcript unread."""
    return F.when(payload, "hook_payload").when(transcript, "transcript").otherwise("none")
