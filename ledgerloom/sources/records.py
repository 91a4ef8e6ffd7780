"""Scans of transcripts, payloads and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPT_LINE = "struct<message:struct<model:string,content:array<struct<type:string,name:string>>,usage:struct<input_tokens:string,cache_creation_input_tokens:string,output_tokens:string,cache_read_input_tokens:string>>>"


def whole_json(text: Column) -> Column:
    """JSON text as a variant; null if it is none, or if anything stands behind its first value, which Spark's parser doesn't read."""
    held = F.try_parse_json(F.concat(F.lit('{"v":['), text, F.lit('],"whole":true}')))
    alone = F.try_variant_get(held, "$.whole", "boolean") & F.try_variant_get(held, "$.v[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(held, "$.v[0]", "variant"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, message) of JSONL transcripts; blank and broken lines are skipped."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord"), "value")
    return transcript_lines(raw).select("path", "ord", "message")


def transcript_lines(rows: DataFrame, line: str = "value") -> DataFrame:
    """Rows with the ``message`` of their JSON line; rows whose line is blank or no object go."""
    good = rows.filter((F.trim(line) != "") & whole_json(F.col(line)).isNotNull() & F.startswith(F.trim(line), F.lit("{")))
    return good.withColumn("message", F.from_json(line, TRANSCRIPT_LINE)["message"])


def parse_payload(text: Column) -> Column:
    """JSON text as a variant: blank is an empty object, text that is no JSON goes under ``raw``."""
    return F.when(F.trim(text) == "", F.parse_json(F.lit("{}"))).otherwise(F.coalesce(whole_json(text), F.parse_json(F.to_json(F.struct(text.alias("raw"))))))


def config_of(text: Column) -> Column:
    """A configuration's text as a variant; text that is missing or no JSON is an empty object."""
    return F.coalesce(whole_json(text), F.parse_json(F.lit("{}")))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The objects of JSON files, one a file or a list a file. With a schema the files aren't read twice."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def payload_keys(text: Column) -> Column:
    """The sorted keys of a JSON object's text."""
    return F.array_sort(F.json_object_keys(text))


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of queued items, by name; state files and the configuration are no items."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), F.decode("content", "UTF-8").alias("content")).filter(~F.endswith("name", F.lit(".state.json")) & (F.col("name") != "config.json")).orderBy("name")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """(name, attempts, next_attempt_at, last_error, last_status) of the items that have a state file; what is broken, missing or of another type is null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.state.json").load(path)
    state = whole_json(F.decode("content", "UTF-8"))
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get("s", f"$.{k}", "variant")), F.lit("VOID"))
    number = lambda k: F.when(kind(k).rlike("BIGINT|DECIMAL|DOUBLE"), F.try_variant_get("s", f"$.{k}", "double").cast("int"))
    text = lambda k: F.when(kind(k) == "STRING", F.try_variant_get("s", f"$.{k}", "string"))
    item = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.state\.json$", "")
    return files.select(item.alias("name"), state.alias("s")).select("name", number("attempts").alias("attempts"), text("next_attempt_at").alias("next_attempt_at"), text("last_error").alias("last_error"), number("last_status").alias("last_status"))


def with_state(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items with attempts and next attempt; without a state these are 0 and the epoch."""
    return items.join(state, "name", "left").withColumns({"attempts": F.coalesce("attempts", F.lit(0)), "next_attempt_at": F.coalesce("next_attempt_at", F.lit("1970-01-01T00:00:00.000Z"))})
