"""Ledger containers: a magic line, a header, and sections of one JSON record a line.

A container is order-sensitive as a whole, so one file is one row (``read_containers``) and work is spread
over files. ``magic`` names the container's format; it is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import keys_at_any_depth
from ledgerloom.sources.records import whole_json
from ledgerloom.vocab import FORBIDDEN_KEYS, KNOWN_SECTIONS

HEADER_KEYS = ("format_id", "versions", "sections", "counts", "generated_at", "content_sha256")


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file. Spark's file sources pass over files without a byte."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("content"))


def _lines(content: Column) -> Column:
    """Split at newlines; one empty line at the end goes."""
    return F.split(F.regexp_replace(content, r"\n\z", ""), "\n", -1)


def lines(files: DataFrame) -> DataFrame:
    """(path, pos, line, section) of the body, position 2 on; a record keeps the last marker above it."""
    one = files.select("path", F.posexplode(_lines(F.col("content"))).alias("pos", "line")).filter("pos >= 2")
    marker = F.when(F.startswith("line", F.lit("@")), F.trim(F.expr("substring(line, 2)")))
    above = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return one.withColumn("section", F.last(marker, ignorenulls=True).over(above))


def records(files: DataFrame) -> DataFrame:
    """(path, pos, section, record): the body without markers and blank lines."""
    return lines(files).filter(~F.startswith("line", F.lit("@")) & (F.trim("line") != "")).select("path", "pos", "section", F.col("line").alias("record"))


def section_counts(files: DataFrame) -> DataFrame:
    return records(files).groupBy("path", "section").agg(F.count("*").alias("n_records"))


def checksum(content: Column) -> Column:
    """sha256 of the body's lines, blank ones and markers included."""
    body = _lines(content)
    return F.sha2(F.array_join(F.slice(body, 3, F.greatest(F.lit(0), F.size(body) - 2)), "\n"), 256)


def unknown_sections(files: DataFrame) -> DataFrame:
    return lines(files).filter("section is not null").select("path", "section").distinct().filter(~F.col("section").isin(*KNOWN_SECTIONS))


def count_mismatches(files: DataFrame) -> DataFrame:
    """(path, section, source, expected, actual) where the header and the body disagree on a known section.

    ``expected`` is null where the header has no entry for a section that the body marks, be it empty.
    """
    header = whole_json(F.try_element_at(_lines(F.col("content")), F.lit(2)))
    known = F.explode(F.array(*map(F.lit, KNOWN_SECTIONS))).alias("section")
    base = files.select("path", header.alias("h"), known)
    listed = F.from_json(F.to_json(F.try_variant_get("h", "$.sections", "variant")), "array<struct<name:string,count:bigint>>")
    counted = F.from_json(F.to_json(F.try_variant_get("h", "$.counts", "variant")), "map<string,bigint>")
    said = base.select("path", "section", F.explode(F.array(
        F.struct(F.lit("sections").alias("source"), F.try_element_at(F.transform(F.filter(listed, lambda s: s["name"] == F.col("section")), lambda s: s["count"]), F.lit(-1)).alias("expected")),
        F.struct(F.lit("counts").alias("source"), F.try_element_at(counted, F.col("section")).alias("expected")),
    )).alias("s")).select("path", "section", "s.*")
    marked = lines(files).groupBy("path", "section").agg(F.count_if(~F.startswith("line", F.lit("@")) & (F.trim("line") != "")).alias("n_records"))
    both = said.join(marked, ["path", "section"], "left").withColumn("actual", F.coalesce("n_records", F.lit(0)))
    wrong = F.when(F.col("expected").isNull(), F.col("n_records").isNotNull()).otherwise(F.col("expected") != F.col("actual"))
    return both.filter(wrong).select("path", "section", "source", "expected", "actual")


def warnings(files: DataFrame, format_id: str) -> DataFrame:
    """(path, warning, detail): what doesn't make a container invalid: another format than ``format_id``, and sections that nobody knows, with their number of records."""
    header = whole_json(F.try_element_at(_lines(F.col("content")), F.lit(2)))
    declared = files.select("path", F.try_variant_get(header, "$.format_id", "string").alias("detail"))
    formats = declared.filter(~F.col("detail").eqNullSafe(F.lit(format_id))).select("path", F.lit("format_id").alias("warning"), F.coalesce("detail", F.lit("null")).alias("detail"))
    held = lines(files).filter("section is not null").groupBy("path", "section").agg(F.count_if(~F.startswith("line", F.lit("@")) & (F.trim("line") != "")).alias("n"))
    strange = held.filter(~F.col("section").isin(*KNOWN_SECTIONS)).select("path", F.lit("section").alias("warning"), F.concat_ws(":", "section", F.col("n").cast("string")).alias("detail"))
    return formats.unionByName(strange)


def verify(files: DataFrame, magic: str, version: str = "0.1", container: str = "ledger") -> DataFrame:
    """(path, problem): the first problem of each file by the order of reading, null if there is none."""
    text = F.col("content")
    body = _lines(text)
    first, second = F.element_at(body, 1), F.try_element_at(body, F.lit(2))
    tab = F.instr(first, "\t")
    header = whole_json(second)
    field = lambda k: F.try_variant_get("header", f"$.{k}", "string")
    head = files.select("path", "content", first.alias("first"), tab.alias("tab"), second.alias("second"), header.alias("header"))
    said = F.substring("first", 1, 1 << 10)
    head = head.select(
        "path", "content",
        F.coalesce(
            F.when(F.col("content") == "", "empty"),
            F.when(F.col("tab") == 0, "malformed magic line"),
            F.when(F.substring_index(said, "\t", 1) != magic, "bad magic"),
            F.when(F.expr("substring(first, tab + 1)") != version, "unsupported version"),
            F.when(F.col("second").isNull(), "missing header"),
            F.when(F.col("header").isNull(), "invalid header JSON"),
            F.when(~F.startswith(F.trim("second"), F.lit("{")), "header must be an object"),
            F.when(~F.coalesce(field("container"), F.lit("")).eqNullSafe(F.lit(container)), "unsupported container"),
            *(F.when(~F.array_contains(F.json_object_keys("second"), k), f"missing header key {k}") for k in HEADER_KEYS),  # a null is there
        ).alias("head_problem"),
        F.when(field("content_sha256") != checksum(text), "checksum mismatch").alias("sum_problem"),
        keys_at_any_depth(F.col("second"), FORBIDDEN_KEYS).alias("head_keys"),
    )
    rows = records(files)
    parsed = whole_json(F.col("record"))
    trouble = F.when(F.col("section").isNull(), "record before any section").when(parsed.isNull(), "invalid record JSON").when(~F.startswith(F.trim("record"), F.lit("{")), "record must be an object")
    rows = rows.select("path", "pos", trouble.alias("trouble"), keys_at_any_depth(F.col("record"), FORBIDDEN_KEYS).alias("keys"))
    found = rows.groupBy("path").agg(F.min_by("trouble", F.when(F.col("trouble").isNotNull(), F.col("pos"))).alias("body_problem"), F.max(F.size("keys") > 0).alias("body_keys"))
    wrong = count_mismatches(files).select("path").distinct().withColumn("count_problem", F.lit("count mismatch"))
    every = head.join(found, "path", "left").join(wrong, "path", "left")
    keys = F.when((F.size("head_keys") > 0) | F.coalesce("body_keys", F.lit(False)), "forbidden key")
    return every.select("path", F.coalesce("head_problem", "body_problem", "sum_problem", "count_problem", keys).alias("problem"))


def write_text(nodes: Column, patches: Column, magic: str, version: str, generated_at: str, more: Column | None = None) -> Column:
    """The text of a container from arrays of JSON records; ``more`` holds further body lines."""
    body = F.concat(F.array(F.lit("@nodes")), nodes, F.array(F.lit("@patches")), patches, more if more is not None else F.array().cast("array<string>"))
    joined = F.array_join(body, "\n")
    counts = lambda a: F.size(a).cast("string")
    header = F.concat(
        F.lit('{"container":"ledger","format_id":"ledger/1","versions":{"container":"' + version + '"},"sections":[{"name":"nodes","count":'), counts(nodes), F.lit('},{"name":"patches","count":'), counts(patches),
        F.lit('}],"counts":{"nodes":'), counts(nodes), F.lit(',"patches":'), counts(patches), F.lit(f'}},"generated_at":"{generated_at}","content_sha256":"'), F.sha2(joined, 256), F.lit('"}'),
    )
    return F.concat(F.lit(f"{magic}\t{version}\n"), header, F.lit("\n"), joined, F.lit("\n"))
