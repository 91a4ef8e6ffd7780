"""Queries on containers, one for each nation, with customers as nodes and suppliers as patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import ledger
from ledgerloom.plans.files import write_files
from ledgerloom.plans.registry import query, table
from ledgerloom.session import shared_dir
from ledgerloom.sources import byte_ranges, container

MAGIC, VERSION = "LOOM", "0.1"


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content). By nation: every 5th has an unknown section, of 3 modulo 7 one wrong count, of 4 a broken line, of 5 a forbidden key, of 6 other content than hashed, of 2 no time in the header, of 1 a null there."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    line = lambda prefix, key: F.concat(F.lit('{"id":"' + prefix), F.col(key).cast("string"), F.lit('"}'))
    ordered = lambda key, text: F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("a"), text.alias("t")))), lambda x: x["t"])
    mem = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(ordered("c_custkey", line("mem_", "c_custkey")).alias("nodes"))
    pat = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(ordered("s_suppkey", line("patch_", "s_suppkey")).alias("patches"))
    one = n.join(mem, "k", "left").join(pat, "k", "left")
    none = F.array().cast("array<string>")
    more = F.when(F.col("k") % 5 == 0, F.array(F.lit("@notes "), F.lit(""), F.lit('{"id":"n"}'))).otherwise(none)
    more = F.concat(more, F.when(F.col("k") % 7 == 4, F.array(F.lit("{oops"))).when(F.col("k") % 7 == 5, F.array(F.lit('{"deep":{"API_KEY":1}}'))).otherwise(none))
    text = container.write_text(F.coalesce("nodes", none), F.coalesce("patches", none), MAGIC, VERSION, "2024-01-01T00:00:00Z", more)
    text = F.when(F.col("k") % 7 == 3, F.regexp_replace(text, r'"counts":\{"nodes":', '"counts":{"nodes":1')).when(F.col("k") % 7 == 6, F.replace(text, F.lit("mem_"), F.lit("mem_0"))).otherwise(text)
    text = F.when(F.col("k") % 7 == 2, F.regexp_replace(text, ',"generated_at":"[^"]*"', "")).when(F.col("k") % 7 == 1, F.replace(text, F.lit('"format_id":"ledger/1"'), F.lit('"format_id":null'))).otherwise(text)
    return one.select(F.concat(F.lit("nation-"), F.col("k").cast("string")).alias("path"), text.alias("content"))


BASE = """k AS (SELECT n_nationkey AS k, 'nation-' || n_nationkey AS path FROM nation),
c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1),
extra AS (SELECT k, CASE WHEN k % 7 IN (4, 5) THEN 1 ELSE 0 END AS x, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS notes FROM k),
counts AS (SELECT path, 'nodes' AS section, c.n AS n_records FROM k JOIN c USING (k) UNION ALL
  SELECT path, 'patches', coalesce(s.n, 0) + CASE WHEN notes = 0 THEN x ELSE 0 END FROM k JOIN extra USING (k) LEFT JOIN s USING (k) WHERE coalesce(s.n, 0) + CASE WHEN notes = 0 THEN x ELSE 0 END > 0 UNION ALL
  SELECT path, 'notes', 1 + x FROM k JOIN extra USING (k) WHERE notes = 1)"""


@query(f"WITH {BASE} SELECT * FROM counts")
def container_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.section_counts(containers(spark, sf_dir))


@query("""WITH l AS (SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 2 AS pos, CASE WHEN c_nationkey % 7 = 6 THEN 'mem_0' ELSE 'mem_' END || c_custkey AS id FROM customer) SELECT 'nation-' || k AS path, pos, id FROM l""")
def container_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one section with their line numbers."""
    rows = container.records(containers(spark, sf_dir)).filter("section = 'nodes'")
    return rows.select("path", F.col("pos").cast("bigint").alias("pos"), F.get_json_object("record", "$.id").alias("id"))


@query(f"WITH {BASE}, m AS (SELECT path, 'nodes' AS section FROM k UNION ALL SELECT path, 'patches' FROM k UNION ALL SELECT path, 'notes' FROM k WHERE k % 5 = 0) SELECT path, section, coalesce(n_records, 0) + 1 + CASE WHEN section = 'notes' THEN 1 ELSE 0 END AS n_lines FROM m LEFT JOIN counts USING (path, section)")
def container_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the section they are carried forward to, markers and blanks included."""
    return container.lines(containers(spark, sf_dir)).groupBy("path", "section").agg(F.count("*").alias("n_lines"))


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation), c AS (SELECT c_nationkey AS k, string_agg(chr(10) || '{"id":"' || CASE WHEN c_nationkey % 7 = 6 THEN 'mem_0' ELSE 'mem_' END || c_custkey || '"}', '' ORDER BY c_custkey) AS t FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS k, string_agg(chr(10) || '{"id":"patch_' || s_suppkey || '"}', '' ORDER BY s_suppkey) AS t FROM supplier GROUP BY 1)
SELECT 'nation-' || k AS path, sha256('@nodes' || coalesce(c.t, '') || chr(10) || '@patches' || coalesce(s.t, '') || CASE WHEN k % 5 = 0 THEN chr(10) || '@notes ' || chr(10) || chr(10) || '{"id":"n"}' ELSE '' END ||
CASE k % 7 WHEN 4 THEN chr(10) || '{oops' WHEN 5 THEN chr(10) || '{"deep":{"API_KEY":1}}' ELSE '' END) AS digest FROM n LEFT JOIN c USING (k) LEFT JOIN s USING (k)""")
def container_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(spark, sf_dir).select("path", container.checksum(F.col("content")).alias("digest"))


@query("SELECT 'nation-' || n_nationkey AS path, 'notes' AS section FROM nation WHERE n_nationkey % 5 = 0")
def unknown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.unknown_sections(containers(spark, sf_dir))


@query(f"""WITH {BASE}, a AS (SELECT k, path, coalesce(c.n, 0) AS nodes, coalesce(s.n, 0) AS patches, CASE WHEN notes = 0 THEN x ELSE 0 END AS x FROM k JOIN extra USING (k) LEFT JOIN c USING (k) LEFT JOIN s USING (k))
SELECT path, 'nodes' AS section, 'counts' AS source, CAST('1' || nodes AS BIGINT) AS expected, nodes AS actual FROM a WHERE k % 7 = 3
UNION ALL SELECT path, 'patches', src, patches, patches + x FROM a, (VALUES ('counts'), ('sections')) v(src) WHERE x > 0""")
def count_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header against body, for both of the header's counts."""
    return container.count_mismatches(containers(spark, sf_dir))


@query("SELECT 'nation-' || n_nationkey AS path, CASE n_nationkey % 7 WHEN 2 THEN 'missing header key generated_at' WHEN 3 THEN 'count mismatch' WHEN 4 THEN 'invalid record JSON' WHEN 5 THEN CASE WHEN n_nationkey % 5 = 0 THEN 'forbidden key' ELSE 'count mismatch' END WHEN 6 THEN 'checksum mismatch' END AS problem FROM nation")
def container_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first problem of each container."""
    return container.verify(containers(spark, sf_dir), MAGIC, VERSION)


def container_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the containers, each written to a file of its own and read in ranges of 1,500 bytes."""
    folder = shared_dir(spark)
    write_files(containers(spark, sf_dir), folder, "path")
    return byte_ranges.read_lines(spark, folder, 1500).withColumn("path", F.element_at(F.split("path", "/"), -1))


@query("""WITH l AS (SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 2 AS pos, CASE WHEN c_nationkey % 7 = 6 THEN 'mem_0' ELSE 'mem_' END || c_custkey AS id, 'nodes' AS section FROM customer
UNION ALL SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + 3 + (SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey), 'patch_' || s_suppkey, 'patches' FROM supplier)
SELECT 'nation-' || k AS path, pos, section, id FROM l""")
def container_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of files that several tasks read, with line numbers and the sections that ranges inherit."""
    rows = byte_ranges.records(container_files(spark, sf_dir)).filter("section in ('nodes', 'patches')")
    return rows.select("path", "pos", "section", F.get_json_object("record", "$.id").alias("id")).filter("id is not null")


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation), c AS (SELECT c_nationkey AS k, string_agg(chr(10) || '{"id":"' || CASE WHEN c_nationkey % 7 = 6 THEN 'mem_0' ELSE 'mem_' END || c_custkey || '"}', '' ORDER BY c_custkey) AS t, count(*) AS n FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS k, string_agg(chr(10) || '{"id":"patch_' || s_suppkey || '"}', '' ORDER BY s_suppkey) AS t, count(*) AS n FROM supplier GROUP BY 1)
SELECT 'nation-' || k AS path, 'LOOM' || chr(9) || '0.1' AS magic, CAST(4 + coalesce(c.n, 0) + coalesce(s.n, 0) + CASE WHEN k % 5 = 0 THEN 3 ELSE 0 END + CASE WHEN k % 7 IN (4, 5) THEN 1 ELSE 0 END AS BIGINT) AS n_lines,
sha256('@nodes' || coalesce(c.t, '') || chr(10) || '@patches' || coalesce(s.t, '') || CASE WHEN k % 5 = 0 THEN chr(10) || '@notes ' || chr(10) || chr(10) || '{"id":"n"}' ELSE '' END ||
CASE k % 7 WHEN 4 THEN chr(10) || '{oops' WHEN 5 THEN chr(10) || '{"deep":{"API_KEY":1}}' ELSE '' END) AS digest FROM n LEFT JOIN c USING (k) LEFT JOIN s USING (k)""")
def container_range_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magic line, number of lines and digest of files that several tasks read."""
    return byte_ranges.overview(container_files(spark, sf_dir)).select("path", "magic", "n_lines", "digest")


@query("""SELECT 'nation-' || n_nationkey AS path, 'format_id' AS warning, 'null' AS detail FROM nation WHERE n_nationkey % 7 = 1
UNION ALL SELECT 'nation-' || n_nationkey, 'section', 'notes:' || (1 + CASE WHEN n_nationkey % 7 IN (4, 5) THEN 1 ELSE 0 END) FROM nation WHERE n_nationkey % 5 = 0""")
def container_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other formats and unknown sections, which leave a container valid."""
    return container.warnings(containers(spark, sf_dir), "ledger/1")


@query("""SELECT 'nation-' || n_nationkey AS ledger, CASE WHEN n_nationkey % 4 = 0 THEN 'own summary' ELSE 'of ' || n_name END AS summary, 'LOOM' || chr(9) || '0.1' AS magic,
CASE WHEN n_nationkey % 7 = 6 THEN 'other' ELSE 'same' END AS checksum FROM nation""")
def envelope_with_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes with their container's own text and recorded checksum; overrides come last."""
    files = containers(spark, sf_dir).select(F.col("path").alias("ledger"), "content")
    envelopes = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("ledger"), F.concat(F.lit("of "), "n_name").alias("summary"), F.col("n_nationkey").alias("k"))
    recorded = F.get_json_object(F.element_at(F.split("content", "\n"), 2), "$.content_sha256")
    found = ledger.with_container(envelopes, files, recorded, {"summary": F.when(F.col("k") % 4 == 0, "own summary").otherwise(F.col("summary"))})
    same = F.col("container_checksum") == container.checksum(F.col("container_text"))
    return found.select("ledger", "summary", F.substring_index("container_text", "\n", 1).alias("magic"), F.when(same, "same").otherwise("other").alias("checksum"))
