"""Queries on search: documents are hits, their sources buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import search
from ledgerloom.plans.registry import query, table


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(k.cast("string").alias("id"), ((k * 7919) % 1000).alias("score"), F.substring("source", 4, 3).cast("int").alias("bucket_ord"), k.alias("hit_ord"), "source", "lang", "doc_id", "n_chars")


HITS = "h AS (SELECT CAST(doc_id AS VARCHAR) AS id, (doc_id * 7919) % 1000 AS score, CAST(substr(source, 4) AS INTEGER) AS bucket_ord, doc_id AS hit_ord, source, lang, doc_id, n_chars FROM documents)"


@query(f"WITH {HITS} SELECT id, score, bucket_ord FROM h WHERE source <> 'src3'")
def search_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All buckets' hits but a failed one's, merged by score."""
    merged = search.fan_out(hits(spark, sf_dir), F.col("source") == "src3")
    return merged.select("id", "score", "bucket_ord")


@query(f"WITH {HITS} SELECT id, score FROM h WHERE lang = 'en' ORDER BY score DESC, id LIMIT 10")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best hits of a filtered bucket."""
    return search.top_hits(hits(spark, sf_dir).filter(search.condition({"lang": "en"}))).select("id", "score")


@query(f"WITH {HITS} SELECT id, lang FROM h ORDER BY score DESC, id LIMIT 20")
def search_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_hits(hits(spark, sf_dir), search.MEMORY_TOP).select("id", "lang")


@query(f"WITH {HITS} SELECT id, 'memory://bucket/' || source || '/chunks/' || id AS url, lang AS title FROM h")
def search_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, title and address of each hit."""
    one = hits(spark, sf_dir)
    none = F.lit(None).cast("string")
    return one.select("id", search.hit_url(none, none, F.col("source"), F.col("id")).alias("url"), search.hit_title({"title": none, "name": F.lit(" "), "source": F.col("lang")}, F.col("id")).alias("title"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 't ' || lang WHEN 1 THEN source WHEN 2 THEN 'f' ELSE CAST(doc_id AS VARCHAR) END AS title FROM documents")
def hit_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    names = {"title": F.when(k == 0, F.concat(F.lit("  t "), "lang", F.lit(chr(160)))).when(k == 1, " "), "source": F.when(k == 1, F.col("source")), "file_name": F.when(k == 2, "f")}
    return table(spark, sf_dir, "documents").select("doc_id", search.hit_title(names, F.col("doc_id").cast("string")).alias("title"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'http://a/' || doc_id WHEN 1 THEN 'http://s' ELSE 'memory://bucket/a%20b%2F' || lang || '/chunks/' || doc_id || '%2B!''()~*' END AS url FROM documents")
def hit_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hit's address, or one made of encoded parts; a blank one hides the source's."""
    k, text = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    url = F.when(k == 0, F.concat(F.lit(" http://a/"), text)).when(k == 2, " ")
    return table(spark, sf_dir, "documents").select("doc_id", search.hit_url(url, F.when(k.isin(1, 2), "http://s"), F.concat(F.lit("a b/"), "lang"), F.concat(text, F.lit("+!'()~*"))).alias("url"))


@query("""WITH r AS (SELECT doc_id AS response_id, lang AS context, unnest([1, 2, 3]) AS i FROM documents)
SELECT response_id, CASE WHEN i = 1 THEN 'c' || response_id WHEN i = 2 AND response_id % 2 = 0 THEN 'd' ELSE 'citation-' || i END AS id, context AS text, CASE WHEN i = 3 THEN 9 ELSE i END AS citation_index, CASE WHEN i = 1 THEN 'T' WHEN i = 2 THEN 'u' END AS citation FROM r""")
def citation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda x: F.lit(x).cast("string")
    k = F.col("doc_id")
    cite = lambda chunk, doc, title, url, index: F.struct(chunk.alias("chunk_id"), doc.alias("document_id"), text(None).alias("source_id"), text(title).alias("title"), text(url).alias("source_url"), F.lit(index).cast("bigint").alias("index"))
    rows = table(spark, sf_dir, "documents").select(k.alias("response_id"), F.col("lang").alias("context"), F.array(cite(F.concat(F.lit("c"), k.cast("string")), text(None), "T", "u", None), cite(text(None), F.when(k % 2 == 0, "d"), None, "u", None), cite(text(None), text(None), None, None, 9)).alias("citations"))
    return search.citation_hits(rows).select("response_id", "id", "text", "citation_index", "citation")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'n1' WHEN 1 THEN lang || '|' || source WHEN 2 THEN 'x' END AS refs FROM documents")
def ref_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested, flat and dotted forms of references."""
    k = F.col("doc_id") % 4
    nested = F.when(k == 0, F.array(F.lit("n1"), F.lit(" "))).when(k == 1, F.array(F.lit("")))
    flat = F.when(k <= 1, F.concat(F.lit(" "), "lang", F.lit(", ,"), "source")).when(k == 2, " , ")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(search.decode_refs(nested, flat, F.when(k == 2, "x")), "|").alias("refs"))


@query("SELECT doc_id, 'lang=' || CASE WHEN doc_id % 2 = 0 THEN 'zz' ELSE lang END || ';source=' || source || ':8' AS filter FROM documents")
def tag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags cut at the first colon; the last of a key stays, broken ones go."""
    tags = F.array(F.concat(F.lit("lang : "), "lang"), F.lit("broken"), F.lit(":x"), F.lit("y:"), F.concat(F.lit("source:"), "source", F.lit(":8")), F.when(F.col("doc_id") % 2 == 0, "lang:zz").otherwise("nothing"))
    pairs = F.array_sort(F.map_entries(search.parse_tags(tags)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("filter"))


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND source IN ('src1', 'src2')")
def filter_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit keys under tags under sources."""
    wanted = search.build_filter({"lang": "en", "source": "src9"}, ["lang:fr", "lang:de"], ["src1", "src2"])
    return table(spark, sf_dir, "documents").filter(search.condition(wanted)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src4'")
def filter_tags_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(search.condition(search.build_filter(tags=["lang:fr", "source:src4"]))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source IN ('src5', 'src6', 'src7')")
def filter_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(search.condition(search.build_filter(sources=["src5", "src6", "src7"]))).select("doc_id")


START, END = "1996-01-01", "1997-01-01"


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))


@query(f"SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '{START}'")
def temporal_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.temporal(_timed(spark, sf_dir), "before", "day", start=START).select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '{START}'")
def temporal_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.temporal(_timed(spark, sf_dir), "after", "day", start=START).select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'")
def temporal_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.temporal(_timed(spark, sf_dir), "between", "day", start=START, end=END).select("o_orderkey")


@query(f"SELECT o_custkey, max_by(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) AS o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '{START}' GROUP BY o_custkey")
def temporal_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.temporal(_timed(spark, sf_dir), "as_of", "day", "o_custkey", START, tie="o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, max_by(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def temporal_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.temporal(_timed(spark, sf_dir), "latest", "day", "o_custkey", tie="o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT doc_id, CASE WHEN source IN ('src0', 'src1', 'src2') THEN md5(source) ELSE source END AS resolved, regexp_matches(CASE WHEN doc_id % 2 = 0 THEN md5(source) ELSE source END, '^[a-fA-F0-9]{32}$') AS is_id FROM documents")
def bucket_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name or an id to an id, else itself."""
    docs = table(spark, sf_dir, "documents")
    known = spark.range(6).select(F.concat(F.lit("src"), (F.col("id") % 3).cast("string")).alias("name"), F.col("id").alias("ord")).select("name", F.when(F.col("ord") < 3, F.md5("name")).otherwise("later").alias("id"), "ord")
    out = search.resolve(docs.select("doc_id", "source"), known, "source", fallback=True)
    return out.select("doc_id", "resolved", search.is_bucket_id(F.when(F.col("doc_id") % 2 == 0, F.md5("source")).otherwise(F.col("source"))).alias("is_id"))


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN 'id-' || lang END AS resolved FROM documents")
def collection_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name to an id, else null."""
    known = spark.createDataFrame([("en", "id-en", 0), ("fr", "id-fr", 1)], "name string, id string, ord int")
    return search.resolve(table(spark, sf_dir, "documents").select("doc_id", "lang"), known, "lang", fallback=False).select("doc_id", "resolved")


@query("SELECT CAST(doc_id % 100 AS VARCHAR) AS id, max(doc_id) AS ord FROM documents GROUP BY ALL")
def fetch_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of equal ids."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).cast("string").alias("id"), F.col("doc_id").alias("ord"))
    return search.fetch_cache(rows)


@query("WITH c AS (SELECT doc_id % 100 AS id, max(doc_id) AS doc_id FROM documents GROUP BY 1) SELECT event_id, doc_id FROM events JOIN c ON user_id = id")
def fetch_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("id"), "doc_id")
    cache = search.latest(rows, "id", "doc_id")
    return table(spark, sf_dir, "events").join(cache, F.col("user_id") == F.col("id")).select("event_id", "doc_id")


@query("SELECT source AS id, count(*) AS file_count, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def list_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("file_count"), F.sum("n_chars").alias("chars"))


@query("SELECT source AS bucket_id, lang AS name, count(*) AS file_count FROM documents GROUP BY ALL")
def list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("bucket_id"), F.col("lang").alias("name")).agg(F.count("*").alias("file_count"))


@query("SELECT event_type AS id, count(*) AS docs_indexed, max(ts) AS last_synced_at FROM events GROUP BY event_type")
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("id")).agg(F.count("*").alias("docs_indexed"), F.max("ts").alias("last_synced_at"))


@query("SELECT lang, count(*) AS hits, string_agg(DISTINCT source, ',' ORDER BY source) AS buckets FROM documents GROUP BY lang")
def bucket_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("hits"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("buckets"))


@query("SELECT DISTINCT source FROM documents")
def bucket_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source").distinct()


@query("SELECT source FROM documents WHERE lang = 'de' INTERSECT SELECT source FROM documents WHERE lang = 'es'")
def shared_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.filter("lang = 'de'").select("source").intersect(docs.filter("lang = 'es'").select("source"))


@query("SELECT lang, bool_and(starts_with(source, 'src1')) AS all_prefixed, bool_and(starts_with(source, 'src')) AS all_known FROM documents GROUP BY lang")
def bucket_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda p: F.bool_and(F.startswith("source", F.lit(p)))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(has("src1").alias("all_prefixed"), has("src").alias("all_known"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND user_id % 3 < 2 THEN (user_id % 3 = 1 OR event_type = 'view') AND (user_id % 5 <> 0 OR event_id % 2 = 0) ELSE false END AS allowed FROM events""")
def scope_authz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes and bucket lists of tokens against what endpoints ask for."""
    e = table(spark, sf_dir, "events")
    asked = e.select("event_id", F.col("event_type").alias("endpoint"), F.when(F.col("user_id") % 3 < 2, F.concat((F.col("user_id") % 3).cast("string"), F.when(F.col("user_id") % 5 == 0, "-few").otherwise(""))).alias("token"), (F.col("event_id") % 2).cast("string").alias("bucket"))
    ends = spark.createDataFrame([("click", ["read", "write"]), ("view", ["read"])], "endpoint string, required array<string>")
    tokens = spark.createDataFrame([("0", ["read"], None), ("1", ["read", "write"], None), ("0-few", ["read"], ["0"]), ("1-few", ["write", "read"], ["0"])], "token string, granted array<string>, buckets array<string>")
    return search.allowed(asked, ends, tokens).select("event_id", "allowed")


@query("SELECT DISTINCT event_type AS name FROM events WHERE event_type NOT IN ('purchase', 'signup')")
def visible_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as tools, two of which are gated."""
    tools = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    return search.visible(tools, ("purchase", "signup", "workflow_run"), enabled=False)


def _branches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users ask a bucket for each kind of event, the kinds by name; some fail, of every fifth user all. Events are hits."""
    e = table(spark, sf_dir, "events")
    failed = (F.col("user_id") % 5 == 0) | ((F.col("user_id") + F.length("event_type")) % 3 == 0)
    asked = e.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("bucket"), F.when(failed, F.concat(F.lit("status 50"), F.length("event_type").cast("string"), F.lit(" from "), "event_type")).alias("reason")).distinct()
    hits = e.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("bucket"), F.col("event_id").alias("hit_ord"), F.col("event_id").alias("id"), F.floor("value").cast("int").alias("score"))
    return hits, asked.withColumn("bucket_ord", F.col("bucket"))


@query("""WITH a AS (SELECT DISTINCT user_id, event_type, user_id % 5 = 0 OR (user_id + length(event_type)) % 3 = 0 AS failed FROM events),
o AS (SELECT user_id, count(*) FILTER (NOT failed) AS bucket_count, string_agg(event_type, ',' ORDER BY event_type) AS sources, min_by('status 50' || length(event_type) || ' from ' || event_type, event_type) FILTER (failed) AS first FROM a GROUP BY user_id),
h AS (SELECT e.user_id, event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY CAST(floor(value) AS INTEGER) DESC, e.event_type, event_id) AS place FROM events e JOIN a ON a.user_id = e.user_id AND a.event_type = e.event_type AND NOT failed)
SELECT o.user_id AS query_id, bucket_count, sources AS sources_searched, CASE WHEN bucket_count = 0 THEN first END AS error, event_id AS id, place FROM o LEFT JOIN h ON h.user_id = o.user_id""")
def search_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches over several buckets: hits, buckets that answered, buckets asked, and the error of a search that failed as a whole."""
    return search.search(*_branches(spark, sf_dir)).select("query_id", "bucket_count", F.array_join("sources_searched", ",").alias("sources_searched"), "error", "id", "place")
