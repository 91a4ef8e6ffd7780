"""Queries on a ledger whose nodes are orders and whose patches are returned line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import ledger, validate
from ledgerloom.plans.registry import query, table

SESSION = "2"
VERSION = "node/1"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    active = F.when(F.col("o_orderstatus") == "P", "active_session").otherwise("active")
    lead = F.substring("o_orderpriority", 1, 1)
    session = F.when((F.col("o_orderstatus") == "P") | (F.col("o_orderkey") % 4 == 1), F.pmod("o_orderkey", F.lit(5)).cast("string"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.pmod("o_orderkey", F.lit(7)) != 0, F.col("o_custkey").cast("string")).alias("key"),
        active.alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"),
        F.struct(session.alias("session"), F.when(lead.isin("1", "2"), "p").alias("project"), F.when(lead == "3", "w").alias("workspace")).alias("scope"),
        F.col("o_orderkey").alias("ord"),
        F.concat_ws(" ", F.lit(" order"), F.col("o_orderkey").cast("string"), F.col("o_orderpriority")).alias("content"),
        F.col("o_orderpriority").alias("label"),
        F.pmod("o_custkey", F.lit(50)).cast("string").alias("ledger"),
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(x for k, v in {1: "update", 2: "supersede", 3: "rollback", 4: "create", 5: "forget", 6: "rollback", 7: "expire"}.items() for x in (F.lit(k), F.lit(v))))
    line = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return line.select(
        F.concat_ws("-", F.lit("patch"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.element_at(names, F.col("l_linenumber")).alias("operation"),
        F.array(F.col("l_orderkey").cast("string")).alias("target_ids"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


NODES = """
n AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS key,
  CASE WHEN o_orderstatus = 'P' THEN 'active_session' ELSE 'active' END AS status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS updated_at,
  CASE WHEN o_orderstatus = 'P' OR o_orderkey % 4 = 1 THEN CAST(o_orderkey % 5 AS VARCHAR) END AS session,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 2 THEN 4 WHEN o_orderpriority[1] IN ('1', '2') THEN 3 WHEN o_orderpriority[1] = '3' THEN 2 ELSE 1 END AS rank,
  o_orderkey AS ord, ' order ' || o_orderkey || ' ' || o_orderpriority AS content, o_orderpriority AS label, CAST(o_custkey % 50 AS VARCHAR) AS ledger FROM orders),
live AS (SELECT * FROM n WHERE (status = 'active' OR (status = 'active_session' AND session = '2'))
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l_returnflag = 'R' AND l_linenumber IN (1, 2, 5, 7) AND l.l_orderkey = n.ord)),
placed AS (SELECT *, CASE WHEN key IS NULL THEN ord ELSE min(ord) OVER (PARTITION BY key) END AS slot FROM live),
view_ AS (SELECT * FROM placed WHERE key IS NULL UNION ALL
  SELECT * FROM placed WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank DESC, updated_at DESC, ord) = 1)
"""


@query(f"WITH {NODES} SELECT id, key, status, rank, updated_at FROM view_")
def effective_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-join of retired nodes, then the argmax of scope for each key."""
    view = ledger.effective_view(nodes(spark, sf_dir), patches(spark, sf_dir), SESSION)
    return view.select("id", "key", "status", ledger.rank(SESSION).alias("rank"), "updated_at")


@query(f"WITH {NODES}, f AS (SELECT key, min(ord) AS at FROM live WHERE key IS NOT NULL GROUP BY key) SELECT id, view_.key IS NOT NULL AS keyed, coalesce(f.at, ord) AS place FROM view_ LEFT JOIN f USING (key)")
def effective_view_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with the place of each node in the output order."""
    return ledger.effective_order(nodes(spark, sf_dir), patches(spark, sf_dir), SESSION).select("id", F.col("place.keyed").alias("keyed"), F.col("place.at").alias("place"))


@query(f"WITH {NODES}, r AS (SELECT * FROM n WHERE key IS NULL UNION ALL SELECT * FROM n WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank DESC, updated_at DESC, ord) = 1) SELECT id, key, rank FROM r")
def scope_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The argmax alone, over all nodes."""
    one = ledger.scope_precedence(nodes(spark, sf_dir), SESSION)
    return one.select("id", "key", ledger.rank(SESSION).alias("rank"))


@query(f"WITH {NODES} SELECT rank, count(*) AS n FROM n GROUP BY rank")
def scope_rank_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).select(ledger.rank(SESSION).alias("rank"))
    return n.groupBy("rank").agg(F.count("*").alias("n"))


@query(f"WITH {NODES}, l AS (SELECT ledger, label, min((key IS NOT NULL, slot)) AS seen FROM view_ GROUP BY ALL) SELECT ledger, string_agg(label, '|' ORDER BY seen) AS labels FROM l GROUP BY ledger")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels in order of first appearance."""
    view = ledger.effective_order(nodes(spark, sf_dir), patches(spark, sf_dir), SESSION)
    return ledger.source_labels(view).select("ledger", F.array_join("labels", "|").alias("labels"))


SUMMARY = f"""{NODES}, top AS (SELECT *, row_number() OVER (PARTITION BY ledger ORDER BY key IS NOT NULL, slot) AS k FROM view_),
s AS (SELECT ledger, string_agg(trim(content), ' / ' ORDER BY k) AS t FROM top WHERE k <= 5 GROUP BY ledger)"""


@query(f"WITH {SUMMARY} SELECT ledger, CASE WHEN length(t) > 100 THEN substr(t, 1, 99) || '…' ELSE t END AS summary FROM s")
def summary_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five nodes' contents, joined and cut."""
    return ledger.summary(ledger.effective_order(nodes(spark, sf_dir), patches(spark, sf_dir), SESSION), chars=100)


@query(f"""WITH {SUMMARY}, i AS (SELECT ledger, md5(string_agg(id, ',' ORDER BY key IS NOT NULL, slot)) AS node_ids, count(*) AS n_nodes FROM view_ GROUP BY ledger),
p AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS ledger, count(*) AS n_patches, md5(string_agg('patch-' || l_orderkey || '-' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber)) AS patch_ids
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT ledger, node_ids, n_nodes, patch_ids, n_patches, CASE WHEN length(t) > 480 THEN substr(t, 1, 479) || '…' ELSE t END AS summary FROM i LEFT JOIN p USING (ledger) LEFT JOIN s USING (ledger)""")
def container_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One envelope a ledger: effective ids in order, all patches, summary, counts."""
    view = ledger.effective_order(nodes(spark, sf_dir), patches(spark, sf_dir), SESSION)
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("o"), F.pmod("o_custkey", F.lit(50)).cast("string").alias("ledger"))
    own = patches(spark, sf_dir).join(owner, F.element_at("target_ids", 1) == F.col("o")).select("ledger", "id", "ord")
    out = ledger.container_envelope(view, own)
    return out.select("ledger", F.md5(F.array_join("node_ids", ",")).alias("node_ids"), "n_nodes", F.md5(F.array_join("patch_ids", ",")).alias("patch_ids"), "n_patches", "summary")


@query("SELECT l_orderkey, l_linenumber, l_partkey + 37 AS ref FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey + 37)")
def ref_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to nodes that don't exist."""
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + 37).alias("ref"))
    return validate.dangling(refs, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))).select("l_orderkey", "l_linenumber", "ref")


@query("SELECT l_orderkey, l_linenumber, l_suppkey + 5 AS ref FROM lineitem l WHERE l_linenumber % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey + 5)")
def ref_integrity_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to patches, where given, that don't exist."""
    ref = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_suppkey") + 5)
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ref.alias("ref"))
    return validate.dangling(refs, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))).select("l_orderkey", "l_linenumber", "ref")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    pick = lambda n, bad, good: F.when(k % n == 0, F.lit(bad)).otherwise(good)
    return c.select(
        pick(11, "x", F.lit("mem_")).alias("pre"), k.alias("k"),
        pick(5, "node/0", F.lit(VERSION)).alias("schema_version"), pick(13, "odd", F.lit("task")).alias("type"),
        pick(6, "pending", pick(17, "gone", F.lit("active"))).alias("status"), pick(7, " ", F.col("c_name")).alias("content"),
        pick(3, None, F.lit("l")).alias("label"), F.when(k % 9 == 0, F.array(F.lit("s"))).otherwise(F.array(F.lit(""))).alias("span_sources"),
    ).withColumn("id", F.concat("pre", F.col("k").cast("string")))


NODE_RULES = """c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE 'mem_' END || c_custkey AS id FROM customer),
bad AS (SELECT k, id, 'schema_version must be node/1' AS p FROM c WHERE k % 5 = 0
UNION ALL SELECT k, id, 'id must start with mem_' FROM c WHERE k % 11 = 0
UNION ALL SELECT k, id, 'unknown type odd' FROM c WHERE k % 13 = 0
UNION ALL SELECT k, id, 'unknown status gone' FROM c WHERE k % 17 = 0 AND k % 6 <> 0
UNION ALL SELECT k, id, 'content cannot be empty' FROM c WHERE k % 7 = 0
UNION ALL SELECT k, id, 'long-term node requires source label or source raw span' FROM c WHERE k % 3 = 0 AND k % 9 <> 0 AND k % 6 <> 0
UNION ALL SELECT k, id, 'missing retrieval' FROM c WHERE k % 19 = 0)"""


def _present(fields: tuple[str, ...], absent: str, when) -> object:
    return F.when(when, F.array(*(F.lit(f) for f in fields if f != absent))).otherwise(F.array(*map(F.lit, fields)))


@query(f"WITH {NODE_RULES} SELECT id, 'node ' || id || ': ' || p AS problem FROM bad")
def validate_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumn("present", _present(validate.vocab.NODE_FIELDS, "retrieval", F.col("k") % 19 == 0))
    return validate.validate_nodes(rows, VERSION).select("id", "problem")


@query(f"WITH {NODE_RULES}, t AS (SELECT k % 20 AS ledger, k, list_position(['mi', 'sc', 'id', 'uk', 'us', 'co', 'lo'], CASE WHEN p LIKE 'unknown s%' THEN 'us' WHEN p LIKE 'unknown t%' THEN 'uk' ELSE p[1:2] END) AS rule, 'node ' || id || ': ' || p AS problem FROM bad) SELECT ledger, string_agg(problem, '; ' ORDER BY k, rule) AS problems, count(*) AS n_problems FROM t GROUP BY ledger")
def validate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All problems of a ledger as one text."""
    rows = _records(spark, sf_dir).withColumn("present", _present(validate.vocab.NODE_FIELDS, "retrieval", F.col("k") % 19 == 0))
    found = validate.validate_nodes(rows.withColumn("ord", F.col("k")), VERSION).withColumn("ledger", F.col("ord") % 20)
    return validate.problem_text(found, "ledger", ("ord", "rule", "place"), size=7)


@query("""WITH p AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 'p' ELSE 'patch_' END || p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'forget' ELSE 'invent' END AS op FROM part),
bad AS (SELECT id, 'id must start with patch_' AS p FROM p WHERE p_partkey % 11 = 0
UNION ALL SELECT id, 'unknown operation invent' FROM p WHERE op = 'invent'
UNION ALL SELECT id, 'target_ids required for ' || op FROM p WHERE op <> 'create' AND p_size % 3 = 0
UNION ALL SELECT id, 'new_content required for ' || op FROM p WHERE op IN ('create', 'update') AND p_size % 2 = 0)
SELECT id, 'patch ' || id || ': ' || p AS problem FROM bad""")
def validate_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    ops = F.element_at(F.array(*map(F.lit, ("create", "update", "forget", "invent"))), (k % 4 + 1).cast("int"))
    rows = p.select(
        F.concat(F.when(k % 11 == 0, "p").otherwise("patch_"), k.cast("string")).alias("id"), F.lit("patch/1").alias("schema_version"), ops.alias("operation"),
        F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("mem_1"))).alias("target_ids"),
        F.when(F.col("p_size") % 2 != 0, F.col("p_name")).alias("new_content"), _present(validate.vocab.PATCH_FIELDS, "", F.lit(False)).alias("present"),
    )
    return validate.validate_patches(rows, "patch/1").select("id", "problem")


@query("""WITH e AS (SELECT *, CASE WHEN s_suppkey % 5 = 0 THEN 'e' ELSE 'edge_' END || s_suppkey AS id FROM supplier),
bad AS (SELECT id, 'id must start with edge_' AS p FROM e WHERE s_suppkey % 5 = 0 UNION ALL SELECT id, 'unknown type likes' FROM e WHERE s_nationkey % 2 = 0)
SELECT id, 'edge ' || id || ': ' || p AS problem FROM bad""")
def validate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.when(k % 5 == 0, "e").otherwise("edge_"), k.cast("string")).alias("id"), F.lit("edge/1").alias("schema_version"), F.when(F.col("s_nationkey") % 2 == 0, "likes").otherwise("blocks").alias("type"), _present(validate.vocab.EDGE_FIELDS, "", F.lit(False)).alias("present"))
    return validate.validate_edges(rows, "edge/1").select("id", "problem")


@query("""WITH s AS (SELECT DISTINCT 's' || user_id AS id, user_id FROM events),
bad AS (SELECT id, 'unknown status lost' AS p FROM s WHERE user_id % 3 = 0 UNION ALL SELECT id, 'missing policy' FROM s WHERE user_id % 4 = 0)
SELECT id, 'session ' || id || ': ' || p AS problem FROM bad""")
def validate_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    rows = table(spark, sf_dir, "events").select("user_id").distinct().select(F.concat(F.lit("s"), u.cast("string")).alias("id"), F.lit("session/1").alias("schema_version"), F.when(u % 3 == 0, "lost").otherwise("ended").alias("status"), _present(validate.vocab.SESSION_FIELDS, "policy", u % 4 == 0).alias("present"))
    return validate.validate_sessions(rows, "session/1").select("id", "problem")


PARTS = """n AS (SELECT s_suppkey % 9 AS ledger, s_suppkey AS ord, 'mem_' || s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN '[1]' WHEN s_suppkey % 10 = 1 THEN NULL ELSE 'object' END AS shape FROM supplier),
p AS (SELECT p_partkey % 9 AS ledger, p_partkey AS ord, 'patch_' || p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'forget' ELSE 'invent' END AS op FROM part),
c AS (SELECT c_custkey % 9 AS ledger, c_custkey AS ord, 'edge_' || c_custkey AS id FROM customer),
known AS (SELECT ledger, id FROM n), knownp AS (SELECT ledger, id FROM p),
bad AS (SELECT ledger, 0 AS kind, ord, 1 AS rule, 0 AS a, 0 AS b, 'node ' || id || ': unknown status gone' AS problem FROM n WHERE ord % 17 = 0
UNION ALL SELECT ledger, 0, ord, 2, 0, 0, 'node ' || id || ': relations must be object' FROM n WHERE shape IS NULL OR shape <> 'object'
UNION ALL SELECT ledger, 0, ord, 3, 1, 0, 'node ' || id || ': relations.note must be list' FROM n WHERE shape = 'object' AND ord % 3 = 0
UNION ALL SELECT ledger, 0, ord, 3, 0, b, 'node ' || id || ': relations.refines missing node ' || ref FROM (SELECT *, unnest([0, 1]) AS b, unnest(['mem_' || (ord + 9), 'mem_' || (ord * 3)]) AS ref FROM n WHERE shape = 'object') r WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.ledger = r.ledger AND known.id = r.ref)
UNION ALL SELECT ledger, 1, ord, 1, 0, 0, 'patch ' || id || ': unknown operation invent' FROM p WHERE op = 'invent'
UNION ALL SELECT ledger, 1, ord, 2, b, 0, 'patch ' || id || ': missing target node ' || ref FROM (SELECT *, unnest([0, 1]) AS b, unnest(['mem_' || (ord - 9), 'mem_' || ord]) AS ref FROM p) r WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.ledger = r.ledger AND known.id = r.ref)
UNION ALL SELECT ledger, 1, ord, 3, 0, 0, 'patch ' || id || ': missing new node mem_x' FROM p WHERE ord % 6 = 0
UNION ALL SELECT ledger, 2, ord, 1, 0, 0, 'edge ' || id || ': unknown type likes' FROM c WHERE ord % 8 = 0
UNION ALL SELECT ledger, 2, ord, 2, 0, 0, 'edge ' || id || ': missing from node mem_' || (ord + 18) FROM c WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.ledger = c.ledger AND known.id = 'mem_' || (c.ord + 18))
UNION ALL SELECT ledger, 2, ord, 3, 0, 0, 'edge ' || id || ': missing to node ' || CASE WHEN ord % 4 = 0 THEN 'undefined' ELSE 'mem_' || ord END FROM c WHERE ord % 4 = 0 OR NOT EXISTS (SELECT 1 FROM known WHERE known.ledger = c.ledger AND known.id = 'mem_' || c.ord)
UNION ALL SELECT ledger, 2, ord, 4, 0, 0, 'edge ' || id || ': missing source patch patch_' || (2 * ord) FROM c WHERE ord % 5 > 0 AND NOT EXISTS (SELECT 1 FROM knownp WHERE knownp.ledger = c.ledger AND knownp.id = 'patch_' || (2 * c.ord))
UNION ALL SELECT user_id % 9, 3, user_id, 1, 0, 0, 'session s' || user_id || ': unknown status lost' FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 = 0)"""


def _whole_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All problems of nine ledgers: suppliers are nodes, parts patches, customers edges, users sessions."""
    own = lambda k, prefix: [(F.col(k) % 9).alias("ledger"), F.col(k).alias("ord"), F.concat(F.lit(prefix), F.col(k).cast("string")).alias("id")]
    mem = lambda c: F.concat(F.lit("mem_"), c.cast("string"))
    full = lambda fields: _present(fields, "", F.lit(False)).alias("present")
    s, p, c, u = F.col("s_suppkey"), F.col("p_partkey"), F.col("c_custkey"), F.col("user_id")
    note = F.when(s % 3 == 0, F.lit(',"note":"mem_1"')).otherwise("")
    related = F.concat(F.lit('{"refines":["'), mem(s + 9), F.lit('","'), mem(s * 3), F.lit('"]'), note, F.lit("}"))
    nodes = table(spark, sf_dir, "supplier").select(
        *own("s_suppkey", "mem_"), F.lit(VERSION).alias("schema_version"), F.lit("task").alias("type"), F.when(s % 17 == 0, "gone").otherwise("active").alias("status"), F.lit("x").alias("content"), F.lit("l").alias("label"),
        F.array().cast("array<string>").alias("span_sources"), F.when(s % 10 == 0, "[1]").when(s % 10 > 1, related).alias("relations"), full(validate.vocab.NODE_FIELDS),
    )
    ops = F.element_at(F.array(*map(F.lit, ("create", "update", "forget", "invent"))), (p % 4 + 1).cast("int"))
    patches = table(spark, sf_dir, "part").select(
        *own("p_partkey", "patch_"), F.lit("patch/1").alias("schema_version"), ops.alias("operation"), F.array(mem(p - 9), mem(p)).alias("target_ids"), F.lit("new").alias("new_content"),
        F.when(p % 6 == 0, F.array(F.lit("mem_x"))).alias("new_node_ids"), full(validate.vocab.PATCH_FIELDS),
    )
    edges = table(spark, sf_dir, "customer").select(
        *own("c_custkey", "edge_"), F.lit("edge/1").alias("schema_version"), F.when(c % 8 == 0, "likes").otherwise("blocks").alias("type"), mem(c + 18).alias("from"), F.when(c % 4 > 0, mem(c)).alias("to"),
        F.when(c % 5 > 0, F.concat(F.lit("patch_"), (2 * c).cast("string"))).otherwise("").alias("source_patch_id"), full(validate.vocab.EDGE_FIELDS),
    )
    sessions = table(spark, sf_dir, "events").select("user_id").distinct().select(*own("user_id", "s"), F.lit("session/1").alias("schema_version"), F.when(u % 3 == 0, "lost").otherwise("ended").alias("status"), full(validate.vocab.SESSION_FIELDS))
    return validate.all_problems(nodes, patches, edges, sessions, {"node": VERSION, "patch": "patch/1", "edge": "edge/1", "session": "session/1"})


@query(f"WITH {PARTS} SELECT ledger, kind, ord, problem, count(*) AS n FROM bad GROUP BY ALL")
def reference_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of all four kinds of records, those of their references among them."""
    return _whole_ledgers(spark, sf_dir).groupBy("ledger", "kind", "ord", "problem").agg(F.count("*").alias("n"))


@query(f"WITH {PARTS}, o AS (SELECT *, (row_number() OVER (PARTITION BY ledger ORDER BY kind, ord, rule, a, b) - 1) // 50 AS block FROM bad) SELECT ledger, block, string_agg(problem, '; ' ORDER BY kind, ord, rule, a, b) AS problems, count(*) AS n_problems FROM o GROUP BY ledger, block")
def problem_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The problems of a ledger in the order of reading, fifty to a text."""
    return validate.problem_blocks(_whole_ledgers(spark, sf_dir), size=50)
