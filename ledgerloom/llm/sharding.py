"""Sharding by extendible hashing.

A document's shard is the shortest prefix of its hash bits whose documents fit the byte limit, as when a
directory starts with one bucket and only oversized buckets are split on another bit. The sizes of all
prefixes of a window of bits come from one pre-aggregated sum by the window's longest prefix, so a round
over WINDOW bits replaces WINDOW splits; documents of buckets that are still too large go to the next
round, and no directory passes through the driver. The hash is of the id, hence even for any text.

Rows with one id share all bits: a bucket with a single id is never split, even when it exceeds the limit
(``oversize``), as is one very long text; texts are only measured here. A null id hashes as the empty text, a null or empty text
has no byte. Repeated rows stay together, so no tie is to be broken. An empty table has no shard. Other columns are passed on by
``write_shards``, whose own ``shard`` replaces one of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage_table, unused, whole

BITS, WINDOW = 60, 12
#: Bytes of text in a shard at most.
SHARD_BYTES = 2 << 20


def hash_bits(key: Column | str) -> Column:
    """The first 60 bits of the md5 of the key's text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("bigint")


def directory(sizes: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(h, depth, prefix, shard_bytes, oversize) for a table of distinct hashes with their ``bytes``."""
    rest, parts = sizes, []
    for low in range(0, BITS, WINDOW):
        high = low + WINDOW
        prefix = F.shiftright("h", BITS - high)
        fine = rest.groupBy(prefix.alias("p")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("ids"))
        depths = F.explode(F.sequence(F.lit(low + 1 if low else 0), F.lit(high)))
        every = fine.select("p", "bytes", "ids", depths.alias("depth")).withColumn("prefix", F.expr(f"shiftright(p, {high} - depth)"))
        buckets = every.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("ids").alias("ids"))
        fits = buckets.filter((F.col("shard_bytes") <= limit) | (F.col("ids") == 1)).drop("ids")
        leaf = every.select("p", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("p").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
        placed = stage_table(rest.join(leaf, F.shiftright("h", BITS - high) == leaf.p, "left").select("h", "bytes", "leaf"), "shards")
        parts.append(placed.filter("leaf is not null").select("h", "leaf.*"))
        rest = placed.filter("leaf is null").select("h", "bytes")
        if rest.isEmpty():
            break
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return made.withColumn("oversize", F.col("shard_bytes") > limit)


def shard_names(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, depth, shard, shard_bytes, oversize) of every row."""
    slim = stage_table(docs.select(F.col(key), hash_bits(key).alias("h"), F.octet_length(whole(text)).cast("bigint").alias("n_bytes")), "sizes")
    sizes = slim.groupBy("h").agg(F.sum("n_bytes").alias("bytes"))
    placed = directory(sizes, limit)
    return slim.join(placed, "h").select(key, "n_bytes", F.col("depth").cast("int").alias("depth"), F.concat_ws("-", "depth", "prefix").alias("shard"), "shard_bytes", "oversize")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` to one folder for each shard. Rows of one id go to one shard; a column named ``shard`` is replaced."""
    own = unused(docs, "_id")
    names = shard_names(docs.select(key, text), limit, key, text).groupBy(F.col(key).alias(own)).agg(F.first("shard").alias("shard"))
    rows = docs.drop("shard").join(names, docs[key].eqNullSafe(F.col(own))).drop(own)
    rows.repartition("shard").write.partitionBy("shard").parquet(path)


#: The same directory in SQL: all depths of all documents.
SHARD_SQL = f"""
WITH d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS b FROM documents),
levels AS (SELECT d.doc_id, d.h, d.b, CAST(k AS INTEGER) AS depth, h >> CAST(60 - k AS INTEGER) AS prefix FROM d, range(0, 61) AS g(k)),
buckets AS (SELECT depth, prefix, sum(b) AS bytes, count(DISTINCT h) AS ids FROM levels GROUP BY depth, prefix),
leaf AS (SELECT h, min(depth) AS depth FROM levels JOIN buckets USING (depth, prefix) WHERE bytes <= {SHARD_BYTES} OR ids = 1 GROUP BY h)
SELECT d.doc_id, d.b AS n_bytes, leaf.depth, CAST(leaf.depth AS VARCHAR) || '-' || CAST(d.h >> (60 - leaf.depth) AS VARCHAR) AS shard,
  CAST(bytes AS BIGINT) AS shard_bytes, bytes > {SHARD_BYTES} AS oversize
FROM d JOIN leaf USING (h) JOIN buckets ON buckets.depth = leaf.depth AND buckets.prefix = d.h >> (60 - leaf.depth)
"""
