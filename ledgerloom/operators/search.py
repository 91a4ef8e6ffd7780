"""Search: filters, buckets, fan-out, hits, citations, references, scopes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import trimmed
from ledgerloom.operators.usage import latest

BUCKET_TOP, MEMORY_TOP = 10, 20


def parse_tag(tag: Column) -> Column:
    """struct<key,value> cut at the first colon and trimmed; null where either side is missing."""
    at = F.instr(tag, ":")
    return F.when((at > 1) & (at < F.length(tag)), F.struct(F.trim(F.substring_index(tag, ":", 1)).alias("key"), F.trim(F.substring(tag, at + 1, F.length(tag))).alias("value")))


def parse_tags(tags: Column) -> Column:
    """map of an array of tags; of a repeated key the last stays."""
    pairs = F.filter(F.transform(tags, parse_tag), lambda p: p.isNotNull())
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))


def build_filter(explicit: dict[str, str | Sequence[str]] | None = None, tags: Sequence[str] = (), sources: Sequence[str] = ()) -> dict[str, str | list[str]]:
    """One filter: tags over explicit keys, sources over both; no key, no filter."""
    found: dict = dict(explicit or {})
    for tag in tags:
        key, colon, value = tag.partition(":")
        if key and colon and value:
            found[key.strip()] = value.strip()
    if sources:
        found["source"] = sources[0] if len(sources) == 1 else list(sources)
    return found


def condition(wanted: dict[str, str | Sequence[str]]) -> Column:
    """A filter as a predicate on columns: all keys must hold; Catalyst pushes it to the scan."""
    each = [F.col(k) == v if isinstance(v, str) else F.col(k).isin(*v) for k, v in wanted.items()]
    return reduce(lambda a, b: a & b, each, F.lit(True))


def temporal(rows: DataFrame, mode: str, ts: str, key: str | None = None, start=None, end=None, tie: str | None = None) -> DataFrame:
    """Our reading of the temporal modes: before and after are strict, between includes both ends, as_of and latest keep each key's latest row (up to ``start``)."""
    at = F.col(ts)
    if mode == "before":
        return rows.filter(at < F.lit(start))
    if mode == "after":
        return rows.filter(at > F.lit(start))
    if mode == "between":
        return rows.filter(at.between(F.lit(start), F.lit(end)))
    if mode not in ("as_of", "latest"):
        raise ValueError(f"unknown temporal mode {mode}")
    if key is None:
        raise ValueError(f"{mode} needs a key")
    return latest(rows.filter(at <= F.lit(start)) if mode == "as_of" else rows, key, *filter(None, (ts, tie)))


def is_bucket_id(text: Column) -> Column:
    return text.rlike("(?i)^[a-f0-9]{32}$")


def resolve(asked: DataFrame, known: DataFrame, name: str, fallback: bool) -> DataFrame:
    """``asked`` with ``resolved``: the id of the first known row by ``ord`` whose name or id it is, else itself or null.

    Two equal joins on the exploded names, not one join on an OR.
    """
    names = known.select(F.explode(F.array("name", "id")).alias("called"), "id", "ord").groupBy("called").agg(F.min_by("id", "ord").alias("found"))
    joined = asked.join(names, F.col(name) == F.col("called"), "left")
    return joined.withColumn("resolved", F.coalesce("found", F.col(name)) if fallback else F.col("found")).drop("called", "found")


def resolve_within(asked: DataFrame, known: DataFrame, group: str, name: str) -> DataFrame:
    """``asked`` with ``resolved``: the id of the first known row of the same group whose name or id it is, else null. ``known``: group, name, id, ord."""
    names = known.select(F.col(group).alias("group_"), F.explode(F.array("name", "id")).alias("called"), "id", "ord").groupBy("group_", "called").agg(F.min_by("id", "ord").alias("resolved"))
    return asked.join(names, (F.col(group) == F.col("group_")) & (F.col(name) == F.col("called")), "left").drop("group_", "called")


def fan_out(hits: DataFrame, failed: Column | None = None) -> DataFrame:
    """All buckets' hits by score, best first, ties by bucket and place. Hits of failed buckets are left out; nothing is cut or deduplicated."""
    ok = hits if failed is None else hits.filter(~failed)
    return ok.orderBy(F.desc("score"), "bucket_ord", "hit_ord")


class SearchError(RuntimeError):
    """No bucket of a search could be searched."""


NO_BUCKETS = "found no searchable buckets"


def outcomes(branches: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, bucket_count, sources_searched, error): how many buckets answered, which were asked, and if none answered why, by the first that failed.

    ``branches``: query, bucket, bucket_ord, reason (null where the bucket answered). A query's buckets are a short list.
    """
    asked = F.transform(F.array_sort(F.collect_list(F.struct("bucket_ord", "bucket"))), lambda x: x["bucket"])
    one = branches.groupBy(query).agg(F.count_if(F.col("reason").isNull()).alias("bucket_count"), asked.alias("sources_searched"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("bucket_ord"))).alias("first_"))
    return one.withColumn("error", F.when(F.col("bucket_count") == 0, F.coalesce("first_", F.lit(NO_BUCKETS)))).drop("first_")


def search(hits: DataFrame, branches: DataFrame, query: str = "query_id") -> DataFrame:
    """Every query with its outcome and the hits of the buckets that answered, a row a hit, or one without a hit; ``place`` is a hit's rank, best first.

    ``hits``: query, bucket, hit_ord, id, score. Equal scores go by the order of buckets and hits.
    """
    answered = branches.filter("reason is null").select(query, "bucket", "bucket_ord")
    found = hits.join(answered, [query, "bucket"]).withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "bucket_ord", "hit_ord")))
    return outcomes(branches, query).join(found, query, "left")


def require_answers(found: DataFrame, query: str = "query_id") -> None:
    """Fail if a query's buckets all failed. An action, as a column that raises could be optimised away."""
    lost = outcomes(found, query).filter("error is not null").take(1)
    if lost:
        raise SearchError(str(lost[0].error))


def top_hits(hits: DataFrame, k: int = BUCKET_TOP, tie: str = "id") -> DataFrame:
    return hits.orderBy(F.desc("score"), tie).limit(k)


def fetch_cache(hits: DataFrame) -> DataFrame:
    """One entry an id, the last remembered."""
    return latest(hits, "id", "ord")


def hit_title(metadata: dict[str, Column], hit_id: Column) -> Column:
    return F.coalesce(*(trimmed(metadata[k]) for k in ("title", "name", "source", "document_id", "file_name") if k in metadata), hit_id)


def hit_url(url: Column, source_url: Column, bucket: Column, hit_id: Column, scheme: str = "memory") -> Column:
    """The hit's own address (``url`` even when blank hides ``source_url``), else one made of bucket and id."""

    def coded(c: Column) -> Column:
        out = F.url_encode(c)
        for said, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):  # what a URI's part leaves as it is
            out = F.replace(out, F.lit(said), F.lit(plain))
        return out

    made = F.concat(F.lit(f"{scheme}://bucket/"), coded(bucket), F.lit("/chunks/"), coded(hit_id))
    return F.coalesce(trimmed(F.coalesce(url, source_url)), made)


def citation_hits(responses: DataFrame) -> DataFrame:
    """Hits of responses without results: one for each citation, scored 1, with the whole context as text."""
    one = responses.select("response_id", "context", F.posexplode("citations").alias("pos", "c"))
    label = F.concat(F.lit("citation-"), (F.col("pos") + 1).cast("string"))
    return one.select("response_id", F.coalesce("c.chunk_id", "c.document_id", "c.source_id", label).alias("id"), F.lit(1.0).alias("score"), F.coalesce("context", F.lit("")).alias("text"), F.coalesce("c.index", F.col("pos") + 1).cast("bigint").alias("citation_index"), F.coalesce("c.title", "c.source_url").alias("citation"))


def clean_list(text: Column) -> Column:
    """A comma-separated text as an array without blanks; null if nothing is left."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def decode_refs(nested: Column, flat: Column, dotted: Column) -> Column:
    """An array of references: the nested one, else the flat key's, else the dotted key's."""
    own = F.filter(nested, lambda x: F.trim(x) != "")
    return F.coalesce(F.when(F.size(own) > 0, own), clean_list(flat), clean_list(dotted))


def allowed(requests: DataFrame, endpoints: DataFrame, tokens: DataFrame) -> DataFrame:
    """Requests with ``allowed``: the token has all scopes the endpoint asks for, and its bucket list, if any, names the bucket."""
    one = requests.join(endpoints, "endpoint", "left").join(tokens, "token", "left")
    scopes = F.size(F.array_except("required", "granted")) == 0
    bucket = F.col("buckets").isNull() | F.array_contains("buckets", F.col("bucket"))
    return one.withColumn("allowed", F.coalesce(scopes & bucket, F.lit(False))).drop("required", "granted", "buckets")


def visible(tools: DataFrame, gated: Sequence[str], enabled: bool) -> DataFrame:
    return tools if enabled else tools.filter(~F.col("name").isin(*gated))
