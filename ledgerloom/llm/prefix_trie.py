"""The trie of all prefixes of conversations, from the Cartesian tree over their sorted order.

Conversations become keys, a fixed number of hexadecimal digits for each turn, and are sorted over all partitions; a
partition is a block. The common turns of neighbours are the LCP array. A pass over each block closes the nodes of its
Cartesian tree with a stack of what is open (``Spine``): a node is the interval of conversations between its nearest
smaller values, equal values make one node, and sums over the interval are carried on the stack, so the pass needs memory
for one path and not for its block. Intervals that cross the borders of blocks come out as one piece a block and depth;
the block where such a node starts is the nearest one to the left whose least common prefix is smaller (``smaller_before``
over the minima of blocks), and Spark adds the pieces up. Depths between a node and its parent are expanded last.

What passes through the driver is one number a block, hence as many as there are shuffle partitions. A group of equal
conversations is split over blocks as any rows are; its ids meet as texts of at most CHUNK ids, which one task reads in
order and forgets, as a digest must. Only a single conversation is held whole, as 32 digits and a count for each turn.

Rows without a conv_id belong to no conversation and are left out. Turns of equal number (or without one, which come
first) go by the digest of role and text; repeated rows are turns of their own. Null roles and texts are empty; only the
texts' digests and word counts are shuffled, so very long texts cost no memory. An empty table has no node, not even a
root. Only conv_id, turn, role and text are read, further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_remainder, stage_table, whole

#: Hexadecimal digits of a turn in a key: 128 bits of sha256.
DIGITS = 32
#: Ids in one text of a node's ids.
CHUNK = 500
WORD = r"[^\x20\x09-\x0D]+"
NODE, PIECE, BLOCK, IDS = range(4)
NOTHING = hashlib.sha256(b"").hexdigest()
WALKED = "kind int, block int, no bigint, parent_no bigint, low bigint, high bigint, n bigint, conv bigint, leaves bigint, children bigint, spare bigint, open_left boolean, open_right boolean, ends string, before array<bigint>"


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of digests, words: array of counts) of every conversation, in the order of its turns."""
    role, text = whole("role"), whole("text")
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGITS)
    slim = turns.filter("conv_id is not null").select("conv_id", F.struct("turn", digest.alias("h"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("w")).alias("t"))
    every = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))  # nulls first
    return every.select("conv_id", F.col("t.h").alias("turns"), F.col("t.w").alias("words"))


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first turns (fewer than ``most``, by the id's crc32) are those of the one that heads their ``every`` ids."""
    first = F.col("conv_id") - F.col("conv_id") % every
    heads = sequences(turns.filter(F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("head"), *(F.slice(c, 1, most - 1).alias(f"head_{c}") for c in ("turns", "words")))
    taken = id_remainder("conv_id", most).cast("int")

    def joined(c: str) -> Column:
        return F.concat(F.coalesce(F.slice(f"head_{c}", F.lit(1), taken), F.slice(c, 1, 0)), F.slice(c, taken + 1, F.size(c)))

    return sequences(turns).join(heads, first == F.col("head"), "left").select("conv_id", joined("turns").alias("turns"), joined("words").alias("words"))


class Node:
    """An open node: the turns it is deep, and sums over the conversations of its interval that have been seen.

    ``spare`` is the sum of their words minus the words of their distinct turns, both below the last shared head.
    """

    __slots__ = ("children", "chunks", "conv", "depth", "digest", "ids", "leaves", "n", "no", "open_left", "spare")

    def __init__(self, no: int, depth: int, open_left: bool = False):
        self.no, self.depth, self.open_left = no, depth, open_left
        self.n = self.leaves = self.children = self.spare = self.chunks = 0
        self.conv: int | None = None
        self.ids: list[str] = []
        self.digest = hashlib.sha256()

    def member(self, conv: int) -> None:
        self.n += 1
        self.conv = conv if self.conv is None else min(conv, self.conv)
        self.ids.append(str(conv))

    def absorb(self, child: Node, words: int) -> None:
        """Add a closed child; ``words`` are those of the turns down to this node."""
        self.n += child.n
        if child.conv is not None:
            self.conv = child.conv if self.conv is None else min(child.conv, self.conv)
        self.leaves += child.leaves
        self.children += not child.open_left
        self.spare += child.spare + words


def common(a: str, b: str) -> int:
    """The number of turns that two keys share."""
    shared = 0
    while (part := a[shared : shared + DIGITS]) and part == b[shared : shared + DIGITS]:
        shared += DIGITS
    return shared // DIGITS


class Spine:
    """The pass over one block. ``out`` gets rows in the order of WALKED."""

    def __init__(self, block: int, out: list[tuple], before: str | None = None):
        self.block, self.out, self.key, self.started = block, out, before, False
        self.stack: list[Node] = []
        self.words, self.serial, self.least = [0], 0, -1

    def push(self, depth: int, open_left: bool = False) -> Node:
        self.serial += 1
        self.stack.append(Node(self.serial, depth, open_left))
        return self.stack[-1]

    def row(self, key: str, conv: int, words: list[int]) -> None:
        lcp = -1 if self.key is None else common(self.key, key)
        self.least = min(lcp, self.least) if self.started else lcp
        if self.started:
            self.close(lcp)
        if key != self.key or not self.started:
            self.words = list(accumulate(words, initial=0))
        if not self.started and lcp >= 0:
            self.push(lcp, open_left=True)
        self.started, self.key = True, key
        if self.stack and self.stack[-1].depth == len(words):  # equal to the one before
            self.stack[-1].spare += self.words[-1]
        else:
            self.push(len(words))
        self.stack[-1].member(conv)
        if len(self.stack[-1].ids) >= CHUNK:
            self.flush(self.stack[-1])

    def close(self, lcp: int) -> None:
        """Close what is deeper than ``lcp``; all that lies on the path down to there stays open."""
        while self.stack and self.stack[-1].depth > lcp:
            node = self.stack.pop()
            if not node.children:
                node.leaves = 1
            if lcp >= 0 and (not self.stack or self.stack[-1].depth < lcp):
                parent = self.push(lcp, node.open_left)
                parent.n, parent.conv, parent.leaves, parent.spare, parent.children = node.n, node.conv, node.leaves, node.spare, int(not node.open_left)
            elif self.stack:
                parent = self.stack[-1]
                parent.absorb(node, self.words[parent.depth])
            else:
                parent = None
            self.emit(node, parent)

    def emit(self, node: Node, parent: Node | None, open_right: bool = False) -> None:
        low, piece = parent.depth + 1 if parent else 0, node.open_left or open_right
        if piece:
            self.flush(node)
        ends = None if piece else self.digest(node)
        before = [self.words[max(0, d - 1)] for d in range(low, node.depth + 1)]
        self.out.append((PIECE if piece else NODE, self.block, node.no, parent.no if parent else None, low, node.depth, node.n, node.conv, node.leaves, node.children, node.spare, node.open_left, open_right, ends, before))

    def flush(self, node: Node) -> None:
        """Put the ids that a node holds out as a text."""
        if node.ids:
            text = ",".join(node.ids)
            node.digest.update(("," * bool(node.chunks) + text).encode())
            self.out.append((IDS, self.block, node.no, None, node.chunks, None, len(node.ids), None, None, None, None, None, None, text, None))
            node.chunks += 1
            node.ids = []

    def digest(self, node: Node) -> str:
        if node.ids:
            node.digest.update(("," * bool(node.chunks) + ",".join(node.ids)).encode())
        return node.digest.hexdigest()

    def finish(self, after: str | None) -> None:
        """Close the block; what the next block's first key goes on with stays open to the right."""
        if not self.started:
            return
        self.close(-1 if after is None else common(self.key, after))
        while self.stack:
            node = self.stack.pop()
            parent = self.stack[-1] if self.stack else None
            if parent:
                parent.absorb(node, self.words[parent.depth])
            self.emit(node, parent, open_right=True)
        self.out.append((BLOCK, self.block, None, None, self.least, None, None, None, None, None, None, None, None, None, None))
        self.started = False


def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (block, part, key, conv_id, words) in order; part 0 is the last key of the block before, 2 the first one of the block after."""
    names = [c.split()[0] for c in WALKED.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c, kind in (x.split() for x in WALKED.split(", ")) if kind in ("int", "bigint")} | {"open_left": "boolean", "open_right": "boolean"})

    out: list[tuple] = []
    spine: Spine | None = None
    for batch in batches:
        for block, part, key, conv, words in zip(batch["block"].tolist(), batch["part"].tolist(), batch["key"], batch["conv_id"], batch["words"], strict=True):
            if spine is None or spine.block != block:
                if spine is not None:
                    spine.finish(None)
                spine = Spine(block, out, key if part == 0 else None)
            if part == 1:
                spine.row(key, int(conv), [int(w) for w in words])
            elif part == 2:
                spine.finish(key)
            if len(out) >= 10_000:
                yield frame(out)
                out.clear()
    if spine is not None:
        spine.finish(None)
    if out:
        yield frame(out)


def smaller_before(values: list[int]) -> list[int]:
    """For each value the place of the nearest smaller one before it, or -1."""
    found, open_ = [], []
    for i, value in enumerate(values):
        while open_ and values[open_[-1]] >= value:
            open_.pop()
        found.append(open_[-1] if open_ else -1)
        open_.append(i)
    return found


def start_of(blocks: list[int], least: list[int]) -> Column:
    """The block where the node of a piece starts, from ``block``, ``depth`` and ``open_left``."""
    place, before = {b: i for i, b in enumerate(blocks)}, smaller_before(least)

    @F.pandas_udf("int")
    def start(block: pd.Series, depth: pd.Series, open_left: pd.Series) -> pd.Series:
        found = []
        for b, d, left in zip(block.tolist(), depth.tolist(), open_left.tolist(), strict=True):
            i = place[b]
            if left:
                i -= 1
                while least[i] >= d:
                    i = before[i]
            found.append(blocks[i])
        return pd.Series(found, dtype="int32")

    return start("block", "depth", "open_left")


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest for each (start, depth) of texts in order; only the batch at hand is held."""
    at, state = None, None
    for batch in batches:
        done = []
        for start, depth, ids in zip(batch["start"].tolist(), batch["depth"].tolist(), batch["ends"], strict=True):
            if (start, depth) != at:
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = (start, depth), hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        yield pd.DataFrame(done, columns=["start", "depth", "ends"]).astype({"start": "int32", "depth": "int64", "ends": object})
    if at is not None:
        yield pd.DataFrame([(*at, state.hexdigest())], columns=["start", "depth", "ends"]).astype({"start": "int32", "depth": "int64"})


def in_blocks(rows: DataFrame) -> DataFrame:
    """The keys sorted over all partitions and cut into blocks, each with the last key before it and the first one after it."""
    keyed = rows.select("conv_id", F.array_join("turns", "").alias("key"), "words")
    ordered = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    body = stage_table(ordered.withColumn("block", F.spark_partition_id()), "sorted")
    borders = body.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    row = Window.orderBy("block")  # one row a block
    nearby = borders.select("block", F.lag("high").over(row).alias("before"), F.lead("low").over(row).alias("after"))
    edge = lambda part, c: nearby.filter(f"{c} is not null").select("block", F.lit(part).alias("part"), F.col(c).alias("key"), F.lit(None).cast("bigint").alias("conv_id"), F.lit(None).cast("array<bigint>").alias("words"))
    every = body.select("block", F.lit(1).alias("part"), "key", "conv_id", "words").unionByName(edge(0, "before")).unionByName(edge(2, "after"))
    return every.repartition("block").sortWithinPartitions("block", "part", "key", "conv_id")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """The nodes of all prefixes of ``rows`` (conv_id, turns, words), as ``conversation_trie`` returns them."""
    walked = stage_table(in_blocks(rows).mapInPandas(walk, WALKED), "walked")
    minima = sorted((r.block, r.low) for r in walked.filter(F.col("kind") == BLOCK).select("block", "low").collect())  # one a block
    start = start_of([b for b, _ in minima], [m for _, m in minima])
    by_depth = lambda nodes: nodes.select("*", F.posexplode("before").alias("pos", "w")).withColumn("depth", F.col("low") + F.col("pos"))
    top = F.col("depth") == F.col("high")

    pieces = by_depth(walked.filter(F.col("kind") == PIECE)).withColumn("start", start)
    children = F.when(top, F.col("children")).otherwise((~F.col("open_left")).cast("bigint"))
    whole_nodes = pieces.groupBy("start", "depth").agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("leaves").alias("leaves"), F.sum(children).alias("children"), F.sum("spare").alias("spare"), F.max("w").alias("w")
    )
    texts = walked.filter(F.col("kind") == IDS).select("block", "no", F.col("low").alias("chunk"), "ends")
    texts = texts.join(pieces.filter(top).select("block", "no", "start", "depth"), ["block", "no"])
    ends = texts.repartition("start", "depth").sortWithinPartitions("start", "depth", "block", "chunk").select("start", "depth", "ends").mapInPandas(digests, "start int, depth bigint, ends string")
    ids = pieces.select("block", "no", "depth", "start", "open_right", top.alias("top")).join(whole_nodes.select("start", "depth", "conv"), ["start", "depth"])
    above = ids.filter("open_right").select(F.col("block").alias("start"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent"))
    crossing = whole_nodes.join(above, ["start", "depth"], "left").join(ends, ["start", "depth"], "left").select(
        "conv", "depth", "parent", "n", "children", "leaves", "spare", "w", F.coalesce("ends", F.lit(NOTHING)).alias("ends")
    )

    closed = walked.filter(F.col("kind") == NODE)
    known = closed.select("block", "no", "conv").unionByName(ids.filter("top").select("block", "no", "conv"))
    linked = closed.join(known.select("block", F.col("no").alias("parent_no"), F.col("conv").alias("parent")), ["block", "parent_no"], "left")
    inner = by_depth(linked).select(
        "conv", "depth", F.when(F.col("depth") == F.col("low"), F.col("parent")).otherwise(F.col("conv")).alias("parent"), "n",
        F.when(top, F.col("children")).otherwise(1).alias("children"), "leaves", "spare", "w", F.when(top, F.col("ends")).otherwise(NOTHING).alias("ends"),
    )
    return inner.unionByName(crossing).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("spare") - (F.col("n") - 1) * F.col("w")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations: smallest member, depth, parent's member, numbers of members, children and leaves, words saved below it when shared turns are read once, digest of the ids that end there."""
    return prefix_trie(rebuilt(turns))


#: The same from the list of all prefixes.
TRIE_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, substr(sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS h,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h, w) AS pos FROM t),
bits AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS crc FROM (SELECT DISTINCT conv_id FROM o)
  UNION ALL SELECT conv_id, s, k + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)
  FROM (SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN xor(crc, CAST(ascii(substr(s, k // 8 + 1, 1)) AS BIGINT)) ELSE crc END AS x FROM bits WHERE k < 8 * length(s))),
c AS (SELECT conv_id, xor(crc, CAST(4294967295 AS BIGINT)) % 4 AS taken FROM bits WHERE k = 8 * length(s)),
r AS (SELECT c.conv_id, h, w, 0 AS own, pos FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND pos <= taken
  UNION ALL SELECT c.conv_id, h, w, 1, pos FROM c JOIN o ON o.conv_id = c.conv_id AND pos > taken),
p AS (SELECT conv_id, w, row_number() OVER a AS depth, string_agg(h, '') OVER a AS path FROM r WINDOW a AS (PARTITION BY conv_id ORDER BY own, pos)),
m AS (SELECT conv_id, w, depth, path FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(w) AS saved FROM m GROUP BY path, depth),
e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY path),
k AS (SELECT substr(path, 1, length(path) - 32) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
a AS (SELECT substr(n.path, 1, 32 * d) AS path, sum(saved) AS saved, count(*) FILTER (k.path IS NULL) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM n) AS n LEFT JOIN k ON k.path = n.path GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN a ON a.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN e ON e.path = n.path LEFT JOIN n AS u ON n.depth > 0 AND u.path = substr(n.path, 1, length(n.path) - 32)
"""
