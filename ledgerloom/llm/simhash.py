"""SimHash fingerprints, and the search within a Hamming radius by permuted block tables.

A text's terms are its distinct words in lower case. Each term's hash votes, with the term's weight, for
or against each of BITS bits; the signs are the fingerprint. Weights grow with a term's length and the
logarithm of its count, and are whole numbers, so sums are exact and equal texts have equal fingerprints.

For the search, a fingerprint is cut into blocks and stands in one table for each, keyed by that block. Two
fingerprints within the radius differ in at most radius // blocks bits of some block, so a query that probes
each table with its block, and with up to so many bits of it turned, loses nothing. Fewer and wider blocks
need more probes and meet fewer strangers: ``layout`` chooses their number by the numbers of entries and
queries, so that keys widen with the logarithm of the corpus; whatever it chooses, the result is the same.
Copies are one entry with a count. The stated queries go against all entries.

Null texts count as empty; empty texts, and those without a word, have the fingerprint 0. A text of any length is
fingerprinted whole, in memory for its distinct words. Documents of one id follow each other by their texts, null ids first;
repeated rows stay and follow themselves. A single document follows itself, an empty table gives an empty one. Only
id and text are read, so no other column can clash.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import stage_table, whole

BITS = 256
#: Reaches texts whose weighted cosine is about 0.95.
RADIUS = 25
#: Bits of a block that are turned at most.
TURNED = 3
LANES = BITS // 64
KEPT_WORDS = 300_000
LONGEST = 12
ROWS_AT_ONCE = 8192


class TermHashes(dict):
    def __missing__(self, term: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[term] = h = hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=BITS // 8).digest()
        return h


@functools.lru_cache(maxsize=1)
def term_hashes() -> TermHashes:
    return TermHashes()


def weight(term: str, count: int) -> int:
    return min(len(term), LONGEST) * (1 + int(2 * math.log2(count)))


def fingerprint(text: str) -> np.ndarray:
    """LANES words of 64 bits."""
    terms = Counter(text.lower().split())
    signs = np.frombuffer(b"".join(map(term_hashes().__getitem__, terms)), np.uint8).reshape(len(terms), BITS // 8)
    weights = np.fromiter((weight(t, n) for t, n in terms.items()), np.float32, len(terms))
    votes = np.zeros(BITS)
    for at in range(0, len(terms), ROWS_AT_ONCE):  # sums of so many weights are exact in single precision
        part = weights[at : at + ROWS_AT_ONCE]
        votes += 2.0 * (part @ np.unpackbits(signs[at : at + ROWS_AT_ONCE], axis=1).astype(np.float32)) - float(part.sum())
    return np.packbits(votes > 0).view("<i8")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1 - sum(int(x).bit_count() for x in (a ^ b).view(np.uint64).tolist()) / BITS


def written(print_: np.ndarray) -> str:
    return print_.tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_column(text: Column | str) -> Column:
    """array<bigint> of LANES words."""

    @F.pandas_udf("array<bigint>")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype=object)

    return prints(whole(text))


def ends_of(blocks: int) -> list[int]:
    return [i * BITS // blocks for i in range(blocks + 1)]


def masks(width: int, turned: int) -> list[int]:
    """Up to ``turned`` bits of a block."""
    return [sum(1 << bit for bit in bits) for k in range(turned + 1) for bits in itertools.combinations(range(width), k)]


def layout(radius: int, entries: int, queries: int) -> int:
    """How many blocks cost least: rows of tables and probes, and strangers met by chance."""

    def cost(blocks: int) -> float:
        widths = [high - low for low, high in itertools.pairwise(ends_of(blocks))]
        probes = [sum(math.comb(w, k) for k in range(radius // blocks + 1)) for w in widths]
        return entries * blocks + queries * sum(probes) + queries * entries * sum(p / 2**w for p, w in zip(probes, widths, strict=True))

    return min(range(max(5, radius // (TURNED + 1) + 1), max(6, radius + 2)), key=cost)


def block_values(prefix: str, blocks: int) -> Column:
    """array<bigint> of the blocks of a fingerprint in columns of one lane each; a block may reach from one lane into the next."""
    found = []
    for low, high in itertools.pairwise(ends_of(blocks)):
        value, left = f"shiftrightunsigned({prefix}{low // 64}, {low % 64})", 64 - low % 64
        if left < high - low:
            value = f"({value} | shiftleft({prefix}{low // 64 + 1}, {left}))"
        found.append(F.expr(f"{value} & {(1 << high - low) - 1}L"))
    return F.array(*found)


def near_counts(prints: DataFrame, queries: Column, key: str = "doc_id", lanes: str = "lanes", radius: int = RADIUS) -> DataFrame:
    """(key, n_near) of the rows for which ``queries`` holds: how many other rows have a fingerprint within the radius."""
    if not 0 <= radius < BITS // 4:
        raise ValueError(f"the radius must be under {BITS // 4}")
    apart = lambda prefix: [F.col(lanes)[i].alias(f"{prefix}{i}") for i in range(LANES)]
    own, theirs = [f"own{i}" for i in range(LANES)], [f"theirs{i}" for i in range(LANES)]
    entries = prints.filter(F.col(lanes).isNotNull()).groupBy(*apart("theirs")).agg(F.count("*").alias("copies"))
    asked = prints.filter(queries & F.col(lanes).isNotNull()).select(*apart("own")).distinct()
    blocks = layout(radius, entries.count(), asked.count())
    turned = radius // blocks
    widths = [high - low for low, high in itertools.pairwise(ends_of(blocks))]
    cell = lambda value: F.shiftleft(F.col("table").cast("bigint"), max(widths)).bitwiseOR(value).alias("cell")
    wide = F.lit(masks(max(widths), turned))  # masks of narrower blocks are those below their width
    probes = asked.select(*own, F.posexplode(block_values("own", blocks)).alias("table", "value")).withColumn("width", F.element_at(F.lit(widths), F.col("table") + 1))
    probes = probes.select(*own, "table", "value", "width", F.explode(wide).alias("mask")).filter(F.col("mask") < F.expr("shiftleft(1L, width)"))
    probes = probes.select(*own, cell(F.col("value").bitwiseXOR(F.col("mask"))))
    tables = entries.select(*theirs, "copies", F.posexplode(block_values("theirs", blocks)).alias("table", "value")).select(*theirs, "copies", cell(F.col("value")))
    distance = functools.reduce(Column.__add__, (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(own, theirs, strict=True)))
    near = probes.hint("merge").join(tables.hint("merge"), "cell").filter(distance <= radius)  # Spark would judge the probes by the queries' size and broadcast them
    # A pair meets in many tables and counts in the first.
    first = F.array_position(F.zip_with(block_values("own", blocks), block_values("theirs", blocks), lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= turned), True) - 1
    sums = near.filter(first == F.shiftright("cell", max(widths))).groupBy(*own).agg((F.sum("copies") - 1).alias("n_near"))
    same = functools.reduce(Column.__and__, (F.col(lanes)[i] == F.col(own[i]) for i in range(LANES)))
    return prints.filter(queries).join(sums, same).select(key, "n_near")


_ROW = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("lanes", T.ArrayType(T.LongType())), T.StructField("edited_lanes", T.ArrayType(T.LongType())),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    T.StructField("part", T.IntegerType()), T.StructField("first", T.BooleanType()), T.StructField("last", T.BooleanType()), T.StructField("edge_text", T.StringType()),
])


def _against(text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    made = edited(text, following)
    other = fingerprint(made)
    return hashlib.sha256(made.encode("utf-8", "surrogatepass")).hexdigest(), other, likeness(own, other), likeness(own, theirs)


def follow(docs: DataFrame) -> DataFrame:
    """Each document beside the next by (doc_id, text), the last beside the first; nulls come first.

    One shuffle by ranges of the id; each task walks through its sorted range and leaves only its last
    document open. These few are finished from the first documents of the ranges that follow.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, first = TaskContext.get().partitionId(), None, True
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["t"], strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                own = fingerprint(text)
                if held is not None:
                    sha, other, near, near_next = _against(held[1], held[2], text, own)
                    rows.append((held[0], len(held[1]), sha, held[2], other, near, near_next, part, first, False, held[1] if first else None))
                    first = False
                held = doc_id, text, own
            yield _frame(rows)
        if held is not None:
            yield _frame([(held[0], len(held[1]), None, held[2], None, None, None, part, first, True, held[1])])

    spark = docs.sparkSession
    slim = docs.select("doc_id", whole("text").alias("t"))
    ranges = slim.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "t")
    walked = stage_table(ranges.mapInPandas(walk, _ROW), "walk")

    firsts = walked.filter("first").select(F.col("part").alias("p"), F.col("edge_text").alias("next_text"), F.col("lanes").alias("next_lanes"))
    parts = sorted(r.part for r in walked.filter("first").select("part").collect())  # one number for each range
    if not parts:
        return walked.drop("part", "first", "last", "edge_text")
    after = spark.createDataFrame([(p, n) for p, n in zip(parts, [*parts[1:], parts[0]], strict=True)], "part int, p int")

    @F.pandas_udf("edited_sha256 string, edited_lanes array<bigint>, near_edited double, near_next double")
    def finish(text: pd.Series, lanes: pd.Series, next_text: pd.Series, next_lanes: pd.Series) -> pd.DataFrame:
        rows = [_against(t, np.asarray(own, np.int64), n, np.asarray(theirs, np.int64)) for t, own, n, theirs in zip(text, lanes, next_text, next_lanes, strict=True)]
        return pd.DataFrame(rows, columns=["edited_sha256", "edited_lanes", "near_edited", "near_next"])

    ends = walked.filter("last").join(after, "part").join(firsts, "p").select("doc_id", "n_chars", "lanes", finish("edge_text", "lanes", "next_text", "next_lanes").alias("e")).select("doc_id", "n_chars", "e.edited_sha256", "lanes", "e.edited_lanes", "e.near_edited", "e.near_next")
    return walked.filter("not last").select(ends.columns).unionByName(ends)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[f.name for f in _ROW], dtype=object)
    return frame.assign(**{f.name: frame[f.name].astype("Int64") for f in _ROW if f.dataType == T.LongType()})


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likeness; for ids divisible by 50 also how many other documents are near."""

    @F.pandas_udf("string")
    def name(lanes: pd.Series) -> pd.Series:
        return pd.Series([written(np.asarray(x, np.int64)) for x in lanes], dtype=object)

    rows = stage_table(follow(docs), "prints")
    near = near_counts(rows, F.col("doc_id") % 50 == 0).groupBy("doc_id").agg(F.max("n_near").alias("n_near"))
    return rows.join(near, "doc_id", "left").select("doc_id", "n_chars", "edited_sha256", name("lanes").alias("fingerprint"), name("edited_lanes").alias("edited_fingerprint"), "near_edited", "near_next", "n_near")
