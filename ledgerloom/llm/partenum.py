"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles, as 64-bit hashes. Sets of linked documents differ in a
bounded number of shingles, given the sizes. Sizes are dealt into bands; for each band the domain of hashes
is cut into so many parts that linked sets agree in one of them (first level), and each part into
``second`` smaller ones of which all but one must agree (second level). What a set has in an agreeing part
is one signature, so linked sets share at least one: the join on signatures loses no link.

With SPARE parts more than needed, several signatures must agree, and a set may leave out all but one of
that number. It leaves out those of the fewest shingles (ties by hash), the empty ones first, as these join
sets that have nothing in common. What is left out depends on a signature's content alone, so the best of
the agreeing signatures is kept by both sets.

Candidates sharing a signature pass an exact bound (parities of hash cells, at least two a shingle, differ in
at most as many cells as the sets in shingles) and are then verified on the full sets. Copies share a set and
are one node.
A signature shared by up to FEW sets gives all its pairs. In a larger group every set is compared with a
pivot, links are joined into components, and groups that still span several components are compared with
further pivots. What is left after PIVOTS rounds is compared across components by the exact bound inside
tasks, block by block of BLOCK sets, and only pairs that pass it leave the task. So groups of near copies
cost one comparison a member, and no link between components goes unseen. Signatures that a sample of the
sets shows to be very frequent are dealt over SALTS tasks; their groups are joined by the pivots. The sample
decides where rows go, never which links are found.

Null or empty texts have an empty set and are linked with nothing. Repeated rows share a component. A very
long text is one set like any other; nothing is cut. Ties: a component is named by its least id, nulls last.
An empty table gives an empty one. Only the id and the text are read, so other columns can't clash;
``drop_near_copies`` returns them untouched.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import drop_table, quoted, stage_table, trimmed, unused, whole, worker_store
from ledgerloom.llm.components import components

#: First-level parts beyond those needed, as a share, without and with a second level.
SPARE = (0.4, 0.1)
#: Parity cells of the smallest sketch.
LEAST_CELLS = 1024
#: Sets of a signature that are all paired.
FEW = 8
#: Pivots tried in groups that span several components, before blocks are compared across them.
PIVOTS = 3
#: Sets of a group, about, that one task compares with as many others at a time.
BLOCK = 2048
#: Hashes of words, and set ids already emitted, that a worker keeps.
KEPT_WORDS, KEPT_SETS = 200_000, 100_000
#: Bits of the filter that spares the shuffle sets without candidates: eight a key, and at most so many.
FILTER_BITS = 1 << 27
#: Ids that are broadcast at most.
FEW_IDS = 50_000
#: A signature is hot if at least HOT_LEAST sets, and one in HOT_SHARE of all rows, seem to have it; one set in HOT_RATE is looked at. So at most HOT_SHARE are.
HOT_LEAST, HOT_SHARE, HOT_RATE = 2000, 4096, 64
SALTS = 32
#: Signatures or shingles that a task holds before it sends them.
SENT_ROWS = 1 << 16

ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * TWO
    x = (x ^ (x >> np.uint64(29))) * ONE
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes() -> WordHashes:
    return worker_store("shingle words", WordHashes)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z; splits at 0x20, 0x09-0x0D
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    acc = np.full(n, width, np.uint64)
    for j in range(width):
        acc = mix(acc * ONE + h[j : j + n])
    return np.unique(acc)


@dataclass(frozen=True)
class Threshold:
    """Linked: den * intersection >= num * union."""

    num: int = 90
    den: int = 100

    def most(self, size: int) -> int:
        """The size of the largest set that one of this size can be linked with."""
        return size * self.den // self.num

    def differing(self, total: int) -> int:
        """In how many shingles linked sets of this size together can differ."""
        return (self.den - self.num) * total // (self.den + self.num)

    def linked(self, inter: int, a: int, b: int) -> bool:
        return self.den * inter >= self.num * (a + b - inter)


@functools.lru_cache(maxsize=8)
def _bands(threshold: Threshold, top: int) -> list[tuple[int, int]]:
    found, low = [], 1
    while low <= top:
        high = max(low, threshold.most(threshold.most(low)))
        found.append((low, high))
        low = high + 1
    return found


def bands(threshold: Threshold, size: int) -> list[tuple[int, int, int]]:
    """(band, its largest size, shingles that may differ) of the bands that a set of this size takes part in."""
    top = 1 << max(10, size.bit_length())
    every = _bands(threshold, top)
    own = int(np.searchsorted([high for _, high in every], size))
    found = []
    for band in (own - 1, own):
        if band >= 0 and (band == own or threshold.num * size <= threshold.den * every[band][1]):
            high = every[band][1]
            found.append((band, high, threshold.differing(high + threshold.most(high))))
    return found


def signatures(hashes: np.ndarray, threshold: Threshold, second: int, salt: int = 0) -> np.ndarray:
    """All signatures of a set. ``second``: parts of the second level, 1 for none."""
    found = []
    with np.errstate(over="ignore"):
        if salt:
            hashes = np.sort(mix(hashes ^ np.uint64(salt)))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + ONE), dtype=np.uint64)])
        for band, _, differ in bands(threshold, len(hashes)):
            if not differ:  # only equal sets are linked, and these are one node
                continue
            need = differ + 1 if second == 1 else differ // 2 + 1
            spare = int(np.ceil(SPARE[second > 1] * need))
            first = need + spare
            parts = first * second
            edges = np.concatenate([[0], np.searchsorted(hashes >> np.uint64(32), (np.arange(1, parts, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts)), [len(hashes)]])
            part, sizes = (sums[edges[1:]] - sums[edges[:-1]]).reshape(first, second), np.diff(edges).reshape(first, second)
            if second > 1:  # all smaller parts but one
                part, sizes = part.sum(axis=1, dtype=np.uint64)[:, None] - part, sizes.sum(axis=1)[:, None] - sizes
            names = np.arange(parts, dtype=np.uint64) + np.uint64((band + 1) << 40)
            own = mix(part.ravel() + mix(names))
            found.append(own[np.lexsort((own, sizes.ravel()))[spare:]])
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the cells, as 64-bit words. The cells are a power of two; the upper half folds onto the lower, so sketches of two lengths compare."""
    cells = max(LEAST_CELLS, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((mix(hashes ^ TWO) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def differing_cells(a: Column, b: Column) -> Column:
    """In how many cells two sketches differ, the longer one folded once (linked sets' lengths differ by no more)."""
    xor = lambda x, y: F.zip_with(x, y, lambda v, w: v.bitwiseXOR(w))
    half = lambda x: xor(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")))
    shorter = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(x)
    return F.aggregate(xor(shorter(a, b), shorter(b, a)), F.lit(0), lambda n, x: n + F.bit_count(x))


def set_table(docs: DataFrame, size: int, key: str, text: str, row: Column | None = None) -> DataFrame:
    """(doc_id, n, sid, cells, and ``row``, if given, as row) of every row; sid is null for an empty set."""

    @F.pandas_udf("n bigint, sid bigint, cells array<bigint>")
    def describe(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:  # one set at a time
            own = shingles(t, size)
            rows.append((len(own), set_id(own) if len(own) else None, sketch(own) if len(own) else None))
        n, sid, cells = zip(*rows, strict=True) if rows else ((), (), ())
        return pd.DataFrame({"n": n, "sid": pd.array(sid, dtype="Int64"), "cells": pd.Series(cells, dtype=object)})

    more = [] if row is None else [row.alias("row")]
    return docs.select(F.col(key).alias("doc_id"), *more, describe(whole(text)).alias("s")).select("doc_id", *(["row"] if more else []), "s.*")


def signature_rows(docs: DataFrame, size: int, threshold: Threshold, second: int, text: str) -> DataFrame:
    """(sig, sid), a set's signatures once in each task."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, sids, held = [], [], 0
        for batch in batches:
            for t in batch.column(0):
                own = shingles(t.as_py(), size)
                if not len(own) or (sid := set_id(own)) in seen:
                    continue
                if len(seen) >= KEPT_SETS:
                    seen.clear()
                seen.add(sid)
                sigs.append(signatures(own, threshold, second))
                sids.append(np.full(len(sigs[-1]), sid, np.int64))
                held += len(sigs[-1])
                if held >= SENT_ROWS:
                    yield pa.record_batch({"sig": np.concatenate(sigs).view(np.int64), "sid": np.concatenate(sids)})
                    sigs, sids, held = [], [], 0
        if sigs:
            yield pa.record_batch({"sig": np.concatenate(sigs).view(np.int64), "sid": np.concatenate(sids)})

    return docs.select(text).mapInArrow(trimmed(emit), "sig bigint, sid bigint")


def hot_signatures(docs: DataFrame, size: int, threshold: Threshold, second: int, text: str) -> list[int]:
    """Signatures that are too frequent for one task, judged by the texts of one hash in HOT_RATE; HOT_SHARE bounds them."""
    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(HOT_RATE)) == 0)
    counts = stage_table(signature_rows(some, size, threshold, second, text).groupBy("sig").agg(F.count("*").alias("n")), "often")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter((F.col("n") >= HOT_LEAST // HOT_RATE) & (F.col("n") * HOT_SHARE >= total)).select("sig").collect()
    drop_table(counts)
    return sorted(r.sig for r in found)


def bucket_rows(rows: DataFrame, hot: list[int]) -> DataFrame:
    """(a, b, sig): candidate pairs (a < b, sig null), and the members of larger groups (b null). Each task has its own group of a hot signature."""
    hot_set = frozenset(hot)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, few, last, members = None, [], None, 0  # the group that is open: its first sets, the last set, how many

        def take(out: list, s: int) -> None:
            nonlocal last, members
            if s == last and members:
                return
            last, members = s, members + 1
            if sig in hot_set:
                if members == 1:
                    few.append(s)
            elif members <= FEW:
                out.extend((f, s, None) for f in few)
                few.append(s)
                return
            elif members == FEW + 1:
                out.extend((f, None, sig) for f in few)
            if s != few[0]:
                out.append((few[0], s, None))
            out.append((s, None, sig))

        for batch in batches:
            sigs, sids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sigs):
                continue
            out: list[tuple[int, int | None, int | None]] = []
            starts = np.concatenate([[0], np.flatnonzero(sigs[1:] != sigs[:-1]) + 1])
            ends = np.append(starts[1:], len(sigs))
            busy = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(sigs)) | np.isin(sigs[starts], hot_list))  # groups of one set inside a batch have no pair
            for i in busy:
                if sigs[starts[i]] != sig:
                    sig, few, last, members = int(sigs[starts[i]]), [], None, 0
                for s in sids[starts[i] : ends[i]].tolist():
                    take(out, s)
            if out:
                a, b, g = zip(*out, strict=True)
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sig": pa.array(g, pa.int64())})

    hot_list = np.array(hot, np.int64)
    salt = F.when(F.col("sig").isin(hot), F.pmod("sid", F.lit(SALTS))).otherwise(F.lit(0)) if hot else F.lit(0)
    dealt = (rows.repartition("sig", salt) if hot else rows.repartition("sig")).sortWithinPartitions("sig", "sid")
    return dealt.mapInArrow(trimmed(scan), "a bigint, b bigint, sig bigint")


def bit_of(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def filter_of(keys: DataFrame, key: str) -> tuple[Broadcast, int]:
    """A table of bits of the keys, to be tested by ``bit_of``, and how many bits it has."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (8 * keys.count()).bit_length()))
    words = keys.select(bit_of(key, bits).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).collect()  # FILTER_BITS / 64 rows at most
    table = np.zeros(bits // 64, np.int64)
    for r in words:
        table[r.word] = r.bits
    return keys.sparkSession.sparkContext.broadcast(table), bits


def possibly(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose key is wanted, and by chance a few more: spares a join's shuffle most of what it would drop."""
    (sent, n), names = filter_of(wanted, key), rows.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(0).to_numpy()
            yield batch.filter(pa.array((sent.value[bits >> 6] >> (bits & 63) & 1).astype(bool))).select(names)

    return rows.select(bit_of(key, n).alias("bit_"), *rows.columns).mapInArrow(keep, rows.schema)


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, label) after further links (a, b): only the labels that these connect are worked on."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}"))
    named = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    up = components(named)
    over = up.select(F.col("node").alias("label"), F.col("label").alias("upper"))
    return stage_table(labels.join(over, "label", "left").select("node", F.coalesce("upper", "label").alias("label")).unionByName(up), "labels")


class Join:
    """One run of the join over a table of documents. ``row`` may tell rows of one id apart."""

    def __init__(self, docs: DataFrame, size: int, threshold: Threshold, second: int, key: str, text: str, row: Column | None = None):
        self.docs, self.size, self.threshold, self.key, self.text = docs, size, threshold, key, text
        self.table = stage_table(set_table(docs, size, key, text, row), "sets")
        named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *(["row"] if row is not None else []))  # nulls come last
        self.nodes = stage_table(self.table.filter("sid is not null").groupBy("sid").agg(F.min("n").alias("n"), F.min(named).alias("first"), F.first("cells").alias("cells")), "nodes")
        self.hot = hot_signatures(docs, size, threshold, second, text)
        self.found = stage_table(bucket_rows(signature_rows(docs, size, threshold, second, text), self.hot), "candidates")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The linked pairs among distinct pairs (a, b) of set ids."""
        known = possibly(self.nodes, "sid", pairs.select(F.explode(F.array("a", "b")).alias("sid")))
        one = lambda x: known.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"cells_{x}"))
        t = self.threshold
        near = pairs.join(one("a"), "a").join(one("b"), "b")
        near = near.filter((t.num * F.greatest("n_a", "n_b") <= t.den * F.least("n_a", "n_b")) & (t.den - t.num != 0))
        near = near.filter(differing_cells(F.col("cells_a"), F.col("cells_b")) * (t.den + t.num) <= (t.den - t.num) * (F.col("n_a") + F.col("n_b")))
        near = stage_table(near.select("a", "b"), "near")
        sets = self.sets(near.select(F.explode(F.array("a", "b")).alias("sid")).distinct())

        @F.pandas_udf("boolean")
        def linked(a: pd.Series, b: pd.Series) -> pd.Series:
            out = []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                out.append(t.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            return pd.Series(out, dtype=bool)

        side = lambda x: sets.select(F.col("sid").alias(x), F.col("own").alias(f"own_{x}"))
        checked = near.select("a", "b").join(side("a"), "a").join(side("b"), "b")
        made = stage_table(checked.filter(linked("own_a", "own_b")).select("a", "b"), "links")
        drop_table(near)
        return made

    def sets(self, sids: DataFrame) -> DataFrame:
        """(sid, own): the full sets, at least those of the given ids, made from the texts of one document each."""
        size, key = self.size, self.key
        ids = self.nodes.join(sids, "sid").select(F.col("first.doc_id").alias("id_"))
        rows = self.docs.select(F.col(key).alias("id_"), F.col(self.text).alias("t_"))
        if sids.count() <= FEW_IDS:
            chosen = rows.join(F.broadcast(ids.distinct()), rows.id_.eqNullSafe(ids.id_), "left_semi").select(F.lit(0).cast("bigint").alias("bit"), "t_")
            sent = None
        else:
            sent, n = filter_of(ids, "id_")
            chosen = rows.select(bit_of("id_", n).alias("bit"), "t_")

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits, texts = batch.column(0).to_numpy(), batch.column(1)
                if sent is not None:
                    texts = texts.take(pa.array(np.flatnonzero(sent.value[bits >> 6] >> (bits & 63) & 1)))
                own, held = [], 0
                for t in texts:
                    one = shingles(t.as_py(), size)
                    if len(one):
                        own.append((set_id(one), one.tobytes()))
                        held += len(one)
                    if own and held >= SENT_ROWS:
                        yield batch_of(own)
                        own, held = [], 0
                if own:
                    yield batch_of(own)

        def batch_of(own: list[tuple[int, bytes]]) -> pa.RecordBatch:
            return pa.record_batch({"sid": pa.array([i for i, _ in own], pa.int64()), "own": pa.array([x for _, x in own], pa.binary())})

        return chosen.mapInArrow(trimmed(emit), "sid bigint, own binary").dropDuplicates(["sid"])

    def across(self, groups: DataFrame) -> DataFrame:
        """Pairs (a, b) of sets that share a group but no component, and whose sizes and sketches allow a link. ``groups`` says how many sets are in each."""
        t = self.threshold
        rows = groups.select("sig", "pivot", "sid", "label", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")).join(self.nodes.select("sid", "n", "cells"), "sid")
        own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("sig", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "sid", "label", "n", "cells", "pivot")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Groups of like members have the same pivot, meet in one task, and give a pair once."""
            seen: set[tuple[int, int]] = set()
            for pairs in compared(batches):
                if len(seen) > KEPT_SETS:
                    seen.clear()
                new = [x for x in zip(*(c.to_pylist() for c in pairs.columns), strict=True) if x not in seen]
                if new:
                    seen.update(new)
                    a, b = zip(*new, strict=True)
                    yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
                if not len(keys):
                    continue
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
                for low, high in zip(cuts, cuts[1:], strict=False):
                    if held and any(held[-1].column(i)[0] != batch.column(i)[low] for i in range(3)):
                        yield from found(held)
                        held = []
                    held.append(batch.slice(low, high - low))
            if held:
                yield from found(held)

        def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one = pa.Table.from_batches(parts)
            inside = one["low"][0] == one["high"][0]
            own, sid, label, n = (one[c].to_numpy() for c in ("own", "sid", "label", "n"))
            cells = [np.asarray(c.values.to_numpy()[s:e]).view(np.uint64) for chunk in one["cells"].chunks for c in [chunk] for s, e in zip(chunk.offsets.to_pylist(), chunk.offsets.to_pylist()[1:], strict=False)]
            width = np.array([len(c) for c in cells])
            by_width = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
            tables = {w: np.stack([cells[i] for i in at]) for w, at in by_width.items()}
            for w, at in by_width.items():
                for more, theirs in ((w, tables[w]), (2 * w, tables[2 * w][:, :w] ^ tables[2 * w][:, w:] if 2 * w in tables else None)):
                    if theirs is None:
                        continue
                    for k, i in enumerate(at.tolist()):
                        low = k + 1 if more == w else 0
                        j, cut = by_width[more][low:], theirs[low:]
                        fits = (label[j] != label[i]) & (t.num * np.maximum(n[j], n[i]) <= t.den * np.minimum(n[j], n[i]))
                        if not inside:
                            fits &= own[j] != own[i]
                        j, cut = j[fits], cut[fits]
                        if not len(j):
                            continue
                        differ = np.bitwise_count(cut ^ tables[w][k]).sum(axis=1, dtype=np.int64)
                        j = j[differ * (t.den + t.num) <= (t.den - t.num) * (n[j] + n[i])]
                        if len(j):
                            yield pa.record_batch({"a": np.minimum(sid[j], sid[i]), "b": np.maximum(sid[j], sid[i])})

        return rows.repartition("pivot", "low", "high").sortWithinPartitions("sig", "low", "high").mapInArrow(trimmed(compare), "a bigint, b bigint")

    def labels(self) -> DataFrame:
        """The components: (node, label) of every set but its component's least."""
        links = self.verified(self.found.filter("b is not null").select("a", "b").distinct())
        groups = self.found.filter("b is null").select("sig", F.col("a").alias("sid"))
        labels, hot = components(links), F.col("sig").isin(self.hot) if self.hot else F.lit(False)
        for turn in range(PIVOTS + 1):
            named = groups.join(labels, F.col("sid") == F.col("node"), "left").select("sig", "sid", F.coalesce("label", "sid").alias("label"))
            drawn = F.xxhash64("sid", F.lit(turn))
            spread = named.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("sid", drawn).alias("pivot"), F.min_by("label", drawn).alias("of"), F.count("*").alias("members")).filter("low < high")
            spread = stage_table(spread, "spread")
            still = named.filter(~hot).join(spread, "sig")
            if self.hot:
                still = still.unionByName(named.filter(hot).join(F.broadcast(spread.filter(hot)), "sig"))  # HOT_SHARE rows at most
            open_groups = stage_table(still, "groups")
            drop_table(spread)
            if open_groups.isEmpty():
                break
            if turn < PIVOTS:
                pairs = open_groups.filter("label <> of").select(F.least("pivot", "sid").alias("a"), F.greatest("pivot", "sid").alias("b"))
            else:
                pairs = self.across(open_groups)
            more = self.verified(stage_table(pairs.distinct(), "pairs"))
            groups = open_groups.select("sig", "sid")
            if not more.isEmpty():
                labels = merged(labels, more)
        return labels

    def members(self) -> DataFrame:
        """(sid, first, least): of every set its own first row and its component's."""
        named = self.nodes.select("sid", "first").join(self.labels(), F.col("sid") == F.col("node"), "left").select("sid", "first", F.coalesce("label", "sid").alias("label"))
        least = named.groupBy("label").agg(F.min("first").alias("least"))
        return named.join(least, "label").select("sid", "first", "least")

    def report(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        member = self.members().select("sid", F.col("least.doc_id").alias("component_id"))
        return self.table.join(member, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, size: int = 5, threshold: Threshold = Threshold(80), second: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its id, the size of its set, and the least id of its component (null only where all ids of the component are)."""
    return Join(docs, size, threshold, second, key, text).report()


def drop_near_copies(docs: DataFrame, size: int = 5, threshold: Threshold = Threshold(80), second: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the least id, and of rows with this id that of the least hash.

    Rows are told apart by all their values, not by the id, so a text is only left out for another row that holds its
    like. Of fully equal rows one stays. Rows without a word are like no other and all stay.
    """
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    row, twin = F.xxhash64(*map(quoted, plain)), F.xxhash64(F.lit(1), *map(quoted, plain))
    kept = Join(docs, size, threshold, second, key, text, F.struct(row.alias("r"), twin.alias("t"))).members().filter(F.col("first") == F.col("least")).select("first.row.*")
    r, t = unused(docs, "r"), unused(docs, "t")
    marked = docs.withColumns({r: row, t: twin})
    chosen = marked.join(kept.toDF(r, t), [r, t], "left_semi").dropDuplicates([r, t]).select(*map(quoted, docs.columns))
    return chosen.unionByName(docs.filter(~whole(text).rlike(r"[^\x20\x09-\x0D]")))
