"""Language-model scoring by logistic context mixing over bits, in the order of the text.

A text is the sequence of its words in lower case, each closed by one blank, and an end (a blank alone).
Every byte is predicted bit by bit. Hashed contexts, which go on over the words' borders, give counts of zeros
and ones: the last 2 and 4 bytes, the word so far, and the word so far after the word before. A counter
that moves by 1/n for each bit is the mean of its bits, so the online update of all counters is a sum over the
training texts, which Spark adds up whatever the order. Counters share SLOTS places, as the hash decides.

The stretched predictions are combined by weights chosen by a gate, how often the word's and the longest
context were seen, and refined by a table of gate and outcome. Weights and table (some 9,600 numbers) are Spark sums
over all training texts, with their full counts; each bit is taken out of its own counts. Whoever wants to
learn them from less sets LEARNED_BYTES. While a text is scored, its own weights of mix and table move with it: after each
piece of the text (twice as long as the last one) they are corrected by what the piece has shown, so a
prediction depends on all that precedes it and on nothing else.

Last, a word's probability is mixed with that of the exact table of all training words, the base model, at
a rate learned for each size of count. The table is joined, never sent whole; only words so frequent that
there can't be more than FREQUENT of them are counted where they are read.

Null texts count as empty: an end alone. Null ids count as the empty text for the training split. Repeated
rows count and score each. Texts are taken together up to LONGEST_RUN bytes; a longer one is
learned from and scored whole and alone, which takes about 170 and 120 bytes of memory for each of its own. Without
training text every count is 0. An empty table gives an empty one. Only id and text are read; their names
don't clash with the columns made here. There are no ties.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_remainder, quoted, stage_table, whole

#: (bytes of context, four at most; 0 for the word so far, -1 for that and the word before; bits of its table).
CONTEXTS = ((2, 18), (4, 21), (0, 21), (-1, 21))
OFFSETS = np.concatenate([[0], np.cumsum([1 << bits for _, bits in CONTEXTS])])
SLOTS = int(OFFSETS[-1])
INPUTS, LONGEST, WORD = len(CONTEXTS), 1, 2
#: A frequent word makes up at least one part in so many of the training text, so there are no more of them.
FREQUENT = 1 << 20
#: Weights, refining table and shares are learned from all training texts; a caller may set a number of bytes beyond which a share of the rows, drawn by hash, stands for them.
LEARNED_BYTES, DRAWS = 1 << 80, 1 << 40
GATES, CELLS, SCALE = 64, 129, 12.0
#: Bytes of the first piece of a text, after which its own weights are corrected; each further piece is as long as all before.
PIECE = 32
#: Bytes whose numbers are held at once, about.
LONGEST_RUN = 1 << 18
#: Half bytes, or bytes, whose bits are worked on at once: enough that calls cost little, few enough for a core's cache.
PART = 1 << 14
#: Counts that are added up together; tasks whose tables are added first.
CHUNK, MERGED = 1 << 17, 16
#: Sizes of a count, and bins of a ratio of probabilities, for the last mix.
SIZES, BINS = 24, 400

ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: An odd number for each context; the upper bits of its product with the context are the place.
MULTIPLIERS = [np.uint64((int(ONE) * (2 * p + 3) ** 7 | 1) % (1 << 64)) for p in range(len(CONTEXTS))]
#: What a lower half's context adds, by the upper half.
STEPS = np.array([(i + 1) * int(TWO) % (1 << 64) for i in range(16)], np.uint64)
TALLY = "chunk int, low binary, at binary, more binary"


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words between 0x20 and 0x09-0x0D, with A-Z in lower case, and the end."""
    found = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower().split()
    found.append(b"")
    return found


#: For each half byte: the nodes of its four bits in the tree of its block (1 to 15), and the bits.
NODES = np.array([[1 << t | n >> 4 - t for t in range(4)] for n in range(16)], np.int64)
BITS = np.array([[n >> 3 - t & 1 for t in range(4)] for n in range(16)], np.int8)
FOUR = np.ones(4, np.float32)
#: Where the cells of a gate and bit begin: the four bits of each half byte, as one number.
FIRST_CELLS = ((2 * np.arange(GATES)[:, None, None] + BITS) * CELLS).astype(np.int32).view(np.complex128).ravel()


class Stream:
    """The bytes of some texts, one after the other, with the slots that predict their bits. No context reaches over a text's start."""

    def __init__(self, texts: list[list[bytes]]):
        self.texts = texts
        joined = [b" ".join(words) + b" " for words in texts]
        sizes = np.fromiter(map(len, joined), np.int64, len(joined))
        starts = np.cumsum(sizes) - sizes
        padded = b"".join([bytes(4), *joined])
        data = np.frombuffer(padded, np.uint8)[4:]
        self.starts, self.sizes = starts, sizes
        n, halves = len(data), (data >> 4, data & 15)
        self.half = np.concatenate(halves)
        self.ends = np.flatnonzero(data == 32)  # each token's last byte
        first = np.concatenate([[0], self.ends[:-1] + 1])
        self.lengths = lengths = self.ends + 1 - first
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(lengths.max(initial=0)), ONE, np.uint64))
            terms = powers.take(np.arange(n) - np.repeat(first, lengths))
            terms *= data + np.uint64(1)
            sums = np.cumsum(terms, dtype=np.uint64)
            sums -= terms
            bases = sums[first]
            before = sums.take(self.ends)
            before -= bases
            before[1:], before[:1] = before[:-1].copy(), 0
            before[np.searchsorted(first, starts)] = 0
            before *= TWO
            begun = sums
            begun -= np.repeat(bases, lengths)
            #: The four bytes before each, the last one lowest.
            tail = np.ndarray(n, ">u4", padded, strides=(1,)).astype(np.uint64)
            for j in range(4):
                tail[(starts + j)[sizes > j]] &= np.uint64((1 << 8 * j) - 1)
            step = STEPS.take(halves[0])
            #: The slot of each half byte in each context: first those of all upper halves, then the lower ones.
            self.slots = []
            for p, (k, bits) in enumerate(CONTEXTS):
                h = np.empty((2, n), np.uint64)
                if k > 0:
                    np.bitwise_and(tail, np.uint64((1 << 8 * k) - 1), out=h[0])
                elif k == 0:
                    h[0] = begun
                else:
                    np.add(begun, np.repeat(before, lengths), out=h[0])
                h[0] *= MULTIPLIERS[p]
                np.add(h[0], step, out=h[1])
                h >>= np.uint64(64 - bits + 4)
                h += np.uint64(OFFSETS[p] >> 4)
                h <<= np.uint64(4)
                h = h.ravel()
                h |= self.half
                self.slots.append(h.view(np.int64))

    @cached_property
    def text(self) -> np.ndarray:
        """Which text each byte is of."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def turns(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """All bytes by the turns in which a text's pieces are scored, the text of each, and where each turn ends. Even turns teach; a text's last piece, in an odd one, doesn't."""
        last = np.maximum(0, np.frexp((self.sizes - 1) / PIECE)[1])
        k = np.repeat(np.arange(len(last)), last + 1)
        piece = np.arange(len(k)) - np.repeat(np.cumsum(last + 1) - last - 1, last + 1)
        begins = np.where(piece > 0, PIECE << np.maximum(0, piece - 1), 0)
        lengths = np.minimum(PIECE << piece, self.sizes[k]) - begins
        turn = 2 * piece + (piece == last[k])
        order = np.argsort(turn, kind="stable")
        k, lengths, places = k[order], lengths[order], (self.starts[k] + begins)[order]
        places -= np.cumsum(lengths) - lengths
        turns = np.arange(lengths.sum())
        turns += np.repeat(places, lengths)
        return turns, np.repeat(k, lengths), np.cumsum(np.bincount(turn[order], lengths).astype(np.int64)).tolist()

    def per_word(self, cost: np.ndarray) -> np.ndarray:
        """Sums over each token's bytes."""
        return np.add.reduceat(cost, self.ends + 1 - self.lengths)


def streams(texts: Iterable[list[bytes]]) -> Iterator[tuple[int, int, Stream]]:
    """(first, last + 1, stream) over runs of texts, which are split as they are needed; a longer text is a run of its own."""
    low, size, run = 0, 0, []
    for words in texts:
        own = sum(map(len, words)) + len(words)
        if run and size + own > LONGEST_RUN:
            yield low, low + len(run), Stream(run)
            low, size, run = low + len(run), 0, []
        run.append(words)
        size += own
    if run:
        yield low, low + len(run), Stream(run)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The log odds of a one, from counts of any size."""
    return np.clip(np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))), -10, 10)


def seen(n: np.ndarray) -> np.ndarray:
    """How often, in eight steps."""
    return np.minimum(7, np.log2(n + 1).astype(np.int64) * 2 // 3 + (n > 0)).astype(np.uint8)


def cell_of(dot: np.ndarray) -> np.ndarray:
    """The cell of a log odds within 7.99."""
    return (dot * dot.dtype.type(8) + dot.dtype.type(CELLS / 2)).astype(np.int32)


def log_odds() -> np.ndarray:
    """What the cells stand for."""
    return (np.arange(CELLS) - CELLS // 2) / 8.0


def spread(weights: np.ndarray) -> list[np.ndarray]:
    """For each column, its numbers four times each, as one number: what multiplies the four bits of a half byte."""
    return [np.repeat(own, 4).view(np.complex128) for own in weights.T.astype(np.float32)]


def product(e: np.ndarray) -> np.ndarray:
    """Of each four numbers in a row."""
    e = e.reshape(-1, 4)
    return e[:, 0] * e[:, 1] * e[:, 2] * e[:, 3]


@dataclass
class Mixer:
    """Weights by gate, and the refining table of log odds by gate and cell."""

    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, INPUTS), 1.0 / INPUTS + 0.1))
    refine: np.ndarray = field(default_factory=lambda: np.repeat(log_odds()[None], GATES, 0))

    def told(self) -> np.ndarray:
        """By gate, value and cell of a bit's dot in its own favour: the table's log odds in that favour."""
        return np.concatenate([-self.refine[:, ::-1], self.refine], axis=1).astype(np.float32).ravel()


@dataclass(frozen=True)
class Inputs:
    """What each context says for the bits of a half byte, above 0 in their favour, and how often each block was seen."""

    #: The four bits' inputs, of ``kind``, in one number, for each slot of a half byte.
    packed: np.ndarray
    kind: type
    often: np.ndarray

    def gates(self, slots: list[np.ndarray]) -> np.ndarray:
        gate = self.often.take(slots[WORD] >> 4)
        gate *= 8
        gate += self.often.take(slots[LONGEST] >> 4)
        return gate

    def by_gate(self, s: Stream) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(gate, places of half bytes, inputs of their bits by context), a part of a gate's places at a time. The inputs hold until the next part."""
        gate = self.gates(s.slots)
        order = np.argsort(gate, kind="stable")
        slots = [k.take(order) for k in s.slots]
        ends = np.cumsum(np.bincount(gate, minlength=GATES)).tolist()
        held = np.empty(INPUTS * 4 * PART, np.float32)
        for g, (low, high) in enumerate(zip([0, *ends], ends)):
            for a in range(low, high, PART):
                b = min(high, a + PART)
                x = held[: INPUTS * 4 * (b - a)].reshape(INPUTS, -1)
                for own, row in zip(slots, x, strict=True):
                    self.packed.take(own[a:b], out=row.view(np.complex128), mode="clip")
                yield g, order[a:b], x

    def dots(self, slots: list[np.ndarray], half: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For the four bits of each half byte, one after the other: their inputs by the gate's ``spread`` weights, within 7.99, and the place of their gate, value and cell."""
        gate = self.gates(slots).astype(np.intp)
        dot = np.zeros(4 * len(gate), np.float32)
        for own, k in zip(weights, slots, strict=True):
            x = self.packed.take(k).view(self.kind).astype(np.float32, copy=False)
            x *= own.take(gate).view(np.float32)
            dot += x
        np.clip(dot, -7.99, 7.99, out=dot)
        cell = dot * np.float32(8)
        cell += np.float32(CELLS / 2)
        at = cell.astype(np.int32)
        gate *= 16
        gate += half
        at += FIRST_CELLS.take(gate).view(np.int32)
        return dot, at

    def parts(self, s: Stream, weights: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(places of half bytes, dots, places of gate, value and cell), one part after the other."""
        own = spread(weights)
        for a in range(0, len(s.half), PART):
            here = slice(a, a + PART)
            yield here, *self.dots([k[here] for k in s.slots], s.half[here], own)


@dataclass(frozen=True)
class Model:
    #: The input of each slot, in steps of 1 / SCALE; how often each block was seen.
    x: np.ndarray
    often: np.ndarray
    mixer: Mixer
    #: Frequent words and their counts.
    frequent: dict[bytes, int] = field(repr=False)
    #: The share of the exact table in the last mix, by the size of the count.
    shares: np.ndarray
    total: int = 0
    distinct: int = 0

    @cached_property
    def inputs(self) -> Inputs:
        packed = np.ascontiguousarray(self.x.reshape(-1, 16)[:, NODES])
        packed *= 2 * BITS - 1
        return Inputs(packed.view(np.int32).ravel(), np.int8, self.often)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "inputs"}  # each worker makes its own

    def costs(self, s: Stream) -> np.ndarray:
        """log2 of each token's improbability, in the order of the texts, with weights of the text's own."""
        n, texts = len(s.half) // 2, len(s.sizes)
        turns, of, ends = s.turns()
        weights, told = spread(self.mixer.weights / SCALE), self.mixer.told()
        v, bend, cost = np.full((texts, 2), 0.5), np.full(texts, 40.0), np.empty(n)
        for turn, (low, high) in enumerate(zip([0, *ends], ends)):
            grown, mine = np.zeros((2, texts)), spread(-v)
            for a in range(low, high, PART):
                b = min(high, a + PART)
                own, here = np.tile(of[a:b], 2), np.concatenate([turns[a:b], n + turns[a:b]])
                dot, at = self.inputs.dots([k.take(here) for k in s.slots], s.half.take(here), weights)
                fine = told.take(at)
                z = mine[0].take(own).view(np.float32)
                z *= dot
                other = mine[1].take(own).view(np.float32)
                other *= fine
                z += other
                np.clip(z, -13.8, 13.8, out=z)  # no bit costs more than 20
                e = np.exp(z, out=z)
                e += np.float32(1)
                halves = product(e)  # at most a million each, and of both half bytes a million millions
                cost[turns[a:b]] = np.log(halves[: b - a] * halves[b - a :])
                if turn % 2 == 0:
                    q = np.divide(1, e, out=e)
                    np.subtract(1, q, out=q)
                    fine *= q
                    wrong = q * dot
                    for total, bits in ((grown[0], wrong), (grown[1], fine)):
                        total += np.bincount(own, bits.reshape(-1, 4) @ FOUR, texts)
                    wrong -= wrong * q
                    wrong *= dot
                    bend += np.bincount(own, wrong.reshape(-1, 4) @ FOUR, texts)
            if turn % 2 == 0:
                v += np.clip(grown / (2 * bend), -0.25, 0.25).T
        return s.per_word(cost) / math.log(2)

    def joint(self, bits: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log2 of each token's improbability once its exact count is known."""
        share = self.shares[size_of(c)]
        base = (c + 0.1) / (self.total + 0.1 * (self.distinct + 1))
        return -np.log2((1 - share) * np.exp2(-bits) + np.where(c > 0, share * base, 0.0))


def size_of(c: np.ndarray) -> np.ndarray:
    """A count's size: 0 for none, else one more than its logarithm."""
    return np.minimum(SIZES - 1, np.where(c > 0, np.log2(np.maximum(c, 1)).astype(np.int64) + 1, 0))


def texts_of(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """The words of each text, one text after the other: all words of a batch would fill a worker's memory."""
    return (words_of(t.as_py()) for t in batch.column(0).cast(pa.binary()))


# Counting


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over a column of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[bytes] = Counter()
        for batch in batches:
            for words in texts_of(batch):
                sums.update(words)
                if len(sums) > 400_000:
                    yield flushed(sums)
                    sums = Counter()
        yield flushed(sums)

    def flushed(sums: dict[bytes, int]) -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(list(sums), pa.binary()), "c": pa.array(list(sums.values()), pa.int64())})

    return texts.mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def tally_rows(table: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """A table of counts by chunks: one byte a count, and what goes beyond."""
    for k in range(0, len(table), CHUNK):
        own = table[k : k + CHUNK]
        if own.any():
            at = np.flatnonzero(own > 255)
            yield k // CHUNK, zlib.compress(np.minimum(own, 255).astype(np.uint8).tobytes(), 1), at.astype(np.uint32).tobytes(), (own[at] - 255).astype(np.int64).tobytes()


def tally_add(table: np.ndarray, low: bytes, at: bytes, more: bytes) -> None:
    own = np.frombuffer(zlib.decompress(low), np.uint8)
    table[: len(own)] += own
    table[np.frombuffer(at, np.uint32)] += np.frombuffer(more, np.int64)


def tally_batch(rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    chunk, low, at, more = zip(*rows, strict=True)
    return pa.record_batch({"chunk": pa.array(chunk, pa.int32()), "low": pa.array(low, pa.binary()), "at": pa.array(at, pa.binary()), "more": pa.array(more, pa.binary())})


def count_halves(texts: DataFrame) -> np.ndarray:
    """How often each half byte was seen in each block. Each task sends its packed table in chunks; tables of MERGED tasks are added before all are."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, one = np.zeros(SLOTS, np.uint32), np.uint32(1)
        for batch in batches:
            for _, _, s in streams(texts_of(batch)):
                for k in s.slots:
                    np.add.at(table, k, one)
        for row in tally_rows(table):
            yield tally_batch([row])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, *row in zip(*(batch.column(c).to_pylist() for c in ("chunk", "low", "at", "more")), strict=True):
                tally_add(tables.setdefault(chunk, np.zeros(CHUNK, np.int64)), *row)
        for chunk, table in tables.items():
            for row in tally_rows(table):
                yield tally_batch([(chunk, *row[1:])])

    made = texts.mapInArrow(add, TALLY).withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    made = made.repartition("chunk", "deal").select("chunk", "low", "at", "more").mapInArrow(pack, TALLY).repartition("chunk").mapInArrow(pack, TALLY)
    total = np.zeros(SLOTS, np.float32)
    for r in made.toLocalIterator():  # SLOTS bounds them
        own = np.zeros(CHUNK, np.int64)
        tally_add(own, r.low, r.at, r.more)
        part = total[r.chunk * CHUNK : (r.chunk + 1) * CHUNK]
        part += own[: len(part)]
    return total


def bits_of(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each node of each block's tree, from the counts of its half bytes."""
    n0, n1 = np.zeros_like(halves).reshape(-1, 16), np.zeros_like(halves).reshape(-1, 16)
    below = halves.reshape(-1, 16)
    for t in (3, 2, 1, 0):  # the last bit first
        n0[:, 1 << t : 2 << t], n1[:, 1 << t : 2 << t] = below[:, ::2], below[:, 1::2]
        below = below[:, ::2] + below[:, 1::2]
    return n0.ravel(), n1.ravel()


# Learning


def left_out(n0: np.ndarray, n1: np.ndarray) -> Inputs:
    """The inputs of training bits, each taken out of its own counts. As they depend on slot and half byte only, they are worked out once."""
    packed = np.empty((len(n0), 4), np.float32)
    for k in range(0, len(n0), CHUNK):
        a, b = n0[k : k + CHUNK].reshape(-1, 16), n1[k : k + CHUNK].reshape(-1, 16)
        zero, one = stretched(np.maximum(0, a - 1), b), stretched(a, np.maximum(0, b - 1))
        packed[k : k + CHUNK] = np.where(BITS, one[:, NODES], -zero[:, NODES]).reshape(-1, 4)
    return Inputs(packed.view(np.complex128).ravel(), np.float32, seen(np.maximum(0, n0[1::16] + n1[1::16] - 1)))


@dataclass(frozen=True)
class Tally:
    """How often each half byte was seen in each block."""

    halves: np.ndarray

    @cached_property
    def inputs(self) -> Inputs:
        return left_out(*bits_of(self.halves))

    def __getstate__(self) -> dict:
        return {"halves": self.halves}  # each worker makes its own inputs


def summed(texts: DataFrame, size: int, add) -> np.ndarray:
    """The sum over all texts of vectors that ``add(vector, stream)`` fills. A task sends its own as one packed row, those of MERGED groups of tasks are added first."""

    def packed(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(total)
        if len(at):
            yield pa.record_batch({"at": pa.array([at.astype("<u4").tobytes()], pa.binary()), "v": pa.array([total[at].tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for _, _, s in streams(texts_of(batch)):
                add(total, s)
        yield from packed(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at, v in zip(batch.column(0), batch.column(1), strict=True):
                total[np.frombuffer(at.as_py(), "<u4")] += np.frombuffer(v.as_py())
        yield from packed(total)

    made = texts.mapInArrow(run, "at binary, v binary").withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(MERGED))).repartition("deal")
    out = np.zeros(size)
    for r in made.select("at", "v").mapInArrow(merge, "at binary, v binary").collect():  # MERGED rows of ``size`` numbers
        out[np.frombuffer(r["at"], "<u4")] += np.frombuffer(r.v)
    return out


def newton_sums(total: np.ndarray, left: Inputs, mixer: Mixer, s: Stream) -> None:
    """Add the stream's slopes (GATES x INPUTS) and bends (GATES x INPUTS x INPUTS) of the log likelihood at the mixer's weights."""
    slope, bend = total[: GATES * INPUTS].reshape(GATES, INPUTS), total[GATES * INPUTS :].reshape(GATES, INPUTS, INPUTS)
    weights = mixer.weights.astype(np.float32)
    with np.errstate(over="ignore"):
        for g, _, x in left.by_gate(s):
            q = weights[g] @ x
            np.exp(q, out=q)
            q += 1
            np.divide(1, q, out=q)  # how far the bit was not foreseen
            slope[g] += x @ q
            q -= q * q
            bend[g] += [x @ own for own in x * q]


def newton_step(mixer: Mixer, total: np.ndarray, ridge: float = 20.0) -> Mixer:
    slope, bend = total[: GATES * INPUTS].reshape(GATES, INPUTS), total[GATES * INPUTS :].reshape(GATES, INPUTS, INPUTS)
    bend = bend + ridge * np.eye(INPUTS)
    step = np.linalg.solve(bend, (slope - ridge * (mixer.weights - Mixer().weights))[:, :, None])[:, :, 0]
    return Mixer(np.round(mixer.weights + np.clip(step, -1, 1), 6), mixer.refine)


def refine_sums(total: np.ndarray, left: Inputs, mixer: Mixer, s: Stream) -> None:
    """Add how many bits fell near each gate and cell, and how many of them were ones."""
    hits, ones = total.reshape(2, GATES, CELLS)
    found = np.zeros(GATES * 2 * CELLS, np.int64)
    for _, _, at in left.parts(s, mixer.weights):
        found += np.bincount(at, minlength=len(found))
    zeros, own = found.reshape(GATES, 2, CELLS).transpose(1, 0, 2)
    hits += zeros[:, ::-1] + own
    ones += own


def refine_table(total: np.ndarray, prior: float = 8.0) -> np.ndarray:
    hits, ones = total[: GATES * CELLS].reshape(GATES, CELLS), total[GATES * CELLS :].reshape(GATES, CELLS)
    expected = squash(log_odds())[None]
    p = np.clip((ones + prior * expected) / (hits + prior), 1e-6, 1 - 1e-6)
    return np.round(np.log(p / (1 - p)), 6)


def left_out_costs(left: Inputs, mixer: Mixer, s: Stream) -> np.ndarray:
    """log2 of each training token's improbability, with every bit out of its own counts and no weights of the text's own."""
    cost, told = np.empty(len(s.half)), mixer.told()
    for here, dot, at in left.parts(s, mixer.weights):
        z = told.take(at)
        z += dot
        z *= np.float32(-0.5)
        e = np.exp(z, out=z)
        e += np.float32(1)
        cost[here] = np.log(product(e))
    return s.per_word(cost.reshape(2, -1).sum(axis=0)) / math.log(2)


def best_shares(n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Shares of the exact table by the size of the count, from tokens by size and bin of log2(exact / mixed)."""
    ratio = np.exp2((np.arange(BINS) - BINS // 2) / 4.0)
    share = np.full((SIZES, 1), 0.3)
    for _ in range(rounds):
        own = share * ratio / (share * ratio + 1 - share)
        share = ((n * own).sum(axis=1, keepdims=True) + 1.0) / (n.sum(axis=1, keepdims=True) + 4.0)
    share[0] = 0.0  # a word that is not in the table
    return np.round(share[:, 0], 6)


def learn_shares(texts: DataFrame, left, mixer: Mixer, counts: DataFrame, frequent, total: int, distinct: int) -> np.ndarray:
    """How far the exact table is to be trusted, from all training tokens, each out of its own count. Frequent words are counted where they are read, the others joined."""
    scale, schema = max(total - 1, 0) + 0.1 * (distinct + 1), "word binary, bits float, size int, at int, n bigint"

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs, known, n = left.value.inputs, frequent.value, np.zeros(SIZES * BINS, np.int64)
        for batch in batches:
            for _, _, s in streams(texts_of(batch)):
                words, bits = [w for own in s.texts for w in own], left_out_costs(inputs, mixer, s).astype(np.float32)
                c = np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))
                here, rare = c > 0, np.flatnonzero(c == 0)
                c = c[here] - 1
                ratio = 4 * (np.log2((c + 0.1) / scale) + bits[here])
                at = np.clip(np.trunc(ratio + np.copysign(0.5, ratio)) + BINS // 2, 0, BINS - 1).astype(np.int64)
                n += np.bincount(size_of(c) * BINS + at, minlength=SIZES * BINS)
                if len(rare):
                    none = pa.nulls(len(rare), pa.int32())
                    yield pa.record_batch([pa.array([words[i] for i in rare], pa.binary()), pa.array(bits[rare]), none, none, pa.array(np.ones(len(rare), np.int64))], names=["word", "bits", "size", "at", "n"])
        k = np.flatnonzero(n)
        yield pa.record_batch([pa.nulls(len(k), pa.binary()), pa.nulls(len(k), pa.float32()), pa.array((k // BINS).astype(np.int32)), pa.array((k % BINS).astype(np.int32)), pa.array(n[k])], names=["word", "bits", "size", "at", "n"])

    rows = texts.mapInArrow(cost, schema).join(counts.hint("shuffle_hash"), "word", "left")
    c = F.col("c") - 1
    size = F.coalesce("size", F.when(c > 0, F.least(F.lit(SIZES - 1), F.floor(F.log2(c)) + 1)).otherwise(0))
    ratio = F.log2((c + 0.1) / F.lit(scale)) + F.col("bits")
    at = F.coalesce("at", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.round(ratio * 4).cast("int") + BINS // 2)))
    n = np.zeros((SIZES, BINS))
    for r in rows.groupBy(size.alias("size"), at.alias("at")).agg(F.sum("n").alias("n")).collect():  # SIZES x BINS bound them
        n[r["size"], r["at"]] = r.n
    return best_shares(n)


def draws_learned(n_bytes: int) -> int:
    """Of DRAWS, how many a corpus of so many bytes learns its weights from."""
    return DRAWS if n_bytes <= LEARNED_BYTES else -(-DRAWS * LEARNED_BYTES // n_bytes)


def learn(docs: DataFrame, rows: Column, key: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame]:
    """The model of the rows for which the condition holds, and its word counts (word, c)."""
    training = docs.filter(rows).select(F.col(text).alias("t"), F.pmod(F.xxhash64(quoted(key), F.col(text)), F.lit(DRAWS)).alias("draw"))
    texts = training.select("t")
    counts = stage_table(count_words(texts), "counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.col("c") * (F.octet_length("word") + 1)).alias("bytes")).first()
    total, distinct = int(totals.n or 0), int(totals.v)
    often = counts.filter((F.col("c") >= 2) & (F.col("c") >= math.ceil(total / FREQUENT)))
    frequent = {bytes(r.word): r.c for r in often.toLocalIterator()}  # FREQUENT bounds them
    tally = Tally(count_halves(texts))
    mixer, sent = Mixer(), docs.sparkSession.sparkContext.broadcast
    draws, some = draws_learned(int(totals.bytes or 0)), texts
    if draws < DRAWS:
        some = training.filter(F.col("draw") < draws).select("t")
        some = stage_table(some.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "learned")  # about LEARNED_BYTES, read four times
    left, known = sent(tally), sent(frequent)
    for _ in range(2):
        mixer = newton_step(mixer, summed(some, GATES * INPUTS * (1 + INPUTS), lambda v, s, m=mixer: newton_sums(v, left.value.inputs, m, s)))
    mixer = Mixer(mixer.weights, refine_table(summed(some, 2 * GATES * CELLS, lambda v, s: refine_sums(v, left.value.inputs, mixer, s))))
    shares = learn_shares(some, left, mixer, counts, known, total, distinct)
    for b in (left, known):
        b.unpersist()
    n0, n1 = bits_of(tally.halves)
    return Model(np.round(stretched(n0, n1) * SCALE).astype(np.int8), seen(n0[1::16] + n1[1::16]), mixer, frequent, shares, total, distinct), counts


# Scoring


def scored(docs: DataFrame, model: Model, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score, bits_per_byte) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keyed = docs.select(F.col(text).alias("t"), quoted(key).alias("key"))
    schema = f"key {keyed.schema['key'].dataType.simpleString()}, row bigint, n_tokens bigint, known bigint, base double, bits double, n_bytes bigint, rare array<struct<word:binary,bits:float>>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = sent.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            for low, high, s in streams(texts_of(batch)):
                flat = [w for own in s.texts for w in own]
                sizes = np.fromiter(map(len, s.texts), np.int64, high - low)
                own = np.repeat(np.arange(high - low), sizes)
                bits = m.costs(s)
                c = np.fromiter(map(m.frequent.get, flat, repeat(0)), np.int64, len(flat))
                known = c > 0
                add = lambda v: np.bincount(own[known], v[known], high - low).astype(np.float64)  # noqa: E731, B023
                rare = np.flatnonzero(~known)
                pairs = pa.StructArray.from_arrays([pa.array([flat[i] for i in rare], pa.binary()), pa.array(bits[rare].astype(np.float32))], ["word", "bits"])
                starts = np.concatenate([[0], np.cumsum(np.bincount(own[rare], minlength=high - low))])
                n_bytes = np.bincount(s.text, minlength=high - low)
                yield pa.record_batch([
                    batch.column(1).slice(low, high - low), pa.array(np.arange(row, row + high - low)), pa.array(sizes), pa.array(np.bincount(own[known], minlength=high - low)),
                    pa.array(add(np.log10(c + 0.1))), pa.array(add(m.joint(bits, c))), pa.array(n_bytes), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pairs),
                ], names=["key", "row", "n_tokens", "known", "base", "bits", "n_bytes", "rare"])
                row += high - low

    read = stage_table(keyed.mapInArrow(score, schema), "scores")
    rare = read.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    c = F.coalesce("c", F.lit(0))
    size = F.when(c > 0, F.least(F.lit(SIZES - 1), F.floor(F.log2(c)) + 1)).otherwise(0).cast("int")
    share = F.element_at(F.array(*map(F.lit, model.shares.tolist())), size + 1)
    joint = -F.log2((1 - share) * F.pow(F.lit(2.0), -F.col("bits")) + F.when(c > 0, share * (c + 0.1) / F.lit(model.total + 0.1 * (model.distinct + 1))).otherwise(0.0))
    added = rare.join(counts.hint("shuffle_hash"), "word", "left").groupBy("row").agg(F.sum(F.log10(c + 0.1)).alias("more"), F.count_if(c > 0).alias("seen"), F.sum(joint).alias("joint"))
    scale = math.log10(model.total + 0.1 * (model.distinct + 1))
    bits = F.col("bits") + F.coalesce("joint", F.lit(0.0))
    return read.drop("rare").join(added, "row", "left").select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"),
        (bits * -math.log10(2)).alias("score"),
        (bits / F.col("n_bytes")).alias("bits_per_byte"),
    )


def score_report(docs: DataFrame) -> DataFrame:
    """Every document by a model of those whose id's remainder by 10 is not 0."""
    model, counts = learn(docs, id_remainder("doc_id", 10) != 0)
    rows = scored(docs.select("doc_id", whole("text").alias("text")), model, counts)
    return rows.select("doc_id", (id_remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"), "base_score", "score", "bits_per_byte")
