"""Byte-level BPE: exact encoding by backtracking over longest matches, decoding by an offset table.

A sequence of tokens is what the merges give exactly when every two neighbours are what the merges give
for their joined bytes. So the encoder takes at each position the longest token (Aho-Corasick, one pass
for a whole piece), accepts it if the pair with its left neighbour is compatible, else tries the next
shorter token there, and steps back one token where none is left; a position given up is never tried
again, so the work is linear. Pairs are decided by undoing merges at the seam and are kept in a table.

The files of a vocabulary are read where they lie (``path``), never copied. Texts: null counts as empty,
an empty text has no token. The literal of a special token becomes its id. A very long text is encoded whole, piece by piece, in
memory for its ids; a very long piece too, in linear time. Ties don't arise: of equal merges the left one comes first. Repeated
rows stay and are encoded alike, an empty table gives an empty one. Result columns replace columns of the same names, all others
are kept.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ledgerloom.llm.common import whole, worker_store

DEFAULT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Fixed value: how byte-level vocabularies of this kind cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces that a worker keeps encoded; beyond it the store starts anew.
KEPT_PIECES = 200_000
#: Compatible and incompatible pairs that a worker keeps.
KEPT_PAIRS = 300_000
#: Documents whose ids are handed on at a time.
ROWS = 128


def _byte_of_letter() -> dict[str, int]:
    """Vocabulary files show printable bytes as themselves and the others as letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe(dict):
    """Maps a piece of text to the packed little-endian ids of its tokens."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = _byte_of_letter()
        vocab = {t: i for t, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = {"".join(chr(byte[c]) for c in t): i for t, i in vocab.items() if t not in special}
        size = 1 + max([*vocab.values(), *special.values()])
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        for n, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            made = vocab[a + b]
            self.rank[made], self.left[made], self.right[made] = n, vocab[a], vocab[b]
            self.merged[vocab[a], vocab[b]] = made
        self.finder = ahocorasick.Automaton()
        self.length, self.shorter = [0] * size, [-1] * size
        for text, i in plain.items():
            self.finder.add_word(text, i)
            self.length[i] = len(text)
            self.shorter[i] = next((plain[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in plain), -1)
        self.finder.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = regex.compile(PIECES)
        content = [b""] * size
        for text, i in plain.items():
            content[i] = text.encode("latin-1")
        for text, i in special.items():
            content[i] = text.encode()
        self.blob = np.frombuffer(b"".join(content), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in content])])

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave these two tokens side by side."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._seam_holds(a, b)
        return known

    def _seam_holds(self, x: int, y: int) -> bool:
        rank, before = self.rank, len(self.rank)
        while True:
            made = self.merged.get((x, y))
            if made is not None and rank[made] < before:
                return False  # this merge over the seam came first
            if rank[x] > rank[y]:
                before, x = rank[x], self.right[x]
            elif rank[y] >= 0:  # of equal merges the left one comes first, and so one over the seam
                before, y = rank[y] + 1, self.left[y]
            else:
                return True

    def tokens(self, piece: bytes) -> list[int]:
        """The ids of one piece's bytes."""
        n, letters = len(piece), piece.decode("latin-1")
        longest = [-1] * n
        for end, token in self.finder.iter(letters):
            longest[end - self.length[token] + 1] = token  # later ends are longer
        found, at, given_up = [], 0, set()
        token = longest[0] if n else -1
        while at < n:
            end = at + self.length[token] if token >= 0 else -1
            if token < 0:  # nothing fits here: give the position up, shorten the token before
                given_up.add(at)
                token = found.pop()
                at -= self.length[token]
                token = self.shorter[token]
            elif end not in given_up and (not found or self.fits(found[-1], token)):
                found.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                token = self.shorter[token]
        return found

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.tokens(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(self) >= KEPT_PIECES:
            self.clear()
        self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """All ids of a text, packed."""
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, self.pieces.findall(text)))
        return b"".join(np.uint32(self.special[part]).astype("<u4").tobytes() if part in self.special else b"".join(map(self.__getitem__, self.pieces.findall(part))) for part in self.cut.split(text))

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: each token's bytes lie at its offset in one table."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1] if len(ids) else 0) + np.repeat(starts - (ends - sizes), sizes)
        return self.blob[where].tobytes().decode("utf-8", "replace")


def vocabulary(path: str) -> ByteBpe:
    return worker_store(f"vocabulary {path}", lambda: ByteBpe(path))


def encode_column(text: Column | str, path: str = DEFAULT_VOCABULARY) -> Column:
    """array<int> of token ids."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        bpe = vocabulary(path)
        return pd.Series([np.frombuffer(bpe.encode(t), "<i4") for t in texts], dtype=object)

    return encode(whole(text))


def decode_column(ids: Column | str, path: str = DEFAULT_VOCABULARY) -> Column:
    """The text of an array of token ids; null stays null."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        bpe = vocabulary(path)
        return pd.Series([None if r is None else bpe.decode(np.asarray(r, "<u4").tobytes()) for r in rows], dtype=object)

    return decode(F.col(ids) if isinstance(ids, str) else ids)


def encode_documents(docs: DataFrame, path: str = DEFAULT_VOCABULARY, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` and ``n_tokens``, which take the place of columns of these names.

    Rows are handed on in small batches, so the memory of a task doesn't grow with its ids.
    """
    kept = docs.drop("token_ids", "n_tokens")
    place = [c.lower() for c in kept.columns].index(text.lower())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                packed = [bpe.encode(t or "") for t in part.column(place).to_pylist()]
                sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(sizes)], names=[*part.schema.names, "token_ids", "n_tokens"])

    schema = StructType([*kept.schema, StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())])
    own = {c.lower() for c in docs.columns}
    order = [*docs.columns, *(c for c in ("token_ids", "n_tokens") if c not in own)]
    return kept.mapInArrow(encode, schema).select([F.col(f"`{c}`") for c in order])


def token_report(docs: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Per document the number of tokens, the digest of its ids, and that of the decoded text."""

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def report(texts: pd.Series) -> pd.DataFrame:
        bpe, rows = vocabulary(path), []
        for t in texts:
            packed = bpe.encode(t)
            back = bpe.decode(packed).encode("utf-8", "surrogatepass")
            rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", report(whole("text")).alias("r")).select("doc_id", "r.*")
