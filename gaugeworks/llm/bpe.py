"""Byte-level BPE: encoding by ranks, and decoding.

Method: the pieces that the pre-tokeniser's pattern finds, each distinct piece of a batch once, are laid out as
rows of padded numpy matrices, in buckets of similar length. Each round every row merges its leftmost pair of
least rank; pairs are looked up in a hash table of numpy arrays; rows without a pair that merges leave the matrix
(compaction). Equal pairs right of the leftmost one merge in the same round, unless a pair that comes about in between
has a lower rank and would go first; so a long piece of few different pairs takes few rounds. The ids equal those of the tiktoken library for the same ranks and pattern.

Defined results: null and empty texts have no ids; repeated rows give equal results; columns other than the text
are kept as they are unless named `ids` or `decoded`, which are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaugeworks.llm.common import slices, texts_of

NONE = np.uint32(0xFFFFFFFF)
#: Entries of a worker's memory of pieces; at this count it starts anew, which changes speed alone.
REMEMBERED = 120_000


class PairTable:
    """A hash table from pairs of ids to the id of their merger, whose order is the order of merging."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = int(np.ceil(np.log2(4 * len(left))))
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.merged = np.full(1 << self.bits, NONE, np.uint32)
        key = left << np.uint64(32) | right
        slot, todo = self._slot(key), np.arange(len(key))
        self.probes = 0
        while len(todo):  # the first of those that want a free slot gets it, the rest try the next slot
            self.probes += 1
            free = self.keys[slot[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            wanted, first = np.unique(slot[todo[free]], return_index=True)
            got = todo[free][first]
            self.keys[wanted], self.merged[wanted] = key[got], merged[got]
            todo = np.setdiff1d(todo, got)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id, which is also the rank, of each pair's merger; NONE where there is none."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        flat = key.ravel()
        slot = self._slot(flat)
        out = np.full(flat.shape, NONE, np.uint32)
        at = np.arange(len(flat))
        for _ in range(self.probes):
            found = self.keys[slot[at]]
            hit = found == flat[at]
            out[at[hit]] = self.merged[slot[at[hit]]]
            at = at[~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
            if not len(at):
                break
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
        return out.reshape(key.shape)


class Ranks(PairTable):
    """A vocabulary of byte strings, and the pairs that merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.uint32)
        pairs = (x for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids for x in (self.ids[t[:k]], self.ids[t[k:]], i))
        super().__init__(*np.fromiter(pairs, np.uint64).reshape(-1, 3).T)


@lru_cache(maxsize=2)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def _at_once(rank: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which columns merge: those of least rank, from the left, none that shares an id with the one before it."""
    merge = rank == least[:, None]
    run = merge[:, 1:] & merge[:, :-1]
    if run.any():  # overlapping pairs, as in aaaa: every other one, counted from the run's beginning
        cols = np.arange(rank.shape[1])
        begins = np.where(merge & ~np.pad(run, ((0, 0), (1, 0))), cols, 0)
        merge &= (cols - np.maximum.accumulate(begins, axis=1)) % 2 == 0
    return merge


def _overtaken(ranks: PairTable, ids: np.ndarray, merge: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Rows in which a merge makes a pair of a lower rank than its own, which would have to go before the next merge."""
    row, col = np.nonzero(merge)
    new = least[row]
    width = ids.shape[1]
    wide = np.pad(ids, ((0, 0), (2, 2)), constant_values=NONE)
    merged = np.pad(merge, ((0, 0), (2, 2)))
    before = np.where(merged[row, col], new, wide[row, col + 1])  # merges go from the left: the one before is done
    after = np.where(col + 2 < width, wide[row, col + 4], NONE)
    low = (ranks.lookup(before, new) < new) | (ranks.lookup(new, after) < new)
    return np.bincount(row[low], minlength=len(ids)) > 0


def merge_rows(ranks: Ranks, pieces: list[bytes]) -> list[np.ndarray]:
    """Ids of pieces of similar length, merged together as the rows of one padded matrix."""
    return merge_ids(ranks, ranks.of_byte[np.frombuffer(b"".join(pieces), np.uint8)], np.fromiter(map(len, pieces), np.int64, len(pieces)))


def merge_ids(ranks: PairTable, flat: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """What remains of rows of n ids each, which stand end to end in flat, when all pairs are merged."""
    count, width = len(n), int(n.max())
    ids = np.full((count, width), NONE, np.uint32)
    ids[np.arange(width) < n[:, None]] = flat
    rank = np.full((count, width), NONE, np.uint32)  # of the pair that begins in each column
    if width > 1:
        rank[:, :-1] = ranks.lookup(ids[:, :-1], ids[:, 1:])
    out: list = [None] * count
    row = np.arange(count)
    while len(row):
        least = rank.min(axis=1)
        over = least == NONE
        if over.any():
            for k in np.flatnonzero(over):
                out[row[k]] = ids[k, : n[k]].copy()
            stay = ~over
            row, n, least, ids, rank = row[stay], n[stay], least[stay], ids[stay], rank[stay]
            if not len(row):
                break
        merge = _at_once(rank, least)
        if merge.sum() > len(row):
            one = _overtaken(ranks, ids, merge, least)
            if one.any():  # the leftmost alone
                merge[one] &= np.cumsum(merge[one], axis=1) == 1
        # compaction: what merges into its left neighbour goes, and so do spare columns
        keep = np.arange(ids.shape[1]) < n[:, None]
        keep[:, 1:] &= ~merge[:, :-1]
        n = keep.sum(axis=1)
        width = int(n.max())
        ids = np.where(merge, least[:, None], ids)
        held = np.arange(width) < n[:, None]
        ids, rank, merge = (_packed_left(x, keep, held, spare) for x, spare in ((ids, NONE), (rank, NONE), (merge, False)))
        touched = merge.copy()  # pairs that begin with a new id or end in one
        touched[:, :-1] |= merge[:, 1:]
        r, c = np.nonzero(touched)
        last = c + 1 >= width
        rank[r, c] = np.where(last, NONE, ranks.lookup(ids[r, c], ids[r, np.where(last, c, c + 1)]))
    return out


def _packed_left(x: np.ndarray, keep: np.ndarray, held: np.ndarray, spare) -> np.ndarray:
    out = np.full(held.shape, spare, x.dtype)
    out[held] = x[keep]
    return out


def encode_pieces(ranks: Ranks, pieces: list[str]) -> dict[str, bytes]:
    """Packed ids (unsigned 32 bits, little-endian) of distinct pieces."""
    found: dict[str, bytes] = {}
    buckets: dict[int, list[tuple[str, bytes]]] = {}
    for p in pieces:
        raw = p.encode()
        if (whole := ranks.ids.get(raw)) is not None:
            found[p] = whole.to_bytes(4, "little")
        else:
            buckets.setdefault(len(raw) if len(raw) < 16 else 1 << len(raw).bit_length(), []).append((p, raw))
    for width, rows in buckets.items():
        step = max(1, (1 << 18) // width)
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            for (p, _), ids in zip(part, merge_rows(ranks, [raw for _, raw in part]), strict=True):
                found[p] = ids.astype("<u4").tobytes()
    return found


class Encoder:
    """Encodes texts by one vocabulary and pattern, and remembers pieces from batch to batch."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.find, self.known = ranks_of(path), regex.compile(pattern).findall, {}

    def batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; the distinct pieces of all texts share the matrices."""
        pieces = [self.find(t) for t in texts]
        new = set().union(*pieces).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*pieces)
        self.known.update(encode_pieces(self.ranks, list(new)))
        return [b"".join(map(self.known.__getitem__, p)) for p in pieces]


@lru_cache(maxsize=2)
def encoder_of(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _with(batch: pa.RecordBatch, name: str, values: list[bytes]) -> pa.RecordBatch:
    kept = [f for f in batch.schema.names if f != name]
    return pa.RecordBatch.from_arrays([*(batch.column(f) for f in kept), pa.array(values, pa.binary())], [*kept, name])


def encoded(batches: Iterable[pa.RecordBatch], path: str, pattern: str, column: str = "text", drop: bool = False) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(path, pattern)
    for batch in batches:
        for part in slices(batch, column):
            ids = encoder.batch(texts_of(part, column))
            yield _with(part.drop_columns([column]) if drop else part, "ids", ids)


def decoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    ranks = ranks_of(path)
    token = ranks.tokens.__getitem__
    for batch in batches:
        texts = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column("ids").to_pylist()]
        yield _with(batch, "decoded", texts)


def _schema(df: DataFrame, name: str, drop: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in (name, *drop)] + [T.StructField(name, T.BinaryType())])


def bpe_encode(df: DataFrame, path: str, pattern: str, column: str = "text", keep_text: bool = True) -> DataFrame:
    """Add `ids`: the text's token ids as packed little-endian unsigned 32-bit integers."""
    return df.mapInArrow(lambda batches: encoded(batches, path, pattern, column, not keep_text), _schema(df, "ids", () if keep_text else (column,)))


def bpe_decode(df: DataFrame, path: str) -> DataFrame:
    """Add `decoded`: the bytes that the packed `ids` stand for. An id outside the vocabulary fails the task."""
    return df.mapInArrow(lambda batches: decoded(batches, path), _schema(df, "decoded"))


def bpe_round_trip(df: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """bpe_encode and bpe_decode in one pass over the rows: `ids` and `decoded` instead of the text."""
    schema = _schema(df, "ids", (column, "decoded")).add("decoded", T.BinaryType())
    return df.mapInArrow(lambda batches: decoded(encoded(batches, path, pattern, column, True), path), schema)
