"""Byte-level BPE encoding and decoding by ranks.

Pre-tokens are put into padded matrices by length.  In every round each row
merges its leftmost pair of least rank; ranks of pairs come from a hashed
table; finished rows leave and the matrix is compacted.  Pre-tokens longer than
the widest matrix, whose rounds would cost the square of their length, merge in
the same order by a heap.

Defined results: null and empty texts have no ids; text that looks like a
special token is ordinary text; texts of any length are encoded whole; every row
of the input gives one row, also where doc_id is null or comes again; columns ids
and decoded of the input are replaced, all others carried, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.units import Remembering, binary, parts, slices

#: Widest matrix; longer pre-tokens take the heap.
WIDEST = 256
#: Cells of a matrix at most.
CELLS = 1 << 18
NONE = np.int32(2**31 - 1)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [found[i] for i in range(len(found))]


class PairTable:
    """Open-addressed hash table from pairs of ids to the id of their merge."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens)}
        pairs = ((a, b, i) for i, t in enumerate(tokens) for k in range(1, len(t)) if (a := rank.get(t[:k])) is not None and (b := rank.get(t[k:])) is not None)
        a, b, merged = np.fromiter(chain.from_iterable(pairs), dtype=np.uint64).reshape(-1, 3).T
        self.bits = max(4, int(len(a) * 2).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.ids = np.full(1 << self.bits, NONE, dtype=np.int32)
        key, at = (a << np.uint64(32)) | b, self._slot(a, b)
        todo = np.arange(len(key))
        while len(todo):
            free = self.keys[at[todo]] == np.iinfo(np.uint64).max
            _, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[at[put]], self.ids[at[put]] = key[put], merged[put].astype(np.int32)
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (a * np.uint64(0x2545F4914F6CDD1D) ^ b) * _MULTIPLY
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair has none; negative ids are padding."""
        out = np.full(a.shape, NONE, dtype=np.int32)
        ask = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        x, y = a.ravel()[ask].astype(np.uint64), b.ravel()[ask].astype(np.uint64)
        key, at = (x << np.uint64(32)) | y, self._slot(x, y)
        flat, empty = out.reshape(-1), np.iinfo(np.uint64).max
        while len(ask):
            there = self.keys[at]
            hit = there == key
            flat[ask[hit]] = self.ids[at[hit]]
            on = ~hit & (there != empty)
            ask, key, at = ask[on], key[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.single = np.array([self.rank[bytes([i])] for i in range(256)], dtype=np.int32)
        self.pairs = PairTable(tokens)
        self.split = regex.compile(pattern).findall
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        sizes = np.array([len(p) for p in pieces])
        m = np.full((len(pieces), width + 1), -1, dtype=np.int32)
        m[np.arange(width + 1) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        p = np.full(m.shape, NONE, dtype=np.int32)
        p[:, :-1] = self.pairs(m[:, :-1], m[:, 1:])
        out, row = [None] * len(pieces), np.arange(len(pieces))
        while len(row):
            at = p.argmin(axis=1)  # the first of equal ranks: the leftmost
            best = p[np.arange(len(row)), at]
            over = best == NONE
            if over.any():  # compaction: finished rows leave, the width follows the longest row
                for i in np.flatnonzero(over):
                    out[row[i]] = m[i, : sizes[row[i]]].copy()
                row, at, best, m, p = row[~over], at[~over], best[~over], m[~over], p[~over]
                if not len(row):
                    break
                wide = sizes[row].max() + 1
                m, p = m[:, :wide], p[:, :wide]
            each, cols = np.arange(len(row)), np.arange(m.shape[1])
            source = np.minimum(cols + (cols > at[:, None]), m.shape[1] - 1)
            m, p = np.take_along_axis(m, source, 1), np.take_along_axis(p, source, 1)
            m[:, -1], p[:, -1] = -1, NONE
            m[each, at] = best
            p[each, at] = self.pairs(best, m[each, at + 1])
            left = at > 0
            p[each[left], at[left] - 1] = self.pairs(m[each[left], at[left] - 1], best[left])
            sizes[row] -= 1
        return out

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = [int(self.single[b]) for b in piece]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank, end = self.rank, len(ids)

        def pair(i: int) -> tuple | None:
            j = after[i]
            r = rank.get(parts[i] + parts[j]) if j < end else None
            return None if r is None else (r, i, parts[i], parts[j])

        heap = [x for i in range(end) if (x := pair(i))]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else end
            if j >= end or parts[i] != a or parts[j] != b:
                continue
            ids[i], parts[i], parts[j] = r, a + b, None
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (x := pair(k)):
                    heapq.heappush(heap, x)
        return np.array([x for x, p in zip(ids, parts, strict=True) if p is not None], dtype=np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """ids of each distinct pre-token."""
        out, buckets = {}, {}
        for p in pieces:
            if (whole := self.rank.get(p)) is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(p) > WIDEST:
                out[p] = self._heap(p).astype("<u4").tobytes()
            else:
                buckets.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(p)
        for width, held in buckets.items():
            step = max(1, CELLS // width)
            for i in range(0, len(held), step):
                some = held[i : i + step]
                out.update((p, ids.astype("<u4").tobytes()) for p, ids in zip(some, self._matrix(some, width), strict=True))
        return out

    def encode_units(self, units: list[bytes]) -> list[bytes]:
        cut = [[p.encode() for p in self.split(u.decode())] for u in units]
        known = self.encode_pieces(list(set().union(*cut)))
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of each sequence of ids (little-endian unsigned 32-bit, in a binary array)."""
        offsets, data = parts(ids)
        flat = data.view("<u4").astype(np.int64)
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        out = self.blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[flat] - (ends - sizes), sizes)]
        return binary(np.concatenate([[0], ends])[offsets // 4], out)


def _with_binary(df: DataFrame, source: str, name: str, make) -> DataFrame:
    """df with the binary column ``name``; make() gives, in the task, what maps a binary array of ``source`` to it."""
    df = df.drop(name)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches):
        convert = make()
        for batch in batches:
            values = pc.fill_null(batch.column(source).cast(pa.binary()), b"")
            for a, b in slices(values):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, convert(values.slice(a, b - a))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs with ``ids``: token ids as little-endian unsigned 32-bit integers."""
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # one vocabulary file: bounded
    return _with_binary(docs, "text", "ids", lambda: Remembering(Codec(tokens.value, pattern).encode_units))


def decode(coded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Rows that have ``ids``, with ``decoded``: the bytes that the ids stand for."""
    tokens = coded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    return _with_binary(coded, "ids", "decoded", lambda: Codec(tokens.value, pattern).decode)


def digests(coded: DataFrame, *more) -> DataFrame:
    return coded.select(
        "doc_id", *more, F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
