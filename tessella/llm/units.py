"""Cutting a text where byte-level BPE pre-tokenisation always cuts.

The pre-token patterns start a new pre-token at a space or line feed that
follows a character other than a blank, and at an ASCII mark that follows an
ASCII letter, whatever stands around them.  Texts are cut there, in whole Arrow
arrays at a time, so that what repeats (most units do) is encoded once and
remembered.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Units whose ids a task remembers at most; then it forgets them all.
REMEMBERED = 400_000
#: Longest unit that is remembered, in bytes: longer ones rarely come again.
KEPT_BYTES = 64
#: Bytes that are encoded at a time.
SLICE = 1 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII marks, without the apostrophe: some patterns let 's and the like go with the word before.
_MARK = np.zeros(256, dtype=bool)
_MARK[[c for c in string.punctuation.encode() if c != 0x27]] = True
#: Bytes that may end a character after which a space or line feed begins a pre-token: no blanks, no control characters.
_BEFORE = np.zeros(256, dtype=bool)
_BEFORE[0x21:0x7F] = True
_BEFORE[0x80:0xC0] = True
#: The last two bytes of the longer Unicode blanks are among these (as are some others: not to cut is always right).
_BLANK_END, _BLANK_LEAD = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BLANK_END[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_BLANK_LEAD[[0x80, 0x81, 0x9A, 0xC2]] = True


def parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a binary array without nulls."""
    if not len(array):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None or at[0] == at[-1]:
        return at - at[0], np.zeros(0, dtype=np.uint8)
    return at - at[0], np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]


def binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """The binary array of these offsets (in bytes) into data."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes; a longer text is a range of its own."""
    offsets, begin = parts(texts)[0], 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE, side="right")) - 1)
        yield begin, end
        begin = end


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pieces of the texts in order, and how many come before each text and in all; the encodings of a text's pieces joined are its own."""
    offsets, data = parts(texts)
    cut = np.zeros(len(data) + 1, dtype=bool)
    at = 1 + np.flatnonzero((data[1:] == 32) | (data[1:] == 10))
    last = data[at - 1]
    cut[at[_BEFORE[last] & ~(_BLANK_END[last] & _BLANK_LEAD[data[at - 2]])]] = True  # at 1 the byte looked up is no lead of the one before
    at = 1 + np.flatnonzero(_MARK[data[1:]])
    cut[at[_LETTER[data[at - 1]]]] = True
    cut[offsets] = True
    cut[-1] = False
    starts = np.flatnonzero(cut)
    return binary(np.append(starts, len(data)), data), np.searchsorted(starts, offsets)


class Remembering:
    """Encodes texts (a binary array) to ids (another, of little-endian unsigned 32-bit) with a bounded memory of units."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]]):
        self._encode = encode
        self._forget()

    def _forget(self) -> None:
        self._numbers: dict[bytes, int] = {}
        self._ids, self._starts, self._n = np.zeros(1 << 16, dtype="<u4"), np.zeros(1 << 14, dtype=np.int64), 0

    def _add(self, new: list[bytes]) -> None:
        """Appends the ids of units; unit i has ids from starts[i] to starts[i + 1]."""
        coded = self._encode(new)
        ends = self._starts[self._n] + np.cumsum(np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))) // 4
        while self._n + len(new) + 1 > len(self._starts):
            self._starts = np.concatenate([self._starts, np.zeros_like(self._starts)])
        while ends[-1] > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._starts[self._n] : ends[-1]] = np.frombuffer(b"".join(coded), dtype="<u4")
        self._starts[self._n + 1 : self._n + len(new) + 1] = ends
        self._n += len(new)

    def __call__(self, texts: pa.Array) -> pa.Array:
        pieces, before = units(texts)
        if not len(pieces):
            return binary(np.zeros(len(texts) + 1), np.zeros(0, dtype=np.uint8))
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self._n + len(distinct) > REMEMBERED:
            self._forget()
        number = np.fromiter(map(self._numbers.get, distinct, [-1] * len(distinct)), dtype=np.int64, count=len(distinct))
        new, kept = np.flatnonzero(number < 0), self._n
        if len(new):
            stays = np.diff(parts(coded.dictionary)[0])[new] <= KEPT_BYTES
            new = np.concatenate([new[stays], new[~stays]])  # those to forget come last
            some = [distinct[i] for i in new.tolist()]
            number[new] = np.arange(kept, kept + len(new))
            self._add(some)
            self._numbers.update(zip(some[: int(stays.sum())], range(kept, kept + len(new))))
            kept += int(stays.sum())
        each = number[np.asarray(coded.indices)]
        starts, sizes = self._starts[each], self._starts[each + 1] - self._starts[each]
        ends = np.cumsum(sizes)
        ids = self._ids[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)]
        self._n = kept
        return binary(np.concatenate([[0], ends])[before] * 4, ids.view(np.uint8))
