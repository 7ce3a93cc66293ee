"""Words, word hashes and window hashes of whole Arrow batches of texts, in numpy.

A text column is one byte buffer; words, hashes of words and hashes of every window of
``k`` words are computed for all texts of a slice at once. Hashes have 64 bits: two
different words (or windows) of one comparison agree with probability 2^-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Texts are handled in slices of about so many bytes, which bounds the memory of a worker; one text is never cut.
SLICE_BYTES = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 64

_P, _Q = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Bytes of words of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z).
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: The low bytes of an eight that belong to a word of which so many bytes are left.
_LEFT = np.array([2 ** (8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end], taken eight bytes at a time; nothing is kept but a number for each."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    size = end - start
    with np.errstate(over="ignore"):
        h = size.astype(U) * _Q
        live, at = np.flatnonzero(size <= LONG_WORD), 0
        while len(live):
            eight = eights[start[live] + at] & _LEFT[np.minimum(size[live] - at, 8)]
            h[live] = mix(h[live] + eight) * _P
            at += 8
            live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = U(int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little"))
    return h


def equal(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether each data[start:end] has the same bytes as that of the number ``other``."""
    size, like = end - start, start[other]
    if not np.array_equal(size, size[other]):
        return False
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    live, at = np.flatnonzero((start != like) & (size <= LONG_WORD)), 0
    while len(live):
        if ((eights[start[live] + at] ^ eights[like[live] + at]) & _LEFT[np.minimum(size[live] - at, 8)]).any():
            return False
        at += 8
        live = live[size[live] > at]
    return all(np.array_equal(data[start[i] : end[i]], data[like[i] : like[i] + size[i]]) for i in np.flatnonzero((start != like) & (size > LONG_WORD)))


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[starts:ends] (word hashes), each independent of where it stands."""
    n = len(values) + 1
    with np.errstate(over="ignore"):
        up, down = np.full(n, _Q, U), np.full(n, U(pow(int(_Q), -1, 2**64)), U)
        up[0] = down[0] = U(1)
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        total = np.zeros(n, U)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * _Q)


class Words:
    """The words of some texts. ``start`` and ``end``: bytes in ``data``; ``first[i]:first[i + 1]``: the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True):
        flags = kind[data]
        begin, stop = flags.copy(), flags.copy()
        if len(data):
            begin[1:] &= ~flags[:-1]
            stop[:-1] &= ~flags[1:]
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            begin[inner] = flags[inner]
            stop[inner - 1] = flags[inner - 1]
        self.data, self.offsets = data, offsets
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.hash = hashes(_LOWER[data] if lower else data, self.start, self.end)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window of k words within a text: its hash, its first word, its text."""
        per = np.maximum(self.count - k + 1, 0)
        text = np.repeat(np.arange(len(per)), per)
        at = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per) + self.first[:-1][text]
        return ranges(self.hash, at, at + k), at, text

    def whole(self) -> np.ndarray:
        """A hash of each text's whole sequence of words."""
        return ranges(self.hash, self.first[:-1], self.first[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return ranges(self.hash, starts, ends)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def binary_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def sliced(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def words_of(batch: pa.RecordBatch, kind: np.ndarray, column: str = "text", lower: bool = True) -> Words:
    return Words(*text_buffer(batch.column(column)), kind, lower)
