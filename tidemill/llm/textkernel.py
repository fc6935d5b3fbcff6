"""Words and their hashes for whole Arrow batches, without a Python object a word.

A piece is a run of documents as one buffer of UTF-8 bytes, each document
followed by a line feed. Words are found and hashed by array operations on the
buffer. The word classes used here are sets of bytes: every byte from 0x80 on
belongs to a character that isn't ASCII, so classes that treat all those
characters alike may be decided byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text a piece takes, unless a single document is longer.
PIECE_BYTES = 1 << 21

#: Rows a piece takes at most, so that two bytes tell its documents apart.
PIECE_ROWS = 1 << 16

_ODD = (0x9E3779B97F4A7C15 | 3) & ~0  # odd, and P - 1 is divisible by two only once


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number modulo 2**64, and of its inverse, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.forget()

    def forget(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _grown(held: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(held) < n:
            held = np.concatenate([held, held * np.uint64(pow(base, len(held), 1 << 64))])
        return held

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.up, self.down = self._grown(self.up, self.base, n), self._grown(self.down, self.inverse, n)
        return self.up[:n], self.down[:n]


BYTES, WORDS, AGAIN = _Powers(_ODD), _Powers(0xD1342543DE82EF95), _Powers(0xAF251AF3B0F025B5)


@cache
def table(kind: str) -> np.ndarray:
    """A random number for each byte, 0 for bytes between words.

    ``space``: words have no ASCII white space. ``fold``: the same, A-Z being
    lower-cased. ``alnum``: words have ASCII digits, letters, which are
    lower-cased, and bytes from 0x80 on.
    """
    t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    if kind in ("fold", "alnum"):
        t[65:91] = t[97:123]
    b = np.arange(256)
    if kind == "alnum":
        word = (b >= 48) & (b <= 57) | (b >= 65) & (b <= 90) | (b >= 97) & (b <= 122) | (b >= 128)
    else:
        word = ~((b == 32) | (b >= 9) & (b <= 13))
    t[~word] = 0
    return t


@dataclass
class Piece:
    """``buf`` has document i from ``begin[i]`` to ``begin[i + 1] - 1``, where its line feed is."""

    buf: np.ndarray
    begin: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.begin) - 1


@dataclass
class Words:
    """Starts of words in the buffer, their hashes, and by document the index of the first."""

    start: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def piece_of(texts: pa.Array) -> Piece:
    """A null text counts as empty."""
    joined = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    offsets = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
    data = joined.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Piece(buf[offsets[0] : offsets[-1]], offsets - offsets[0])


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, Piece]]:
    """Rows of at most about ``most`` bytes of text at a time, with their piece."""
    try:
        yield from _pieces(batches, text, most)
    finally:
        release()


def release() -> None:
    """Workers are used again by other tasks, or wait; what this one's allocator holds goes back."""
    for powers in (BYTES, WORDS, AGAIN):
        powers.forget()
    pa.default_memory_pool().release_unused()


def _pieces(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[tuple[pa.RecordBatch, Piece]]:
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at, base = 0, 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(lengths, base + max(0, most - size), side="right"))
            upto = min(max(upto, at + (not held)), at + PIECE_ROWS - rows)
            if upto > at:
                held.append(batch.slice(at, upto - at))
                size += int(lengths[upto - 1]) - base
                rows += upto - at
                at, base = upto, int(lengths[upto - 1])
            if at < batch.num_rows or size >= most:
                yield _together(held, text)
                held, size, rows = [], 0, 0
    if held:
        yield _together(held, text)


def _together(held: list[pa.RecordBatch], text: str) -> tuple[pa.RecordBatch, Piece]:
    rows = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return rows, piece_of(rows.column(text))


def words(piece: Piece, kind: str) -> Words:
    x = table(kind)[piece.buf]
    inside = x != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    start = np.flatnonzero(begins)
    if not len(start):
        return Words(start, np.zeros(0, np.uint64), np.zeros(piece.docs + 1, np.int64))
    up, down = BYTES.to(len(x))
    x *= up
    return Words(start, mix(np.add.reduceat(x, start) * down[start]), np.searchsorted(start, piece.begin))


def word_ends(piece: Piece, kind: str) -> np.ndarray:
    """Where each word ends; a byte between words follows every word."""
    inside = table(kind)[piece.buf] != 0
    ends = ~inside
    ends[1:] &= inside[:-1]
    if len(ends):
        ends[0] = False
    return np.flatnonzero(ends)


def spans(hashes: np.ndarray, width: int, powers: _Powers = WORDS) -> np.ndarray:
    """A hash of each run of ``width`` hashes, by its start; empty if there are fewer."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers.to(n)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=c[1:])
    return mix((c[width:] - c[:-width]) * down[: n - width + 1])


def starts_of(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of ``width`` words inside a document, and the number by document."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(first[:-1], counts), counts
