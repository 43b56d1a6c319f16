"""Word and window fingerprints of Arrow text columns, a whole batch at a time.

A word is a run of bytes other than space and the controls tab to carriage return.
Fingerprints are 64-bit; they do not depend on the process or the machine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Letters and digits of ASCII and every byte beyond it.
IS_TERM = np.zeros(256, dtype=bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits of the output."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(_BASE))
_LOWER = _BYTE.copy()
_LOWER[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the base and of its inverse, grown to the longest slice seen."""

    up = _powers(_BASE, 0)
    down = _powers(_BASE, 0)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, SLICE + 1)
            cls.up, cls.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        return cls.up, cls.down


@dataclass
class Words:
    """All words of a batch: fingerprints in order, and where each document starts."""

    hashes: np.ndarray
    first: np.ndarray  # documents + 1 entries

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def docs(self) -> np.ndarray:
        """Document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def places(self) -> np.ndarray:
        """Position of each word in its document."""
        return np.arange(len(self.hashes)) - np.repeat(self.first[:-1], self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint of the k words from each word on, and whether the document
        has that many."""
        n = len(self.hashes)
        total = np.zeros(n, dtype=np.uint64)
        power = 1
        for j in range(min(k, n)):
            total[: n - j] += self.hashes[j:] * U64(power)
            power = power * _STEP % (1 << 64)
        left = np.repeat(self.first[1:], self.counts) - np.arange(n)
        return mix(total), left >= k


def _slice_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Fingerprints of the words [begin, end) of one slice of bytes."""
    up, down = _Tables.get(len(data) + 1)
    run = np.empty(len(data) + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum(table[data] * up[: len(data)], out=run[1:])
    return mix((run[end] - run[begin]) * down[begin])


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array and the offsets of its values; null is empty."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64) \
        if offsets else np.zeros(len(texts) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def words_of(texts: pa.Array, lower: bool = False, letters: np.ndarray = IS_WORD) -> Words:
    """Words of every text of an array; ``lower`` reads A-Z as a-z, ``letters`` says
    which bytes belong to a word.

    Bytes go through in slices of about a megabyte that end between words, so a very
    long text needs no more scratch memory than a short one.
    """
    data, offsets = text_buffers(texts)
    table = _LOWER if lower else _BYTE
    n = len(data)
    inside = letters[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < n]
    begins[starts] = inside[starts]
    begin = np.flatnonzero(begins)
    ends = np.zeros(n, dtype=bool)
    ends[:-1] = inside[:-1] & ~inside[1:]
    if n:
        ends[-1] = inside[-1]
    last = offsets[1:][(offsets[1:] > 0)] - 1
    ends[last] = inside[last]
    end = np.flatnonzero(ends) + 1
    hashes = np.empty(len(begin), dtype=np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + SLICE, side="right")))
        a = begin[i]
        hashes[i:j] = _slice_hashes(data[a: end[j - 1]], begin[i:j] - a, end[i:j] - a, table)
        i = j
    return Words(hashes, np.searchsorted(begin, offsets))
