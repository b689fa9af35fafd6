"""Words of many texts at once, as numpy arrays over the concatenated UTF-8 bytes of some documents.

Documents are taken in chunks of about CHUNK bytes (a longer one makes a chunk of its own), so memory is about 60
bytes for each byte of the longest document or CHUNK.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tessera.llm.shared import BLANKS

CHUNK = 1 << 19
BLANK = np.zeros(256, bool)
BLANK[list(BLANKS)] = True
#: An odd multiplier of polynomial hashes modulo 2**64, and random values of the bytes.
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of rows with about ``most`` bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse powers modulo 2**64, for i < n."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, b in ((up, BASE), (down, inverse)):
        out[0] = 1
        done = 1
        while done < n:
            m = min(done, n - done)
            np.multiply(out[:m], np.uint64(pow(int(b), done, 1 << 64)), out=out[done : done + m])
            done += m
    return up, down


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose low and high bits are equally random."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Chunk:
    """The bytes of some documents with their words: starts, ends, document index and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets - offsets[0]
        self.n_docs = len(offsets) - 1
        n = len(data)
        solid = ~BLANK[data]
        self.solid = solid
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
            inner = self.offsets[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            before[inner] = False
            after[inner - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        first = np.searchsorted(self.starts, self.offsets)
        #: words of document i are word_at[i] to word_at[i + 1]
        self.word_at = first
        self.n_words = np.diff(first)
        size = 1 << max(10, int(n).bit_length())
        self.up, self.down = powers(size)
        self._sums: np.ndarray | None = None

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            out = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(BYTE_VALUES[self.data] * self.up[: len(self.data)], out=out[1:])
            self._sums = out
        return self._sums

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def word_hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def word_docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array for each document."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of every run of ``n`` neighbours; the last n - 1 places have none."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= BASE
        out += hashes[j : j + m]
    return mixed(out)


def runs_inside(word_at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the runs lie in one document: a flag for each of the total - n + 1 places."""
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    ok = np.ones(m, bool)
    for j in range(1, n):  # a run that starts j words before a document's end crosses it
        at = word_at[1:-1] - j
        ok[at[(at >= 0) & (at < m)]] = False
    return ok


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    flag = np.zeros(len(keys), bool)
    flag[order[1:]] |= same
    flag[order[:-1]] |= same
    return flag
