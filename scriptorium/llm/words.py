"""Vectorised word hashing for Arrow batches.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; UTF-8 never uses those bytes inside a longer
character, so byte scans and code-point scans find the same words. A word's 64-bit hash is a polynomial over a
random byte table, finished by a mixer; equal words always hash alike, unequal ones collide with odds near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_RNG = np.random.default_rng(20240611)
BYTE_HASHES = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_Q = np.uint64(0xD6E8FEB86659FD93)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES)
        for k, base in ((0, _P), (1, _PINV)):
            full = np.full(size, np.uint64(base))
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0], _powers[1]


_PLAIN = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _PLAIN[_a:_b] = np.arange(_a, _b)
_PLAIN[65:91] += 32


def plain_bytes(raw: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, other ASCII but digits as spaces; bytes beyond ASCII stay."""
    return _PLAIN[raw]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64(salt * 0x632BE59BD9B4E019 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Some consecutive rows of a batch. ``first``: the first row; ``data``: their bytes; ``offsets``: row limits in data."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a string column (null: empty) into runs of rows of about ``limit`` bytes; a longer text stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield Chunk(a, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


@dataclass
class Words:
    """Words of a chunk: ``hashes``, byte ``starts`` and ``ends``, and ``bounds``: the rows' limits in words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def words(c: Chunk, lower: bool = True) -> Words:
    data = c.data
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(z.astype(np.uint64), z, z, np.zeros(c.rows + 1, np.int64))
    gap = SPACE[data]
    head, tail = ~gap, ~gap
    head[1:] &= gap[:-1]
    tail[:-1] &= gap[1:]
    inner = c.offsets[(c.offsets > 0) & (c.offsets < len(data))]  # rows may touch without white space
    head[inner] = ~gap[inner]
    tail[inner - 1] = ~gap[inner - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASHES[_LOWER[data] if lower else data] * up[: len(data)], out=sums[1:])
    return Words(mix((sums[ends] - sums[starts]) * down[starts]), starts, ends, np.searchsorted(starts, c.offsets))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = out * _Q + hashes[k : k + n]
    return mix(out, size)


def shingle_set(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """The sorted distinct ``size``-word shingles of one text; a shorter text's whole word sequence is its only one."""
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(size, len(hashes))))


def one_hash(token: bytes) -> int:
    return int(words(Chunk(0, np.frombuffer(token, np.uint8), np.array([0, len(token)])), lower=False).hashes[0])
