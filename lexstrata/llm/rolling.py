"""Vectorised tokens and window hashes over Arrow string buffers.

A ``Block`` holds the UTF-8 bytes of a bounded run of whole texts. All hashes
are polynomial sums modulo 2**64 over random 64-bit symbol codes, finished with
a bijective mixer; two independent bases give 128 bits where equality decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASES = (0x9E3779B97F4A7C13, 0xD1342543DE82EF93)
TOP = U(0xFFFFFFFFFFFFFFFF)
_rng = np.random.Generator(np.random.PCG64(20240817))
BYTE_CODES = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n, modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[which] = (out[0], out[1])
    return have


def prefix_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * powers(len(values) + 1, which)[0][: len(values)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each run [start, end), mixed with its length."""
    inverse = powers(len(sums), which)[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def window_hash(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each run of k values, by start."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    sums = prefix_sums(values, which)
    return mix((sums[k:] - sums[:n]) * powers(len(sums), which)[1][:n] + U(k))


def sliding(op: np.ufunc, a: np.ndarray, w: int) -> np.ndarray:
    """op over each w neighbours, by start; by doubling."""
    if len(a) < w:
        return a[:0]
    out, have = a, 1
    while have * 2 <= w:
        out = op(out[:-have], out[have:])
        have *= 2
    return out if have == w else op(out[: len(a) - w + 1], out[w - have : w - have + len(a) - w + 1])


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions that are least in some w neighbours (all, where fewer)."""
    if len(hashes) <= w:
        return np.flatnonzero(hashes == hashes.min()) if len(hashes) else np.empty(0, dtype=np.int64)
    least = sliding(np.minimum, hashes, w)
    padded = np.concatenate([np.zeros(w - 1, dtype=np.uint64), least, np.zeros(w - 1, dtype=np.uint64)])
    return np.flatnonzero(sliding(np.maximum, padded, w) == hashes)


@dataclass
class Block:
    """rows: the batch's row of each text; starts: byte offsets, one more than texts."""

    rows: np.ndarray
    data: np.ndarray
    starts: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i + 1]].tobytes()

    def words(self, fold: bool = False, hashes: tuple[int, ...] = (0,)) -> "Words":
        data = FOLD[self.data] if fold else self.data
        is_word = ~SPACE[data]
        before = np.empty_like(is_word)
        before[:1] = False
        before[1:] = is_word[:-1]
        after = np.empty_like(is_word)
        after[-1:] = False
        after[:-1] = is_word[1:]
        edges = self.starts[(self.starts > 0) & (self.starts < len(data))]
        before[edges] = False
        after[edges - 1] = False
        start = np.flatnonzero(is_word & ~before)
        end = np.flatnonzero(is_word & ~after) + 1
        codes = [span_hash(prefix_sums(BYTE_CODES[h][data], h), start, end, h) for h in hashes]
        return Words(start, end, np.searchsorted(start, self.starts), codes)


@dataclass
class Words:
    """first: index of each text's first word, one more than texts."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    codes: list[np.ndarray]

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def blocks(column: pa.Array, limit: int = 2 << 20) -> Iterator[Block]:
    """Runs of whole texts of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Block(np.arange(i, j), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
