"""Per-document measures over whole Arrow batches: style, byte entropy, hashed embeddings.

Strings are bytes: classes are ASCII, letters fold A-Z only. Texts are read in runs of a few
hundred kilobytes as one byte array, so no step loops over words or documents in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A run's arrays, some 100 bytes for each of its bytes, should stay near the processor.
RUN_BYTES = 1 << 18
_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[97:123] = True
_WORD = _ALNUM.copy()
_WORD[ord("'")] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True
# The marks that count as punctuation.
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[ord(c) for c in ".,;:!?\"'()-"]] = True
_CODES = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C13, pow(0x9E3779B97F4A7C13, -1, 1 << 64)
_INVERSE_31 = pow(31, -1, 1 << 32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int, kind: type) -> np.ndarray:
    p = np.full(n + 1, base, dtype=kind)
    p[0] = 1
    return np.multiply.accumulate(p, dtype=kind)


def runs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, bounds) of runs of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, side="right")) - 1))
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(data: np.ndarray, bounds: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each maximal run of bytes of class ``of`` within one text."""
    inside = of[data]
    change = np.diff(inside.astype(np.int8), prepend=0, append=0)
    opens, closes = change[:-1] == 1, change[1:] == -1
    cut = bounds[(bounds > 0) & (bounds < len(data))]
    both = cut[inside[cut] & inside[cut - 1]]
    opens[both] = True
    closes[both - 1] = True
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(bounds, start, side="right") - 1


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODES[data] * _powers(_BASE, len(data), np.uint64)[: len(data)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * _powers(_BASE_INVERSE, len(data), np.uint64)[start] + (end - start).astype(np.uint64))


def _distinct(key: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Number of different keys of each text."""
    # One plain sort: the text's number above, below it as many bits of the key's hash as are left.
    bits = _U(max(1, (texts - 1).bit_length()))
    held = np.sort((text.astype(np.uint64) << (_U(64) - bits)) | (_mix(key) >> bits))
    new = np.ones(len(held), dtype=bool)
    new[1:] = held[1:] != held[:-1]
    return np.bincount((held[new] >> (_U(64) - bits)).astype(np.int64), minlength=texts)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(b)), where=b > 0)


#: What is measured of a text's style, in order; the first is a whole number.
STYLE = ("word_count", "type_token_ratio", "avg_sentence_length", "sentence_length_std", "burstiness", "punctuation_ratio", "repetition_score", "char_entropy")


def _style(raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    texts = len(bounds) - 1
    data = _FOLD[raw]
    start, end, text = spans(data, bounds, _WORD)
    n = np.bincount(text, minlength=texts)
    hashed = _hashes(data, start, end)
    different = _distinct(hashed, text, texts)
    # A sentence ends at a stop before white space; ends in no text's last place change nothing.
    stops = np.zeros(len(data) + 1, dtype=np.int64)
    if len(data):
        ends = _STOP[data[:-1]] & _SPACE[data[1:]]
        ends[bounds[(bounds > 0) & (bounds < len(data))] - 1] = False
        np.cumsum(ends, out=stops[1 : len(data)])
        stops[len(data)] = stops[len(data) - 1]
    sentence = stops[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (sentence[1:] != sentence[:-1])
    first = np.flatnonzero(new)
    length, of = np.diff(first, append=len(start)).astype(float), text[first]
    count = np.bincount(of, minlength=texts)
    mean = _ratio(np.bincount(of, weights=length, minlength=texts), count)
    square = np.bincount(of, weights=(length - mean[of]) ** 2, minlength=texts)
    sd = np.sqrt(_ratio(square, np.where(count > 1, count - 1, 0)))
    size = np.diff(bounds)
    owner = np.repeat(np.arange(texts), size)
    marks = np.bincount(owner[_MARKS[raw]], minlength=texts)
    grams = np.maximum(n - 2, 0)
    at = np.flatnonzero(text[:-2] == text[2:]) if len(text) > 2 else np.empty(0, dtype=np.int64)
    key = (hashed[at] * _U(3) + hashed[at + 1] if len(at) else hashed[:0]) * _U(0x9E3779B97F4A7C15) + (hashed[at + 2] if len(at) else hashed[:0])
    repeated = np.where(n < 6, 0.0, _ratio(grams - _distinct(key, text[at], texts), grams))
    seen = np.bincount(owner * 256 + raw, minlength=256 * texts).reshape(texts, 256)
    share = np.divide(seen, size[:, None], out=np.zeros(seen.shape), where=seen > 0)
    entropy = -(share * np.log2(share, out=np.zeros(share.shape), where=share > 0)).sum(axis=1) + 0.0
    return [n.astype(np.int32), _ratio(different, n), mean, sd, _ratio(sd, mean), _ratio(marks, size), repeated, entropy]


def style(column: pa.Array) -> pa.StructArray:
    """The measures of ``STYLE`` for each text."""
    parts = [_style(*run) for run in runs(column)] or [[np.empty(0)] * 8]
    return pa.StructArray.from_arrays([pa.array(np.concatenate(c), pa.int32() if k == 0 else pa.float64()) for k, c in enumerate(zip(*parts))], names=list(STYLE))


def _embed(raw: np.ndarray, bounds: np.ndarray, dim: int) -> np.ndarray:
    texts = len(bounds) - 1
    data = _FOLD[raw]
    start, end, text = spans(data, bounds, _ALNUM)
    long = end - start >= 2
    start, end, text = start[long], end[long], text[long]
    # h = sum of byte * 31 ** (places after it), in 32 bits.
    sums = np.zeros(len(data) + 1, dtype=np.uint32)
    np.cumsum(data.astype(np.uint32) * _powers(_INVERSE_31, len(data), np.uint32)[: len(data)], out=sums[1:], dtype=np.uint32)
    h = (sums[end] - sums[start]) * _powers(31, len(data), np.uint32)[np.maximum(end - 1, 0)]
    slot = lambda x: np.abs(x.view(np.int32).astype(np.int64)) % dim
    second = (h * np.uint32(31) + np.uint32(ord("#"))) * np.uint32(31) + np.uint32(ord("2"))
    size = texts * dim
    out = np.bincount(text * dim + slot(h), minlength=size) + 0.5 * np.bincount(text * dim + slot(second), minlength=size)
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    every = np.flatnonzero((np.arange(len(raw)) - bounds[owner]) % 7 == 0)
    out += 0.05 * np.bincount(owner[every] * dim + raw[every].view(np.int8).astype(np.int64) % dim, minlength=size)
    out = out.reshape(texts, dim)
    out[np.bincount(owner[~_SPACE[raw]], minlength=texts) == 0] = 0
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros(out.shape), where=norm > 0)


def embed(column: pa.Array, dim: int) -> pa.Array:
    """Unit vectors of hashed tokens and of every 7th byte; zeros for blank texts."""
    parts = [_embed(*run, dim) for run in runs(column)] or [np.empty((0, dim))]
    flat = np.concatenate(parts)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, dim, dtype=np.int32)), pa.array(flat.reshape(-1)))
