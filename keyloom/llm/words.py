"""Vectorised word and shingle handling over Arrow string arrays.

A word is a maximal run of characters other than space and ``\\t\\n\\v\\f\\r``.
Words are hashed to 64 bits with a table-driven polynomial over their UTF-8
bytes; shingles are hashed from their words' hashes.  All functions work on
whole texts and treat null as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Text bytes handled at a time, so that scratch arrays stay small; one longer text is handled alone.
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_POSITION = [int(x) | 1 for x in _rng.integers(1, 2**63, 64, dtype=np.uint64)]
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit values."""
    y = x >> U64(30)
    y ^= x
    y *= U64(0xBF58476D1CE4E5B9)
    y ^= y >> U64(27)
    y *= U64(0x94D049BB133111EB)
    y ^= y >> U64(31)
    return y


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if size <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string of a non-null Arrow string array."""
    values = values.cast(pa.large_string()) if pa.types.is_string(values.type) else values
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    if len(values) == 0 or data is None:
        return np.full(len(values), mix(np.zeros(1, np.uint64))[0])
    lo = at[0]
    raw = np.frombuffer(data, np.uint8)[lo : at[-1]]
    at = at - lo
    n = len(raw)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _power_table(_BASE, n), out=sums[1:])
        h = (sums[at[1:]] - sums[at[:-1]]) * _power_table(_INV, n + 1)[at[:-1]]
        return mix(h + (at[1:] - at[:-1]).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def filled(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of large strings, nulls as empty texts."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return pc.fill_null(texts.cast(pa.large_string()), "")


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Index ranges of at most CHUNK_BYTES of text, one text at least."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends, start, total = [], 0, 0
    for i, s in enumerate(size):
        if i > start and total + s > CHUNK_BYTES:
            ends.append((start, i))
            start, total = i, 0
        total += s
    if start < len(size):
        ends.append((start, len(size)))
    yield from ends


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and each text's offset into them."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    at = lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    keep = pc.greater(pc.binary_length(flat), 0)
    mask = keep.to_numpy(zero_copy_only=False)
    if not mask.all():
        before = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=before[1:])
        flat, at = flat.filter(keep), before[at]
    return flat, at


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of one text's shingles in order: every run of ``width`` words; the whole text if it has fewer; none without words."""
    n = len(words)
    if n == 0:
        return words
    with np.errstate(over="ignore"):
        if n < width:
            h = U64(n)
            for j in range(n):
                h = h + words[j] * U64(_POSITION[j % 64])
            return mix(np.array([h], np.uint64) ^ U64(0xA24BAED4963EE407))
        h = np.full(n - width + 1, width, np.uint64)
        for j in range(width):
            h += words[j : n - width + 1 + j] * U64(_POSITION[j % 64])
        return mix(h)


def set_chunks(texts: pa.Array, width: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts' shingle sets, A-Z lower-cased, chunk by chunk: sorted distinct hashes side by side, where each set starts and ends, and each text's number of words."""
    for a, b in chunks(texts):
        flat, at = split_words(pc.ascii_lower(texts.slice(a, b - a)))
        h, n = hash_strings(flat), np.diff(at)
        size = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        stop = np.concatenate(([0], np.cumsum(size)))
        out = np.zeros(stop[-1], np.uint64)
        long = np.flatnonzero(n >= width)
        if len(long):
            runs = shingles(h, width)  # over all texts in a row, those that cross an end too
            inside = np.ones(len(runs), bool)
            for j in range(1, width):
                ends = at[1:-1] - j
                inside[ends[(ends >= 0) & (ends < len(runs))]] = False
            place = np.ones(len(out), bool)
            place[stop[:-1][(n < width) & (n > 0)]] = False
            out[place] = runs[inside]
        for i in np.flatnonzero((n < width) & (n > 0)):
            out[stop[i]] = shingles(h[at[i] : at[i + 1]], width)[0]
        for i in long:
            out[stop[i] : stop[i + 1]].sort()
        if len(out):
            new = np.concatenate(([True], out[1:] != out[:-1]))
            new[stop[:-1][size > 0]] = True
            before = np.concatenate(([0], np.cumsum(new)))
            out, stop = out[new], before[stop]
        yield out, stop, n


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text, A-Z lower-cased, the sorted distinct hashes of its shingles."""
    for features, at, _ in set_chunks(texts, width):
        for i in range(len(at) - 1):
            yield features[at[i] : at[i + 1]]


def set_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of each set's values, 0 for an empty one."""
    out = np.zeros(len(at) - 1, values.dtype)
    some = np.flatnonzero(at[1:] > at[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, at[:-1][some])
    return out
