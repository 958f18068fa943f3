"""Canonical length-limited Huffman codes over token ids, in numpy.

Code lengths come from global counts by package-merge, limited to :data:`LIMIT` bits (more
only where the number of ids needs it).  A code table is its lengths: codes are given in
order of (length, id).  Decoding looks up as many bits as the longest code has.  Every
document starts on a byte and has a checkpoint, its bit offset, for each
:data:`CHECKPOINT` ids; all checkpoints of a block are decoded side by side.
"""

from __future__ import annotations

import numpy as np

LIMIT = 18
CHECKPOINT = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The optimal code length of each symbol with a count above 0, none over the limit; 0 for the others."""
    used = np.flatnonzero(counts > 0)
    n = len(used)
    out = np.zeros(len(counts), np.uint8)
    if n <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(n - 1).bit_length())
    weights = np.asarray(counts, np.float64)[used]
    order = np.argsort(weights, kind="stable")
    weights = weights[order]
    # Level by level: pairs of the level before are merged with the single symbols; only
    # how many of each list's cheapest entries are symbols matters for the lengths.
    merged, levels = weights, []
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        merged = both[rank]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for single in reversed(levels):
        symbols = int(single[:take].sum())
        lengths[:symbols] += 1
        take = 2 * (take - symbols)
    lengths[:take] += 1
    out[used[order]] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's code, by order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        longest = int(lengths.max())
        step = np.uint64(1) << (longest - lengths[order].astype(np.uint64))
        start = np.concatenate(([np.uint64(0)], np.cumsum(step)[:-1]))
        codes[order] = (start >> (longest - lengths[order].astype(np.uint64))).astype(np.uint32)
    return codes


class Coder:
    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.codes = canonical(self.lengths)
        self.longest = max(1, int(self.lengths.max(initial=1)))
        if self.longest > 24:
            raise ValueError("codes of over 24 bits aren't supported")
        self._table = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, length) for every value of the next ``longest`` bits."""
        if self._table is None:
            order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
            order = order[self.lengths[order] > 0]
            spans = np.int64(1) << (self.longest - self.lengths[order].astype(np.int64))
            symbol = np.zeros(1 << self.longest, np.uint32)
            length = np.ones(1 << self.longest, np.uint8)
            filled = np.repeat(order, spans)
            symbol[: len(filled)] = filled
            length[: len(filled)] = self.lengths[filled]
            self._table = symbol, length
        return self._table

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of documents one after the other.

        ids: those of all documents; sizes: ids of each.  Returns the bytes, each document's
        number of bytes, the bit offsets of all checkpoints within their documents, and each
        document's number of checkpoints.
        """
        length = self.lengths[ids].astype(np.int64)
        if len(ids) and not length.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = np.concatenate(([0], np.cumsum(length)))
        bits = total[ends] - total[starts]
        n_bytes = (bits + 7) // 8
        first_byte = np.cumsum(n_bytes) - n_bytes
        at = total[:-1] + np.repeat(first_byte * 8 - total[starts], sizes)
        # Codes that start in one 64-bit word are joined there; the last of them may reach into the next.
        room = 64 - (at & 63) - length
        codes, over = self.codes[ids].astype(np.uint64), np.flatnonzero(room < 0)
        value = codes << np.maximum(room, 0).astype(np.uint64)
        value[over] = codes[over] >> (-room[over]).astype(np.uint64)
        word = at >> 6
        out = np.zeros((int(n_bytes.sum()) >> 3) + 2, np.uint64)
        if len(ids):
            starts_of = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[word[starts_of]] = np.bitwise_or.reduceat(value, starts_of)
            out[word[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
        n_marks = -(-sizes // CHECKPOINT)
        marks = _ranges(starts, n_marks, CHECKPOINT)
        offsets = at[marks] - np.repeat(first_byte * 8, n_marks)
        return out.astype(">u8").view(np.uint8)[: int(n_bytes.sum())], n_bytes, offsets, n_marks

    def decode(self, data: np.ndarray, n_bytes: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The ids of documents that :meth:`encode` wrote."""
        symbol, length = self.table()
        n_marks = -(-sizes // CHECKPOINT)
        first_byte = np.cumsum(n_bytes) - n_bytes
        at = offsets + np.repeat(first_byte * 8, n_marks)
        starts = np.cumsum(sizes) - sizes
        to = _ranges(starts, n_marks, CHECKPOINT)
        todo = np.minimum(CHECKPOINT, np.repeat(starts + sizes, n_marks) - to)
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        words = (padded[:-3] << np.uint32(24)) | (padded[1:-2] << np.uint32(16)) | (padded[2:-1] << np.uint32(8)) | padded[3:]
        out = np.zeros(int(sizes.sum()), np.uint32)
        # Lanes by how much they have to do, so that those still at work stay in front.
        order = np.argsort(-todo, kind="stable")
        at, to, todo = at[order], to[order], todo[order]
        live = np.searchsorted(-todo, -np.arange(CHECKPOINT), side="left")
        shift, mask = np.uint32(32 - self.longest), np.uint32((1 << self.longest) - 1)
        for i in range(int(todo[0]) if len(todo) else 0):
            a = at[: live[i]]
            # 32 bits from the byte, less up to 7 bits passed: 25 are sure.
            peek = (words[a >> 3] << (a & 7).astype(np.uint32) >> shift) & mask
            out[to[: live[i]] + i] = symbol[peek]
            at[: live[i]] = a + length[peek]
        return out


def _ranges(starts: np.ndarray, counts: np.ndarray, step: int) -> np.ndarray:
    """starts[i] + step * (0 .. counts[i] - 1), for all i in a row."""
    total = int(counts.sum())
    within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(starts, counts) + within * step
