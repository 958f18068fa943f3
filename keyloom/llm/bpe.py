"""Byte-level BPE with a hierarchical-bitmap rank queue.

Encoding a pre-token: its bytes form a linked list; every adjacent pair whose joined bytes
have a rank puts its position into that rank's bucket.  A bitmap over ranks in three
levels of 64-bit words, each bit telling whether the word below has any bit, gives the
lowest rank by three find-first-set steps.  Of a bucket the leftmost position is taken.
Entries are never removed when a neighbour's merge changes a pair: a popped position whose
pair no longer has that rank is stale and skipped.  Each merge adds at most two entries, so
a pre-token of n bytes takes O(n log n) steps, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import PieceEncoder, gather
from .words import chunks, filled

#: Distinct words that a Python worker remembers, twice at most.
REMEMBERED = 1_000_000
#: Pre-tokens of at most so many bytes are encoded together when there are so many.
SHORT, MANY = 48, 20_000
_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class RankBits:
    """A set of ranks: a bitmap in three levels."""

    def __init__(self, ranks: int):
        words = (ranks >> 6) + 1
        self.low = [0] * words
        self.mid = [0] * ((words >> 6) + 1)
        self.top = 0

    def add(self, rank: int) -> None:
        word = rank >> 6
        if not self.low[word]:
            group = word >> 6
            if not self.mid[group]:
                self.top |= 1 << group
            self.mid[group] |= 1 << (word & 63)
        self.low[word] |= 1 << (rank & 63)

    def lowest(self) -> int:
        """The set must not be empty."""
        group = (self.top & -self.top).bit_length() - 1
        bits = self.mid[group]
        word = (group << 6) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return (word << 6) + (bits & -bits).bit_length() - 1

    def remove(self, rank: int) -> None:
        word = rank >> 6
        self.low[word] ^= 1 << (rank & 63)
        if not self.low[word]:
            group = word >> 6
            self.mid[group] ^= 1 << (word & 63)
            if not self.mid[group]:
                self.top ^= 1 << group


class RankQueue(RankBits):
    """Ranks with positions in buckets; pops the lowest rank's leftmost position."""

    def __init__(self, ranks: int):
        super().__init__(ranks)
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.add(rank)

    def pop(self) -> tuple[int, int]:
        """(rank, position); the queue must not be empty."""
        rank = self.lowest()
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.remove(rank)
        return rank, position


class ArrayQueue(RankBits):
    """Ranks with arrays of positions in buckets; pops all of the lowest rank."""

    def __init__(self, ranks: int):
        super().__init__(ranks)
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.kind = np.uint16 if ranks <= 1 << 16 else np.int32  # of which the shorter one sorts faster

    def put(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [positions]
            self.add(rank)
        else:
            bucket.append(positions)

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Each position into the bucket of its rank; those with rank -1 nowhere."""
        has = np.flatnonzero(ranks >= 0)
        if len(has) <= 1:
            if len(has):
                self.put(int(ranks[has[0]]), positions[has])
            return
        ranks, positions = ranks[has].astype(self.kind), positions[has]
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        starts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()]
        for rank, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
            self.put(rank, positions[a:b])

    def pop(self) -> tuple[int, list[np.ndarray]]:
        """The lowest rank and its positions, in arrays; the queue must not be empty."""
        rank = self.lowest()
        self.remove(rank)
        return rank, self.buckets.pop(rank)


class Partners:
    """For each token the others that it joins with on one side, in order, and the ranks of both joined."""

    def __init__(self, tokens: list[int], partners: list[int], ranks: list[int], size: int):
        tokens, partners, ranks = (np.array(x, np.int32) for x in (tokens, partners, ranks))
        order = np.lexsort((partners, tokens))
        self.partner, self.rank = partners[order], ranks[order]
        self.start = np.searchsorted(tokens[order], np.arange(size + 1)).tolist()

    def ranks(self, token: int, others: np.ndarray) -> np.ndarray | None:
        """The rank of ``token`` joined with each of the others, -1 where they don't join; None if none does."""
        a, b = self.start[token], self.start[token + 1]
        if a == b:
            return None
        row = self.partner[a:b]
        at = row.searchsorted(others)
        at[at == b - a] = 0
        joins = row[at] == others
        return np.where(joins, self.rank[a:b][at], -1) if joins.any() else None


class BytePairs:
    """Encoder and decoder for a table of ranks that holds every single byte."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} of the 256 bytes")
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.byte_rank = [ranks[bytes([b])] for b in range(256)]
        top = max(ranks.values()) + 1
        self.queue, self.together = RankQueue(top), ArrayQueue(top)
        self.joined: dict[int, int] = {}
        self.id_bytes = {r: array("I", [r]).tobytes() for r in ranks.values()}
        made = [(a, b, r) for piece, r in ranks.items() for cut in range(1, len(piece)) if (a := ranks.get(piece[:cut])) is not None and (b := ranks.get(piece[cut:])) is not None]
        first, second, rank = (list(x) for x in zip(*made, strict=True)) if made else ([], [], [])
        self.follows, self.leads = Partners(first, second, rank, top), Partners(second, first, rank, top)
        self.byte_ranks = np.array(self.byte_rank, np.int32)
        self.byte_pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)

    def pair(self, a: int, b: int) -> int:
        """The rank of two tokens' joined bytes, -1 without one."""
        key = a << 32 | b
        rank = self.joined.get(key)
        if rank is None:
            rank = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
            if len(self.joined) < 1 << 20:
                self.joined[key] = rank
        return rank

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        token = [self.byte_rank[b] for b in piece]
        n = len(token)
        pair, queue = self.pair, self.queue
        rank_at = [pair(token[i], token[i + 1]) for i in range(n - 1)]
        rank_at.append(-1)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        waiting = 0
        for i, rank in enumerate(rank_at):
            if rank >= 0:
                queue.push(rank, i)
                waiting += 1
        while waiting:
            rank, i = queue.pop()
            waiting -= 1
            if rank_at[i] != rank:
                continue  # stale
            j = after[i]
            token[i] = rank
            k = after[i] = after[j]
            rank_at[j] = -1
            token[j] = -1
            if k < n:
                before[k] = i
                rank_at[i] = r = pair(rank, token[k])
                if r >= 0:
                    queue.push(r, i)
                    waiting += 1
            else:
                rank_at[i] = -1
            h = before[i]
            if h >= 0:
                rank_at[h] = r = pair(token[h], rank)
                if r >= 0:
                    queue.push(r, h)
                    waiting += 1
        return [t for t in token if t >= 0]

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """Each pre-token's ids as little-endian 32-bit numbers; many short ones go through one queue together."""
        out: list[bytes | None] = [None] * len(pieces)
        together = []
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = self.id_bytes[whole]
            elif len(piece) <= SHORT:
                together.append(i)
            else:
                out[i] = array("I", self.encode(piece)).tobytes()
        if len(together) < MANY:
            for i in together:
                out[i] = array("I", self.encode(pieces[i])).tobytes()
        else:
            for i, ids in zip(together, self._together([pieces[i] for i in together]), strict=True):
                out[i] = ids
        return out

    def _together(self, pieces: list[bytes]) -> list[bytes]:
        """:meth:`encode` for many pre-tokens: they share the bitmaps and buckets, and of each bucket the leftmost live position of every pre-token is merged at once.

        Pre-tokens don't touch one another, and the lowest rank of all is the lowest of those
        that have it, so each goes through its merges in its own order.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        # Cells: a stop, the bytes of a pre-token, a stop, the next one's bytes, ..., a stop.
        cells = int(sizes.sum()) + len(pieces) + 1
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        at = np.arange(len(raw)) + np.repeat(np.arange(1, len(pieces) + 1), sizes)
        token, owner = np.full(cells, -1, np.int32), np.full(cells, -1, np.int32)
        token[at], owner[at] = self.byte_ranks[raw], np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        rank_at = np.full(cells, -1, np.int32)
        pairs = (raw[:-1].astype(np.uint16) << 8) | raw[1:]
        rank_at[at[:-1]] = np.where(at[1:] == at[:-1] + 1, self.byte_pairs[pairs], -1)
        after, before = np.arange(1, cells + 1, dtype=np.int32), np.arange(-1, cells - 1, dtype=np.int32)
        queue, follows, leads = self.together, self.follows, self.leads
        live = np.flatnonzero(rank_at >= 0).astype(np.int32)
        queue.push(rank_at[live], live)
        while queue.top:
            rank, chunks = queue.pop()
            i = chunks[0] if len(chunks) == 1 else np.sort(np.concatenate(chunks))
            i = i[rank_at[i] == rank]  # the others are stale
            if len(i) == 0:
                continue
            own = owner[i]
            leftmost = own[1:] != own[:-1]
            if not leftmost.all():
                leftmost = np.concatenate(([True], leftmost))
                queue.put(rank, i[~leftmost])
                i = i[leftmost]
            j = after[i]
            k = after[j]
            h = before[i]
            token[i], token[j] = rank, -1
            after[i], before[k] = k, i
            rank_at[j] = -1
            right, left = follows.ranks(rank, token[k]), leads.ranks(rank, token[h])
            for where_, ranks in ((i, right), (h, left)):
                if ranks is None:
                    rank_at[where_] = -1
                else:
                    rank_at[where_] = ranks
                    queue.push(ranks, where_)
        kept = token >= 0
        raw_ids = token[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner[kept], minlength=len(pieces)))).tolist()
        return [raw_ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TextEncoder(PieceEncoder):
    """Splits texts by a pattern and encodes each match for itself, each distinct one once while it is remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(REMEMBERED)
        self.pairs = BytePairs(ranks)
        self.find = regex.compile(pattern).findall

    def _encoded(self, words: list[str]) -> list[bytes]:
        return self.pairs.encode_all([w.encode() for w in words])

    def _whole(self, text: str) -> list[str]:
        return self.find(text)


class TextDecoder:
    """Bytes, and decimal digits with a comma, of ids; all ids of a batch at once."""

    def __init__(self, bytes_of: dict[int, bytes]):
        top = max(bytes_of) + 1
        self.bytes = self._table([bytes_of.get(i, b"") for i in range(top)])
        self.digits = self._table([b"%d," % i for i in range(top)])

    @staticmethod
    def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([len(e) for e in entries], np.int64), np.frombuffer(b"".join(entries), np.uint8)

    @staticmethod
    def spell(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        out, at = gather(*table, ids.astype(np.int64))
        return memoryview(out), at


_encoders: dict[tuple[str, str], tuple[TextEncoder, TextDecoder]] = {}


def _run(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, pattern)
        if key not in _encoders:
            made = TextEncoder(load_ranks(path), pattern)
            _encoders[key] = made, TextDecoder(made.pairs.bytes_of)
        encoder, decoder = _encoders[key]
        for batch in batches:
            texts = filled(batch.column(1))
            ranges = list(chunks(texts))
            for i in range(0, len(ranges), 4):
                a, b = ranges[i][0], ranges[min(i + 4, len(ranges)) - 1][1]
                ids, sizes = encoder.encode(texts.slice(a, b - a))
                ends = np.concatenate(([0], np.cumsum(sizes)))
                digests, decoded = [], []
                raw, at = decoder.spell(decoder.bytes, ids)
                spelt, dat = decoder.spell(decoder.digits, ids)
                for x, y in zip(ends[:-1], ends[1:], strict=True):
                    digests.append(hashlib.sha256(spelt[dat[x] : max(dat[x], dat[y] - 1)]).hexdigest())
                    decoded.append(hashlib.sha256(raw[at[x] : at[y]]).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, digest of the ids and of the bytes they decode to, for each row's whole text.

    Takes doc_id and text, other columns are ignored.  Null texts are empty: no ids, and the
    digests of the empty string.  Rows come back as often as they came, null doc_ids too.
    ``ranks_path`` must be readable on every executor, as installed vocabularies are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_run(ranks_path, pattern), _OUT)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


__all__ = ["BytePairs", "RankQueue", "TextEncoder", "encode_digests", "load_ranks", "op9_byte_bpe"]
