"""Token-id output: documents' ids in Huffman-coded blocks, and reading them back.

The format is three Parquet tables: ``code`` (id, length), ``blocks`` and ``shards``.  A
shard holds a range of doc_ids, shards are numbered in that order; a block holds whole
documents in ascending doc_id and can be decoded without any other.  Of each document a
block has its id, number of ids, number of bytes, and bit offsets as checkpoints.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .huffman import CHECKPOINT, Coder, code_lengths
from .pieces import PieceEncoder
from .words import chunks, filled
from .workspace import Workspace, partitions

#: Distinct words that a Python worker remembers, twice at most.
REMEMBERED = 400_000
#: Coded bytes from which a block is closed.
BLOCK_BYTES = 1 << 20
END_ID = 2
_IDS = "doc_id long, tie long, n_tokens long, ids binary, counts binary"
_CODED = "doc_id long, tie long, n_tokens long, n_bytes long, coded binary, marks binary"
_BLOCK = "shard int, block long, start long, n_docs long, doc_ids binary, present binary, sizes binary, n_bytes binary, marks binary, coded binary"
_READ = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _byte_letters() -> dict[int, str]:
    """The printable letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class PieceTokenizer(PieceEncoder):
    """Ids of texts by the tokenizers library, each distinct word tokenised once while it is remembered.

    Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(REMEMBERED)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.normalizer is not None or "ByteLevel" not in type(self.tokenizer.pre_tokenizer).__name__:
            raise ValueError("a byte-level tokenizer without normaliser is needed")
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.bytes = {ord(letter): b for b, letter in self.letters.items()}

    def _encoded(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        # Byte-level vocabularies spell a word's bytes in letters; no text has the byte 255.
        tokenize = self.model.tokenize
        spelt = b"\xff".join([w.encode() for w in words]).decode("latin-1").translate(self.letters).split(self.letters[255])
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in spelt]

    def _whole(self, text: str) -> list[str]:
        return [w.translate(self.bytes).encode("latin-1").decode() for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] if text else []


_tokenizers: dict[str, PieceTokenizer] = {}


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizers.get(path) or _tokenizers.setdefault(path, PieceTokenizer(path))
        total, end = np.zeros(0, np.int64), array("I", [end_id]).tobytes()
        for batch in batches:
            texts = filled(batch.column("text"))
            ranges = list(chunks(texts))
            for i in range(0, len(ranges), 8):
                a, b = ranges[i][0], ranges[min(i + 8, len(ranges)) - 1][1]
                ids, sizes = tokenizer.encode(texts.slice(a, b - a), end)
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("tie").slice(a, b - a), pa.array(sizes, pa.int64()), _narrow(ids, sizes), pa.nulls(b - a, pa.binary())], names=_names(_IDS))
        used = np.flatnonzero(total)
        counts = np.stack([used, total[used]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts], pa.binary())], names=_names(_IDS))

    return run


def _narrow(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Each text's ids as low bytes of all, then the next, and so on as far as any id of the batch needs: like bytes together compress better."""
    width = max(2, (int(ids.max(initial=0)).bit_length() + 7) // 8)
    ends = [0, *np.cumsum(sizes).tolist()]
    planes = [((ids >> np.uint32(8 * j)) & np.uint32(255)).astype(np.uint8).tobytes() for j in range(width)]
    return pa.array([b"".join([p[a:b] for p in planes]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())


def _wide(data: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The ids of several texts in a row."""
    out = np.zeros(int(sizes.sum()), np.uint32)
    raw, lengths = np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data], np.int64)
    width = lengths // np.maximum(1, sizes)
    start, base = np.cumsum(lengths) - lengths, np.cumsum(sizes) - sizes
    for j in range(int(width.max(initial=0))):
        has = width > j
        n = np.where(has, sizes, 0)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(base, n) + at] |= raw[np.repeat(start + j * sizes, n) + at].astype(np.uint32) << np.uint32(8 * j)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            pairs = np.frombuffer(data, "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["id", "n"])


def _encode(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(lengths)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sizes = part.column("n_tokens").to_numpy()
                ids = _wide(part.column("ids").to_pylist(), sizes)
                data, n_bytes, marks, n_marks = coder.encode(ids, sizes)
                raw, raw_marks = data.tobytes(), marks.astype("<u4").tobytes()
                ends, mark_ends = [0, *accumulate(n_bytes.tolist())], [0, *accumulate((4 * n_marks).tolist())]
                coded = pa.array([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
                at = pa.array([raw_marks[a:b] for a, b in zip(mark_ends, mark_ends[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), part.column("n_tokens"), pa.array(n_bytes, pa.int64()), coded, at], names=_names(_CODED))

    return run


def _block(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start, rows, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            ids, sizes, n_bytes, coded, marks = zip(*rows, strict=True)
            column = [shard, block, start, len(rows), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids], "u1").tobytes(), np.array(sizes, "<i8").tobytes(), np.array(n_bytes, "<i8").tobytes(), b"".join(marks), b"".join(coded)]
            kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(column, kinds, strict=True)], names=_names(_BLOCK))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "n_bytes", "coded", "marks")), strict=True):
                rows.append(row)
                size += row[2]
                if size >= block_bytes:
                    yield flush()
                    block, start, rows, size = block + 1, start + sum(r[1] for r in rows), [], 0
        if rows:
            yield flush()

    return run


def _decode(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes = decode_block(row, coder)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                n = len(sizes)
                mask = np.frombuffer(row["present"], "u1") == 0
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * n, pa.int32()), pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=mask), pa.array(ends[:-1] + row["start"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=_names(_READ))

    return run


def decode_block(row: dict, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
    """A block's ids in a row, and how many each document has."""
    sizes, n_bytes = (np.frombuffer(row[c], "<i8") for c in ("sizes", "n_bytes"))
    return coder.decode(np.frombuffer(row["coded"], np.uint8), n_bytes, sizes, np.frombuffer(row["marks"], "<u4").astype(np.int64)), sizes


def write_tokens(docs: DataFrame, work: Workspace, tokenizer_path: str, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Tokenises whole texts, appends ``end_id`` to each and writes the blocks; returns the tables (code, blocks).

    Takes doc_id and text, other columns are ignored.  Null texts are empty: only the end
    id.  Rows with one doc_id are ordered by a hash of their text and may lie in several
    shards, so a hot id is no large task; null doc_ids come first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tie"), F.col("text").cast("string").alias("text"))
    ids = work.write_zstd(rows.mapInArrow(_tokenize(tokenizer_path, end_id), _IDS), "ids")
    counted = ids.select("counts").where("counts IS NOT NULL").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary
    counts = np.zeros(max((r.id for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    code = work.write(spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, length int").coalesce(1), "code")
    # Shards are ranges between quantiles of doc_id; an id that several quantiles fall on is dealt over the shards between them.
    # Range partitioning by Spark would encode everything once more, for its sample.
    documents, shards = ids.where("n_tokens >= 0"), partitions(spark)
    cuts = documents.select(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 100 * shards)).first()[0] if shards > 1 else None
    cuts = F.lit([int(c) for c in cuts or []]).cast("array<bigint>")
    below, upto = (F.size(F.filter(cuts, test)) for test in (lambda c: c < F.col("doc_id"), lambda c: c <= F.col("doc_id")))
    shard = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(below + F.pmod(F.col("tie"), (upto - below + 1).cast("long"))).cast("int")
    coded = documents.drop("counts").mapInArrow(_encode(lengths), _CODED)
    blocks = coded.repartitionById(shards, shard).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").mapInArrow(_block(block_bytes), _BLOCK)
    blocks = work.write(blocks, "blocks")
    work.drop("ids")
    return code, blocks


def read_tokens(code: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document in the blocks."""
    spark = blocks.sparkSession
    table = code.collect()  # a row for each id of the vocabulary
    lengths = np.zeros(max((r.id for r in table), default=0) + 1, np.uint8)
    for r in table:
        lengths[r.id] = r.length
    last = blocks.groupBy("shard").agg(F.max_by(F.struct("start", "sizes"), "block").alias("l")).select("shard", "l.start", "l.sizes").collect()  # a row for each shard
    bases, total = [], 0
    for r in sorted(last, key=lambda r: r.shard):
        bases.append((r.shard, total))
        total += r.start + int(np.frombuffer(bytes(r.sizes), "<i8").sum())
    base = F.broadcast(spark.createDataFrame(bases, "shard int, base long"))
    read = blocks.mapInArrow(_decode(lengths), _READ)
    return read.join(base, "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    work = Workspace(spark, "tokens")
    return read_tokens(*write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), work, public_tokenizers.path("byte_bpe_50k.json")))


__all__ = ["CHECKPOINT", "PieceTokenizer", "decode_block", "op4_token_output", "read_tokens", "write_tokens"]
