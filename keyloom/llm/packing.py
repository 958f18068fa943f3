"""Conflict-constrained best-fit packing of documents into bins of fixed length.

Bins are kept by residual (the room they have left) and an integer's set bits tell which
residuals have bins, so the tightest bin that fits is the first set bit at or above the
item's length.  Each bin carries two bitmaps: the sources and the duplicate clusters it
holds.  A bin that holds the item's source or cluster is passed over and the search goes
on to its successor, until the tightest compatible bin is found or none is left.

Rows are dealt round robin, so no key can be hot, and packed in runs of :data:`RUN`
items, longest first; a run's bins and bitmaps are all the memory that packing takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngram_join import linked_rows
from .workspace import Workspace

CAPACITY = 2048
#: Items packed together.
RUN = 4096
_PACKED = "doc_id long, piece int, start long, length int, bin_id long, position int, offset int"
_CLASH = "keyloom_"


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def same_words(text: Column) -> Column:
    """A hash of the text in lower case with its white space evened out: documents with one value are one duplicate cluster."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " ")))


def pack_run(lengths: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit in the given order: for each item its bin, its position in it and its offset.

    A length must be in 0..capacity.  Items of full length get bins of their own without a
    search.  A null source or cluster conflicts with nothing.
    """
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(c for c, n in _counts(clusters).items() if n > 1 and c is not None))}
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_residuals = 0
    room: list[int] = []
    held_sources: list[int] = []
    held_clusters: list[int] = []
    held: list[int] = []
    bins, positions, offsets = [], [], []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        chosen = -1
        rest = open_residuals >> length << length if length < capacity else 0
        while rest:
            low = rest & -rest
            residual = low.bit_length() - 1
            for at, b in enumerate(by_residual[residual]):
                if not (held_sources[b] & s or held_clusters[b] & c):
                    chosen = b
                    by_residual[residual].pop(at)
                    if not by_residual[residual]:
                        open_residuals ^= low
                    break
            if chosen >= 0:
                break
            rest ^= low
        if chosen < 0:
            chosen = len(room)
            room.append(capacity)
            held_sources.append(0)
            held_clusters.append(0)
            held.append(0)
        bins.append(chosen)
        positions.append(held[chosen])
        offsets.append(capacity - room[chosen])
        room[chosen] -= length
        held_sources[chosen] |= s
        held_clusters[chosen] |= c
        held[chosen] += 1
        if room[chosen]:
            by_residual[room[chosen]].append(chosen)
            open_residuals |= 1 << room[chosen]
    return bins, positions, offsets


def _counts(values: list) -> dict:
    out: dict = {}
    for v in values:
        out[v] = out.get(v, 0) + 1
    return out


def _pack(capacity: int, run: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        done, waiting = 0, []

        def flush(table: pa.Table) -> pa.RecordBatch:
            nonlocal done
            # Longest first; ids and pieces settle ties.
            table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
            length = table.column("length").to_pylist()
            bins, positions, offsets = pack_run(length, table.column("source").to_pylist(), table.column("cluster").to_pylist(), capacity)
            out = pa.table({"doc_id": table.column("doc_id"), "piece": table.column("piece"), "start": table.column("start"), "length": table.column("length"), "bin_id": pa.array(np.array(bins, np.int64) + (base + done)), "position": pa.array(positions, pa.int32()), "offset": pa.array(offsets, pa.int32())})
            done += max(bins) + 1
            return out.combine_chunks().to_batches()[0]

        have = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, run - have)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                have += part.num_rows
                if have == run:
                    yield flush(pa.Table.from_batches(waiting))
                    waiting, have = [], 0
        if have:
            yield flush(pa.Table.from_batches(waiting))

    return packed


def pack(items: DataFrame, capacity: int = CAPACITY, run: int = RUN) -> DataFrame:
    """Packs rows (doc_id, length, source, cluster) into bins of ``capacity`` units; no bin holds two items of a source or of a cluster.

    An item longer than a bin is cut into pieces of ``capacity`` units and a rest; all of it
    is packed.  Returns doc_id, piece, start (of the piece in the document), length, bin_id,
    position and offset (in the bin): together the pieces cover every document once.  Items
    without length keep one row, of length 0.  A null length counts as 0, a null source or
    cluster conflicts with nothing, a null doc_id is kept; repeated rows are packed as often
    as they come, apart where they share a source or a cluster.  Other columns are ignored.
    """
    if capacity < 1 or run < 1:
        raise ValueError("capacity and run must be positive")
    length = F.greatest(F.lit(0), F.coalesce(F.col("length").cast("long"), F.lit(0)))
    rows = items.select(F.col("doc_id").cast("long").alias("doc_id"), length.alias("total"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"))
    cut = rows.select("doc_id", "total", "source", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("total") - 1) / capacity)))).alias("p"))
    pieces = cut.select("doc_id", F.col("p").cast("int").alias("piece"), (F.col("p") * capacity).alias("start"), F.least(F.lit(capacity), F.col("total") - F.col("p") * capacity).cast("int").alias("length"), "source", "cluster")
    # As many tasks as give each a few runs; the count reads no text if the rows are a table's.
    tasks = max(1, -(-rows.count() // (4 * run)))
    return pieces.repartition(tasks).sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "source", "cluster").mapInArrow(_pack(capacity, run), _PACKED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, near: bool = False) -> DataFrame:
    """:func:`pack` for documents (doc_id, text, source): lengths in words; documents with the same words but for case and white space are a cluster.

    With ``near``, clusters are those of documents that near copies link, the components of
    :func:`jaccard_components`; without it, only where near copies are gone already.
    """
    if near:
        # Near copies are found in a pass over the texts that counts their words too.
        found = linked_rows(docs, F.col("source"))
        items = found.select("doc_id", F.col("n_words").alias("length"), F.col("carried").alias("source"), F.hex("label").alias("cluster"))
        return pack(Workspace(docs.sparkSession, "packing").write(items, "items"), capacity)
    text = F.col("text").cast("string")
    items = docs.select("doc_id", word_count(text).alias("length"), F.col("source"), F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0, same_words(text)).alias("cluster"))
    return pack(items, capacity)


def assemble(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """(bin_id, texts): the packed pieces' words in their order; doc_id must be unique in ``docs``."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    body = docs.select(F.col("doc_id"), words.alias(f"{_CLASH}words"))
    joined = packed.join(body, "doc_id").withColumn("part", F.array_join(F.slice(f"{_CLASH}words", F.col("start").cast("int") + 1, F.col("length")), " "))
    return joined.groupBy("bin_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "part"))), lambda x: x["part"]).alias("texts"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), near=True)
