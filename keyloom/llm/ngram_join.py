"""N-gram Jaccard join: PartEnum signatures, exact verification, connected components.

1. Each text becomes the set of its distinct word shingles; texts with one set are a
   class, named by a 128-bit digest of it.
2. Every class emits its PartEnum signatures (:mod:`.partenum`).  They are shuffled as
   packed arrays, sorted by signature where they meet, and never expanded into rows.
   In large tables they go in a few passes, one range of signatures after the other, so
   that only a pass's share is on disk at once; each pass makes the signatures anew.
   There a class goes by a short handle, as it meets in up to as many tasks as it has
   signatures; classes that share a handle are told apart afterwards.
3. A signature shared by up to :data:`PAIRED` classes gives their pairs.  One shared by
   more gives a star, and stars that overlap form clusters.  A star's edges are compared
   as pairs first.  Only classes of a cluster that have no link yet are compared further,
   in blocks of about :data:`BLOCK` classes, two blocks in one task: memory and rows stay
   bounded, many copies of one text cost one comparison each, and no pair is left out.
4. Pairs that parity sketches prove too different are left out: a cell of a sketch is odd
   where the sets' features there differ in number by an odd count, so two sketches differ
   in no more cells than the sets differ in features.  That bound never drops a link.
5. All other candidates are verified on the shingle sets of the whole texts.  Links carry
   class digests; components are found by :func:`.components.components`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .partenum import Bands, set_signatures
from .words import chunks, filled, mix, set_chunks, set_sums, shingle_sets
from .workspace import Workspace, partitions

#: A signature of so many classes at most gives all their pairs.
PAIRED = 16
#: Classes in a block; two blocks are compared at a time.
BLOCK = 128
#: Frequent shingles only steer which signatures are chosen, never which pairs are found.  They are in this share of the
#: documents, so there are at most 1 / share times a document's mean number of shingles, however many documents there are.
#: A larger share would leave passages of many documents among the rare ones, and candidates would grow faster than the input.
FREQUENT_SHARE = 0.0001
#: Ids and labels are broadcast up to this number (8 to 32 bytes each) and joined by a shuffle beyond it.
BROADCAST_IDS = 1 << 21
#: Documents for each task that signatures meet in, so that its memory doesn't grow with the input.
MET_DOCUMENTS = 50_000
#: Documents for each pass over the signatures, and passes at most: each takes the time to make them again, so their number may not grow with the input.
PASS_DOCUMENTS = 500_000
PASSES = 4
#: Bits of a class's digest in its handle. With fewer, more classes share a handle, which makes more candidates and loses no pair.
HANDLE_BITS = 32
#: Sizes in handles are this at most.
HANDLE_SIZE = (1 << 16) - 1

_EMITTED = "r int, doc_id long, key binary, n long, sketch binary, n_words long, carried string, handle long, sigs binary, counts binary, handles binary"
_MET = "kind string, key binary, sketch binary, a long, b long, doc_id long, n long, n_words long, carried string"


def class_keys(features: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128-bit digests (V16) of sets of distinct hashes side by side: two sums of products of their halves, finished."""
    with np.errstate(over="ignore"):
        high = features >> np.uint64(32)
        one = set_sums((features ^ np.uint64(0x5851F42D4C957F2D)) * high, at)
        two = set_sums((features | np.uint64(1)) * (high ^ features), at)
        n = np.diff(at).astype(np.uint64)
        return mix(np.stack([one + n, two + (one ^ (n << np.uint64(32)))], axis=1)).view("V16").reshape(-1)


def class_handles(keys: list[bytes], sizes: np.ndarray, bits: int) -> np.ndarray:
    """48-bit handles of classes: bits of the digest, then the size."""
    digests = np.frombuffer(b"".join(keys), "<u4")[::4].astype(np.int64) & ((1 << bits) - 1)
    return (digests << 16) | np.minimum(sizes, HANDLE_SIZE)


def parity_sketches(features: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set one bit for each of 2^k cells, at least one for a feature: whether the set has an odd number of features there.

    Halves of a sketch, combined by XOR, are the sketch of half as many cells.
    """
    n = np.diff(at)
    cells = np.array([1 << max(3, (x - 1).bit_length()) if x else 8 for x in n.tolist()], np.int64)
    stop = np.concatenate(([0], np.cumsum(cells)))
    cell = (features & np.repeat(cells - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(stop[:-1], n)
    raw = np.packbits((np.bincount(cell, minlength=stop[-1]) & 1).astype(np.uint8)).tobytes()
    ends = (stop >> 3).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def parity_sketch(features: np.ndarray) -> bytes:
    return parity_sketches(features, np.array([0, len(features)]))[0]


def may_link(a: bytes, n_a: int, b: bytes, n_b: int, percent: int) -> bool:
    """Whether sets of these sizes and sketches can have 100 * intersection >= percent * union."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= (n_a + n_b) * (100 - percent)


def _screen(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("sketch_a", "n_a", "sketch_b", "n_b"))
            kept = batch.select(["a", "b"]).filter(pa.array([may_link(*row, percent) for row in zip(*columns, strict=True)], pa.bool_()))
            if kept.num_rows:
                yield kept

    return run


def _frequent(texts: DataFrame, width: int, total: int) -> np.ndarray:
    """Hashes of shingles that a good share of all documents have.

    A shingle with that share of all documents has it in some batch, which reports it; so
    counting what batches report finds every such shingle, and rare ones are never sent.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Each set once: copies say nothing about passages that different texts share.
            sets = {}
            for features, at, _ in set_chunks(filled(batch.column(0)), width):
                for i, key in enumerate(class_keys(features, at).tolist()):
                    sets[key] = features[at[i] : at[i + 1]]
            if sets:
                h, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                often = n >= max(2, int(len(sets) * FREQUENT_SHARE))
                yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["h", "n"])

    least = max(20, int(total * FREQUENT_SHARE))
    rows = texts.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy().view(np.uint64))


def _emit(width: int, percent: int, reducers: int, frequent: np.ndarray, bits: int = HANDLE_BITS, part: int = 0, parts: int = 1):
    """Signatures that meet in the part's share of the reducers, which are numbered from 0 in each part; the first part has the documents too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            texts = filled(batch.column(1))
            for lo, hi in _slices(texts):
                keys, sizes, n_words, sketches, seen, classes, sigs, owners = [], [], [], [], {}, [], [], []
                for features, at, words in set_chunks(texts.slice(lo, hi - lo), width):
                    n_words.append(words)
                    found, n = class_keys(features, at).tolist(), np.diff(at)
                    keys += found
                    sizes.append(n)
                    sketches += parity_sketches(features, at)
                    # Signatures once for each class.
                    new = []
                    for i, key in enumerate(found):
                        if n[i] and key not in seen:
                            seen[key] = len(seen)
                            classes.append(len(keys) - len(found) + i)
                            new.append(i)
                    sig, owner = set_signatures(*_chosen(features, at, new), bands, frequent)
                    sigs.append(sig)
                    owners.append(owner + (len(seen) - len(new)))
                rows = batch.slice(lo, hi - lo)
                n = np.concatenate(sizes)
                handles = class_handles(keys, n, bits)
                facts = {"doc_id": rows.column(0), "key": pa.array(keys, pa.binary()), "n": pa.array(n), "sketch": pa.array(sketches, pa.binary()), "n_words": pa.array(np.concatenate(n_words)), "carried": rows.column(2), "handle": pa.array(handles)}
                yield from _packed(facts, handles[np.array(classes, np.int64)], np.concatenate(sigs), np.concatenate(owners).astype(np.uint64), reducers, part, parts)

    return run


def _chosen(features: np.ndarray, at: np.ndarray, rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Some of the sets, side by side again."""
    if len(rows) == len(at) - 1:
        return features, at
    rows = np.array(rows, np.int64)
    stop = np.concatenate(([0], np.cumsum(at[rows + 1] - at[rows])))
    return features[np.repeat(at[rows] - stop[:-1], np.diff(stop)) + np.arange(stop[-1])], stop


def _slices(texts: pa.Array, group: int = 12) -> Iterator[tuple[int, int]]:
    """Ranges of a few chunks each, as what one range shares is packed together."""
    ranges = list(chunks(texts))
    for i in range(0, len(ranges), group):
        yield ranges[i][0], ranges[min(i + group, len(ranges)) - 1][1]


def _packed(facts: dict[str, pa.Array], classes: np.ndarray, all_sigs: np.ndarray, owner: np.ndarray, reducers: int, part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one for each reducer with its share of the signatures: 32 bits of each, class by class, and these classes' numbers of signatures and handles.

    Documents are dealt round robin, so many copies of one text are no large task.
    """
    names, n = _names(_EMITTED), len(facts["doc_id"])
    lo, hi = part_range(reducers, part, parts)
    facts = {"r": pa.array(np.arange(n) % (hi - lo), pa.int32())} | facts
    if part == 0:
        yield pa.RecordBatch.from_arrays([facts[c] if c in facts else pa.nulls(n, pa.binary()) for c in names], names=names)
    # The upper half of a signature chooses the reducer, the lower one tells it apart there.
    place = ((all_sigs >> np.uint64(32)) * np.uint64(reducers)) & ~np.uint64(0xFFFFFFFF)
    if parts > 1:
        here = (place >= np.uint64(lo << 32)) & (place < np.uint64(hi << 32))
        all_sigs, owner, place = all_sigs[here], owner[here], place[here] - np.uint64(lo << 32)
    if not len(all_sigs):
        return
    place, reducers = place | owner, hi - lo
    order = np.argsort(place)
    sigs, place = all_sigs[order].astype(np.uint32), place[order]
    start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    count, place = np.diff(np.append(start, len(sigs))), place[start]
    handles = classes[(place & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    ends = np.searchsorted(place >> np.uint64(32), np.arange(reducers + 1, dtype=np.uint64))
    start = np.append(start, len(sigs))
    rows = []
    for r in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
        a, b = ends[r], ends[r + 1]
        kind = np.uint8 if count[a:b].max() < 256 else np.uint32
        # Halves of the handles apart: six bytes each.
        both = (handles[a:b] >> 16).astype("<u4").tobytes() + (handles[a:b] & HANDLE_SIZE).astype("<u2").tobytes()
        rows.append((r, sigs[start[a] : start[b]].tobytes(), count[a:b].astype(kind).tobytes(), both))
    columns = dict(zip(("r", "sigs", "counts", "handles"), zip(*rows, strict=True), strict=True))
    kinds = {"r": pa.int32(), "doc_id": pa.int64(), "n": pa.int64(), "n_words": pa.int64(), "carried": pa.string(), "handle": pa.int64()}
    yield pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * len(rows)), kinds.get(c, pa.binary())) for c in names], names=names)


def part_range(reducers: int, part: int, parts: int) -> tuple[int, int]:
    return reducers * part // parts, reducers * (part + 1) // parts


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _meet(percent: int):
    """One reducer's share of all signatures: documents pass through; classes that share a signature become pairs, of sizes that can link, or stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners, handles, have = [], [], [], 0
        for batch in batches:
            packed = batch.column("sigs").is_valid()
            docs = batch.filter(packed.__class__.from_pandas(~packed.to_numpy(zero_copy_only=False)))
            if docs.num_rows:
                none = pa.nulls(docs.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(["doc"] * docs.num_rows), docs.column("key"), docs.column("sketch"), docs.column("handle"), none, *(docs.column(c) for c in ("doc_id", "n", "n_words", "carried"))], names=_names(_MET))
            rows = batch.filter(packed)
            for s, n, both in zip(*(rows.column(c).to_pylist() for c in ("sigs", "counts", "handles")), strict=True):
                size = len(both) // 6
                sigs.append(np.frombuffer(s, np.uint32))
                owners.append(np.repeat(np.arange(have, have + size), np.frombuffer(n, np.uint8 if len(n) == size else np.uint32)))
                handles.append((np.frombuffer(both, "<u4", size).astype(np.int64) << 16) | np.frombuffer(both, "<u2", size, 4 * size))
                have += size
        if not sigs:
            return
        names, rank = np.unique(np.concatenate(handles), return_inverse=True)
        # A size that is cut off to fit a handle drops no pair.
        sizes = names & HANDLE_SIZE
        sig, owner = np.concatenate(sigs), rank[np.concatenate(owners)]
        both = np.sort((sig.astype(np.uint64) << np.uint64(32)) | owner.astype(np.uint64))
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
        sig, owner = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        length = np.diff(np.append(start, len(sig)))
        pairs, stars = [], []
        for size in range(2, PAIRED + 1):
            at = start[length == size]
            for i in range(size):
                for j in range(i + 1, size):
                    a, b = owner[at + i], owner[at + j]
                    near = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
                    pairs.append(a[near] * len(names) + b[near])
        for at, size in zip(start[length > PAIRED], length[length > PAIRED], strict=True):
            stars.append(owner[at] * len(names) + owner[at + 1 : at + size])
        for kind, found in (("pair", pairs), ("large", stars)):
            found = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            for lo in range(0, len(found), 50_000):
                part = found[lo : lo + 50_000]
                a, b = (pa.array(names[side]) for side in (part // len(names), part % len(names)))
                none, blank = pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(part), pa.string()), blank, blank, a, b, none, none, none, pa.nulls(len(part), pa.string())], names=_names(_MET))

    return run


def _keyed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(0))
            keys = [key for features, at, _ in set_chunks(texts, width) for key in class_keys(features, at).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), texts.cast(pa.string())], ["key", "text"])

    return run


def _check_pairs(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = np.zeros(len(a), bool)
            # Neighbouring rows often share a text: its set is made once.
            for lo in range(0, len(a), 1000):
                part = batch.slice(lo, 1000)
                sets: dict[bytes, np.ndarray] = {}
                for names, column in ((a[lo : lo + 1000], "text_a"), (b[lo : lo + 1000], "text_b")):
                    first = {k: i for i, k in reversed(list(enumerate(names))) if k not in sets}
                    sets.update(zip(first, shingle_sets(filled(part.column(column).take(pa.array(list(first.values()), pa.int64()))), width), strict=True))
                for i in range(len(part)):
                    keep[lo + i] = linked(sets[a[lo + i]], sets[b[lo + i]], percent)
            kept = batch.select(["a", "b"]).filter(pa.array(keep))
            if kept.num_rows:
                yield kept

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _check_blocks(width: int, percent: int):
    """One task row group: the classes of two blocks of one cluster, all compared; emits a spanning forest of their links."""

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        side = table.column("side").to_numpy()
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        sets = list(shingle_sets(filled(table.column("text")), width))
        size = np.array([len(s) for s in sets])
        h, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        shared = np.bincount(column) > 1
        dense = np.zeros((len(sets), int(shared.sum())), np.float32)
        use = shared[column]
        dense[row[use], (np.cumsum(shared) - 1)[column[use]]] = 1
        left = np.arange(len(sets)) if same else np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        both = np.rint(dense[left] @ dense[right].T).astype(np.int64)
        found = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
        parent = list(range(len(sets)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(found), strict=True):
            p, q = root(int(left[x])), root(int(right[y]))
            if p != q:
                parent[q] = p
                out.append((keys[left[x]], keys[right[y]]))
        return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})

    return run


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Components of the documents under ``100 * intersection >= percent * union`` of shingle sets.

    Takes columns doc_id and text, others are ignored.  Returns doc_id, n_shingles (size of
    the set) and component_id (the smallest doc_id reachable by links, itself included), one
    row for each input row.  Null and blank texts have the empty set and link with nothing,
    not even each other.  Repeated rows come back as often as they came.  Rows that share a
    doc_id keep their own sets.  A null doc_id takes part in links but never names a
    component; alone, its component_id is null.  No input rows, no output rows.
    """
    return linked_rows(docs, F.lit(None), width, percent).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def linked_rows(docs: DataFrame, carry: Column, width: int = 5, percent: int = 75) -> DataFrame:
    """A row for each of ``docs``: doc_id, n (size of its set), n_words, carried (the value of ``carry`` as a string), and of its component a label (binary) and the least doc_id; both null without words."""
    spark = docs.sparkSession
    work = Workspace(spark, "ngram_join")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carry.cast("string").alias("carried"))
    total = texts.count()
    reducers = max(partitions(spark), total // MET_DOCUMENTS)
    frequent = _frequent(texts, width, total)
    parts = min(PASSES, reducers, 1 + total // PASS_DOCUMENTS)
    met = None
    for part in range(parts):
        lo, hi = part_range(reducers, part, parts)
        found = work.write(texts.mapInArrow(_emit(width, percent, reducers, frequent, HANDLE_BITS, part, parts), _EMITTED).repartitionById(hi - lo, "r").mapInArrow(_meet(percent), _MET), f"met{part}")
        work.release()
        met = found if met is None else met.union(found)
        # Documents are in the first part only.
        documents = found if part == 0 else documents
    rows = documents.where("kind = 'doc'").select("doc_id", "key", "n", "n_words", "carried")
    classes = work.write(documents.where("kind = 'doc' AND n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.min("sketch").alias("sketch"), F.min("a").alias("handle")), "classes")
    facts = lambda x: classes.select(F.col("handle").alias(f"handle_{x}"), F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    # A star's edges are compared as pairs first; what they link need not be compared again.  Classes that share a handle are pairs too.
    shared = classes.groupBy("handle").count().where("count > 1").select(F.col("handle").alias("handle_a"), F.col("handle").alias("handle_b"))
    met_pairs = met.where("kind IN ('pair', 'large')").select(F.col("a").alias("handle_a"), F.col("b").alias("handle_b")).distinct().union(shared)
    pairs = met_pairs.join(facts("a"), "handle_a").join(facts("b"), "handle_b").where("handle_a <> handle_b OR a < b")
    pairs = work.write(pairs.mapInArrow(_screen(percent), "a binary, b binary"), "pairs")
    work.release()
    stars = met.where("kind = 'large'").select("a", "b")
    clusters = work.write(components(stars, work, "clusters").toDF("handle", "cluster").join(classes.select("handle", "key"), "handle").select("key", "cluster"), "clusters")
    work.release()

    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).union(clusters.select("key")).distinct()
    found = work.write(classes.select("key", "doc_id").join(wanted, "key", "left_semi"), "wanted")
    ids = found.select(F.col("doc_id").alias("wanted_id")).distinct()
    ids = F.broadcast(ids) if found.count() <= BROADCAST_IDS else ids
    named = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text").mapInArrow(_keyed(width), "key binary, text string")
    bodies = work.write(named.join(found.select("key"), "key", "left_semi").dropDuplicates(["key"]), "bodies")
    # Pairs by handles are read no more.
    work.drop(*(f"met{part}" for part in range(1, parts)))
    work.release()

    side = lambda x: bodies.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}"))
    links = work.write(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_check_pairs(width, percent), "a binary, b binary"), "pair_links")
    work.release()
    labels = components(links, work, "links")
    blocks = _blocks(clusters, labels, work)
    if not blocks.isEmpty():
        checked = blocks.join(bodies, "key").groupBy("cluster", "i", "j").applyInArrow(_check_blocks(width, percent), "a binary, b binary")
        labels = components(links.union(work.write(checked, "block_links")), work, "all_links")

    # Classes that have links are named by their component's least id, all others by their own.
    labelled = work.write(classes.select("key", "doc_id").join(labels.toDF("key", "c"), "key"), "labelled")
    least = work.write(labelled.groupBy("c").agg(F.min("doc_id").alias("least")), "least")
    named_by = work.write(labelled.select("key", "c").join(least, "c"), "named")
    single = work.write(classes.join(named_by, "key", "left").select("key", F.coalesce("c", "key").alias("label"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("least")), "components")
    out = rows.join(single, "key", "left").select("doc_id", "n", "n_words", "carried", "label", "least")
    work.drop_others("met0", "components")
    return out


def _blocks(clusters: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    """(key, cluster, i, j, side): the classes of a cluster in every two blocks whose classes aren't known to be linked.

    Classes of one component (label) are known to be linked.  A component of many classes
    has blocks of its own, which need no comparing among themselves; the others share
    blocks.  Blocks are numbered by a hash, so a large cluster is dealt out without a sort in one task.
    """
    own = work.write(clusters.join(labels.toDF("key", "c"), "key", "left").select("key", "cluster", F.coalesce("c", "key").alias("own")), "own")
    groups = work.write(own.groupBy("cluster", "own").agg(F.count("*").alias("size")), "groups")
    large = F.col("size") * 2 >= BLOCK
    open_ = work.write(groups.groupBy("cluster").agg(F.count("*").alias("groups"), F.sum(F.when(~large, F.col("size"))).alias("rest")).where("groups > 1"), "open")
    block = F.when(large, F.concat(F.lit("g"), F.hex("own"), F.lit("-"), F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / BLOCK)))).otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("own"), F.ceil(F.col("rest") / BLOCK))))
    sized = work.write(groups.join(open_, "cluster"), "sized")
    placed = work.write(own.join(sized, ["cluster", "own"]).select("key", "cluster", block.alias("block"), F.when(large, F.col("own")).alias("group")), "placed")
    others = placed.select("cluster", F.col("block").alias("other"), F.col("group").alias("other_group")).distinct()
    # A join on the cluster: a block meets the others, so rows grow with blocks, of which linked ones make none.
    met = placed.join(others, "cluster").where(F.col("group").isNull() | F.col("other_group").isNull() | (F.col("group") != F.col("other_group")))
    return met.select("key", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))


def keep_one_per_component(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The input rows whose doc_id names their component: one document of each group stays, all columns kept.

    Ids that name no component go.  Rows that repeat a staying id come down to one for each
    of its texts.  Rows without a doc_id stay only if one of them is a component without ids.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "ngram_keep")
    found = jaccard_components(docs, width, percent)
    named = work.write(found.groupBy(F.col("doc_id").alias("own_id")).agg(F.sum(F.col("doc_id").eqNullSafe(F.col("component_id")).cast("int")).alias("heads")).where("heads <> 1"), "named")
    gone, again = named.agg(F.count_if(F.col("heads") == 0), F.count_if(F.col("heads") > 1)).first()
    # Documents that go are few beside those that stay, so texts needn't be shuffled for them.
    side = lambda condition, n: F.broadcast(named.where(condition)) if n <= BROADCAST_IDS else named.where(condition)
    same = docs["doc_id"].eqNullSafe(F.col("own_id"))
    kept = docs.join(side("heads = 0", gone), same, "left_anti") if gone else docs
    if not again:
        return kept
    once = kept.join(side("heads > 1", again), same, "left_anti")
    return once.unionByName(kept.join(side("heads > 1", again), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
