"""Document fingerprints: SimHash with votes on signed bits, and permuted block tables for a Hamming radius.

DataFrame functions only.  A text's terms are its shingles of five words, weighted by how
often they occur.  A term's 64-bit hash votes +weight or -weight on each bit.  The votes
are counted in packed lanes: sixteen partial sums of a long each hold four 16-bit lanes,
so a term costs sixteen masked additions in generated code and no array of 64 numbers;
each :data:`LANE_TERMS` terms of a text are summed apart, so that no lane overflows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

WIDTH = 5
BITS = 64
#: Terms whose votes one packed sum can hold: 2^15 in the top lane would overflow the signed long.
LANE_TERMS = (1 << 15) - 1
_LANES = 16
_MASK = 0x0001000100010001
#: Documents whose id this divides ask for their neighbours.
QUERIED = 20
WHITE = r"[\x20\x09-\x0D]+"


def term_hashes(text: Column, width: int = WIDTH) -> Column:
    """Array of a text's term hashes: its shingles, or all its words as one term if fewer; empty without words."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    few = F.array(words)
    return F.transform(
        few,
        lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(*(F.element_at(w, (i + j).cast("int")) for j in range(width)))))
        .when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
        .otherwise(F.array().cast("array<bigint>")),
    )[0]


def fingerprints(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key`` columns and ``bits``, the 64-bit fingerprint of each row's whole text; a row without terms has 0.

    ``key`` must tell the rows apart.  Equal texts have equal fingerprints.
    """
    terms = rows.select(*key, term_hashes(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    votes = terms.select(*key, F.posexplode_outer("terms").alias("pos", "h")).withColumn("part", F.floor(F.coalesce(F.col("pos"), F.lit(0)) / LANE_TERMS))
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_MASK))).alias(f"s{i}") for i in range(_LANES)]
    parts = votes.groupBy(*key, "part").agg(F.count("h").alias("n"), *lanes)
    # Lane j of sum i counts the set bits at i + 16 j.
    ones = [F.sum(F.shiftrightunsigned(f"s{b % _LANES}", 16 * (b // _LANES)).bitwiseAND(F.lit(0xFFFF))).alias(f"o{b}") for b in range(BITS)]
    counted = parts.groupBy(*key).agg(F.sum("n").alias("n"), *ones)
    # A bit is set when its vote, ones minus zeros, is positive.
    bit = lambda b: F.when(F.col(f"o{b}") * 2 > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0))
    return counted.select(*key, reduce(lambda x, y: x.bitwiseOR(y), (bit(b) for b in range(BITS))).alias("bits"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def block_keys(bits: Column, radius: int, keep: int = 1) -> Column:
    """Keys of the permuted block tables: the bits are cut into radius + keep blocks, each table leads with ``keep`` of them.

    Two fingerprints within the radius differ in at most ``radius`` blocks, so they agree on
    the leading blocks of at least one table.
    """
    from itertools import combinations

    n = radius + keep
    edges = [round(i * BITS / n) for i in range(n + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    chosen = [signed(sum(masks[i] for i in c)) for c in combinations(range(n), keep)]
    return F.array(*(F.struct(F.lit(t).alias("table"), bits.bitwiseAND(F.lit(m)).alias("lead")) for t, m in enumerate(chosen)))


def near_fingerprints(queries: DataFrame, fingerprints_: DataFrame, radius: int = 3, keep: int = 2) -> DataFrame:
    """All (query_bits, bits, distance) with distance <= radius, between distinct fingerprints of two tables with column ``bits``.

    Each pair comes once, whatever number of tables it meets in.  Copies of one fingerprint
    are folded first, so a group of equal texts makes no pairs.  Null fingerprints match nothing.
    """
    side = lambda df, name: df.select(F.col("bits").alias(name)).where(F.col(name).isNotNull()).distinct().select(name, F.explode(block_keys(F.col(name), radius, keep)).alias("k")).select(name, "k.table", "k.lead")
    distance = F.bit_count(F.col("query_bits").bitwiseXOR(F.col("bits")))
    met = side(queries, "query_bits").join(side(fingerprints_, "bits"), ["table", "lead"])
    return met.where(distance <= radius).select("query_bits", "bits", distance.alias("distance")).distinct()


def document_fingerprints(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Fingerprint of each text and of its edited text, with their likeness and that to the next document's.

    Takes doc_id and text, other columns are ignored.  The edited text is the text with its
    last floor(n_chars / 4) code points replaced by as many first ones of the next document
    (all if it has fewer), in ascending doc_id, the first following the last.  Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (16 hex digits),
    near_edited, near_next, near_marks, a row for each input row.  near_marks is, for
    documents whose id is divisible by :data:`QUERIED`, how many other fingerprints of the
    documents lie within ``radius`` bits of its own, as the block tables find them, and null
    for others.  Null texts count as empty; texts without words have fingerprint 0.  Equal
    doc_ids are ordered by text, a null one comes first.  A single document is its own next one.
    """
    work = Workspace(docs.sparkSession, "simhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = _cuts(rows)
    bucket = F.coalesce(F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(bucket))
    # Each range's first row comes again behind the range before it, the first range's behind the last.
    heads = work.write(rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "text")).alias("head")), "heads")
    ranges = [r.bucket for r in heads.select("bucket").orderBy("bucket").collect()]  # as many as the cuts allow
    follow = docs.sparkSession.createDataFrame([(b, a) for a, b in zip(ranges, [*ranges[1:], *ranges[:1]], strict=True)], "bucket int, before int")
    guests = heads.join(F.broadcast(follow), "bucket").select(F.col("before").alias("bucket"), "head.doc_id", "head.text", F.lit(True).alias("guest"))
    ordered = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    placed = rows.select("bucket", "doc_id", "text", F.lit(False).alias("guest")).unionByName(guests)
    placed = placed.withColumns({"place": F.row_number().over(ordered), "next": F.lead("text").over(ordered), "ends": F.lead("guest").over(ordered)}).where("NOT guest")
    n = F.length("text")
    moved = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - moved), F.substring("next", F.lit(1), moved))
    two = placed.select("bucket", "place", "doc_id", n.cast("long").alias("n_chars"), "ends", F.explode(F.array(F.struct(F.lit(0).alias("edit"), F.col("text").alias("body")), F.struct(F.lit(1).alias("edit"), edited.alias("body")))).alias("v"))
    two = two.select("bucket", "place", "doc_id", "n_chars", "ends", "v.edit", F.col("v.body").alias("body"), F.when(F.col("v.edit") == 1, F.sha2("v.body", 256)).alias("sha"))
    marks = fingerprints(two, ["bucket", "place", "edit", "doc_id", "n_chars", "ends", "sha"], "body")
    one = marks.groupBy("bucket", "place").agg(*(F.max(c).alias(c) for c in ("doc_id", "n_chars", "ends", "sha")), F.max(F.when(F.col("edit") == 0, F.col("bits"))).alias("bits"), F.max(F.when(F.col("edit") == 1, F.col("bits"))).alias("edited_bits"))
    one = work.write(one, "marks")
    # The next document's fingerprint: one row further in the range, or the first of the next range.
    after = F.broadcast(follow.select(F.col("before").alias("bucket"), F.col("bucket").alias("range_after")))
    to = one.join(after, "bucket").select(F.when(F.col("ends"), F.col("range_after")).otherwise(F.col("bucket")).alias("to_bucket"), F.when(F.col("ends"), F.lit(1)).otherwise(F.col("place") + 1).alias("to_place"), "doc_id", "n_chars", "sha", "bits", "edited_bits")
    nexts = one.select(F.col("bucket").alias("to_bucket"), F.col("place").alias("to_place"), F.col("bits").alias("next_bits"))
    asked = F.coalesce(F.col("doc_id") % QUERIED == 0, F.lit(False))
    near = near_fingerprints(one.where(asked).select("bits"), one.select("bits"), radius).where("distance > 0").groupBy("query_bits").agg(F.count("*").alias("near_marks"))
    near = work.write(near, "near")
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    found = to.join(nexts, ["to_bucket", "to_place"]).join(near, asked & (F.col("bits") == F.col("query_bits")), "left")
    return found.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), digits("bits").alias("fingerprint"), digits("edited_bits").alias("edited_fingerprint"), likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"), likeness(F.col("bits"), F.col("next_bits")).alias("near_next"), F.when(asked, F.coalesce("near_marks", F.lit(0))).alias("near_marks"))


def _cuts(rows: DataFrame, per_range: int = 2000, most: int = 4096) -> list[int]:
    """Approximate quantiles of doc_id between ranges of about ``per_range`` rows; ``most`` cuts at most."""
    ranges = max(1, min(most, rows.select("doc_id").count() // per_range))
    if ranges == 1:
        return []
    found = rows.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    return sorted({int(c) for c in found or [] if c is not None})


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
