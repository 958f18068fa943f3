"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text gets a few ratios.  KLL sketches of each ratio and of the texts' lengths are kept
for every language and source; sketches merge, so a source with few documents falls back to
its language's merged sketches and a rare language to the merge of all.  A text is rejected
where a ratio lies beyond its group's upper fence: a high quantile plus several times the
spread below it.  Where most of a group's texts have the same ratio that spread is nothing;
the spread then is what one occurrence makes in the group's median text, by its length
sketches, so that one odd character doesn't reject a text.  No fence is a constant.
Texts with too few words or mostly repeated phrases are rejected by the base rule.

KLL sketches choose what they keep at random: a ratio that lies within a sketch's rank
error (about 1.3 %) of its fence may be judged differently in another run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import chunks, filled, mix, split_words
from .workspace import Workspace

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEATED_PERCENT = 50, 50
#: Documents from which a group's own sketch is used.
GROUP = 200
#: Fence: the quantile HIGH plus SPREADS times its distance from the median, which counts as one occurrence in the median text at least.
#: A group may hold a share 1 - HIGH of junk before its own junk moves the fence.
HIGH, SPREADS = 0.85, 8.0
RATIOS = ["symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "shout_ratio", "word_chars_mean"]
LENGTHS = ["n_words", "n_lines", "word_chars"]
#: A phrase that occurs again makes this many repeated words: three here, three there.
REPEATED_AT_ONCE = 6
#: Groups up to which fences are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000

_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_COUNTED = [*_BASE, "n_lines", "n_upper", "n_shouts"]


def _repeats(groups: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each position, whether the same (group, codes) comes more than once; hash neighbours are compared in full."""
    with np.errstate(over="ignore"):
        h = mix(groups.astype(np.uint64) + np.uint64(1))
        for c in codes.T:
            h = mix(h * np.uint64(0x100000001B3) ^ c.astype(np.uint64))
    order = np.argsort(h, kind="stable")
    equal = np.zeros(len(h), bool)
    if len(h) > 1:
        a, b = order[1:], order[:-1]
        equal[1:] = (h[a] == h[b]) & (groups[a] == groups[b]) & (codes[a] == codes[b]).all(axis=1)
    twice = equal.copy()
    twice[:-1] |= equal[1:]
    out = np.zeros(len(h), bool)
    out[order] = twice
    return out


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[at[1:]] - sums[at[:-1]]


def _byte_counts(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(len(texts), np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return _per_text(table[raw], at - at[0])


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int8)
    table[list(chars.encode())] = 1
    return table


_SYMBOL, _UPPER, _SHOUT = _class(SYMBOLS), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("!?")
# Bytes that start a code point outside white space.
_VISIBLE = np.array([int(b & 0xC0 != 0x80 and b not in b" \t\n\v\f\r") for b in range(256)], np.int8)


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counted columns of each text of a null-free large string array."""
    out = {c: np.zeros(len(texts), np.int64) for c in _COUNTED}
    for a, b in chunks(texts):
        part = texts.slice(a, b - a)
        words, at = split_words(part)
        n = np.diff(at)
        out["n_words"][a:b] = n
        out["word_chars"][a:b] = _byte_counts(part, _VISIBLE)
        out["n_symbols"][a:b] = _byte_counts(part, _SYMBOL)
        out["n_upper"][a:b] = _byte_counts(part, _UPPER)
        out["n_shouts"][a:b] = _byte_counts(part, _SHOUT)
        lists = pc.split_pattern(part, "\n")
        lines, lat = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        lat = lat - lat[0]
        owner = np.repeat(np.arange(b - a), np.diff(lat))
        worded = np.diff(split_words(lines)[1]) > 0
        out["n_lines"][a:b] = _per_text(worded, lat)
        code, group = lines.dictionary_encode().indices.to_numpy().astype(np.int64)[worded], owner[worded]
        _, first = np.unique(group * np.int64(len(lines) + 1) + code, return_index=True)
        out["n_dup_lines"][a:b] = out["n_lines"][a:b] - np.bincount(group[first], minlength=b - a)
        if len(words) >= 3:
            owner = np.repeat(np.arange(b - a), n)
            code = words.dictionary_encode().indices.to_numpy()
            inside = owner[2:] == owner[:-2]
            start = np.flatnonzero(inside)
            twice = start[_repeats(owner[start], np.stack([code[start], code[start + 1], code[start + 2]], axis=1))]
            covered = np.zeros(len(words), bool)
            for j in range(3):
                covered[twice + j] = True
            out["n_repeat_words"][a:b] = _per_text(covered, at)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = counts(filled(batch.column(batch.schema.get_field_index("keyloom_text"))))
        keep = [c for c in batch.schema.names if c != "keyloom_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *(pa.array(found[c]) for c in _COUNTED)], names=[*keep, *(f"keyloom_{c}" for c in _COUNTED)])


def _counted(rows: DataFrame) -> DataFrame:
    """All columns of the rows, and the counts of their texts under a prefix of their own."""
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*rows.schema.fields, *(StructField(f"keyloom_{c}", LongType()) for c in _COUNTED)])
    return rows.withColumn("keyloom_text", F.col("text").cast("string")).mapInArrow(_count, schema)


def _ratios() -> dict[str, F.Column]:
    words = F.greatest(F.lit(1), F.col("keyloom_n_words"))
    chars = F.greatest(F.lit(1), F.col("keyloom_word_chars"))
    return {
        "symbol_ratio": F.col("keyloom_n_symbols") / words,
        "dup_line_ratio": F.col("keyloom_n_dup_lines") / F.greatest(F.lit(1), F.col("keyloom_n_lines")),
        "repeat_ratio": F.col("keyloom_n_repeat_words") / words,
        "upper_ratio": F.col("keyloom_n_upper") / chars,
        "shout_ratio": F.col("keyloom_n_shouts") / words,
        "word_chars_mean": F.col("keyloom_word_chars") / words,
    }


def base_failed() -> F.Column:
    return (F.col("keyloom_n_words") < LEAST_WORDS) | (F.col("keyloom_n_repeat_words") * 100 > F.col("keyloom_n_words") * REPEATED_PERCENT)


def sketches(counted: DataFrame) -> DataFrame:
    """(keyloom_lang, keyloom_source, n, one KLL sketch for each ratio and length) of the texts that pass the base rule; sketches may be stored and merged later."""
    lengths = (F.greatest(F.lit(1), F.col(f"keyloom_{name}")).cast("double").alias(name) for name in LENGTHS)
    values = counted.where(~base_failed()).select(F.col("keyloom_lang"), F.col("keyloom_source"), *(c.alias(name) for name, c in _ratios().items()), *lengths)
    return values.groupBy("keyloom_lang", "keyloom_source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(name).alias(name) for name in (*RATIOS, *LENGTHS)))


def _least_spreads(median) -> dict[str, F.Column]:
    """What one occurrence makes of each ratio in a text of median length."""
    words, lines, chars = (median(name) for name in LENGTHS)
    once = F.lit(1.0) / words
    return {"symbol_ratio": once, "dup_line_ratio": F.lit(1.0) / lines, "repeat_ratio": REPEATED_AT_ONCE * once, "upper_ratio": F.lit(1.0) / chars, "shout_ratio": once, "word_chars_mean": median("word_chars_mean") * once}


def fences(kept: DataFrame) -> DataFrame:
    """The upper fence of each ratio for every language and source, from their sketches."""
    merged = lambda *by: kept.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(name).alias(name) for name in (*RATIOS, *LENGTHS)))

    def fence(df: DataFrame, mark: str, by: list[str]) -> DataFrame:
        quantile = lambda name, rank: F.kll_sketch_get_quantile_double(name, F.lit(rank))
        median = lambda name: quantile(name, 0.5)
        least = _least_spreads(median)
        return df.select(*by, F.struct(F.col("n"), *((quantile(name, HIGH) + SPREADS * F.greatest(least[name], quantile(name, HIGH) - median(name))).alias(name) for name in RATIOS)).alias(mark))

    groups = fence(kept, "own", ["keyloom_lang", "keyloom_source"])
    langs = fence(merged("keyloom_lang"), "lang", [F.col("keyloom_lang").alias("of_lang")])
    everything = fence(merged(), "all", [])
    joined = groups.join(langs, F.col("keyloom_lang").eqNullSafe(F.col("of_lang")), "left").crossJoin(everything)  # one row
    pick = lambda name: F.when(F.col("own.n") >= GROUP, F.col(f"own.{name}")).when(F.col("lang.n") >= GROUP, F.col(f"lang.{name}")).otherwise(F.col(f"all.{name}"))
    return joined.select(F.col("keyloom_lang").alias("fence_lang"), F.col("keyloom_source").alias("fence_source"), *(pick(name).alias(f"fence_{name}") for name in RATIOS))


def _judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds keyloom_base_failed and keyloom_kept."""
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_GROUPS else limits
    joined = counted.join(limits, F.col("keyloom_lang").eqNullSafe(F.col("fence_lang")) & F.col("keyloom_source").eqNullSafe(F.col("fence_source")), "left")
    within = F.lit(True)
    for name, ratio in _ratios().items():
        # A group of which no text passes the base rule has no fence; its texts fail anyway.
        within = within & F.coalesce(ratio <= F.col(f"fence_{name}"), F.lit(True))
    return joined.withColumn("keyloom_base_failed", base_failed()).withColumn("keyloom_kept", ~base_failed() & within)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each row's whole text: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Takes doc_id, text, lang and source, other columns are ignored.  Null texts are empty
    and fail the base rule; null languages and sources are groups like others.  Rows come
    back as often as they came.
    """
    work = Workspace(docs.sparkSession, "quality")
    rows = docs.select("doc_id", "text", F.col("lang").alias("keyloom_lang"), F.col("source").alias("keyloom_source"))
    counted = work.write(_counted(rows).drop("text"), "counted")
    limits = work.write(fences(sketches(counted)), "fences")
    return _judged(counted, limits).select("doc_id", *(F.col(f"keyloom_{c}").alias(c) for c in _BASE), F.col("keyloom_base_failed").alias("base_failed"), F.col("keyloom_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    # The counts are written beside the rows, so that each text is counted once and sketches read counts only.
    work = Workspace(docs.sparkSession, "quality_keep")
    counted = work.write(_counted(docs.withColumns({"keyloom_lang": F.col("lang"), "keyloom_source": F.col("source")})), "counted")
    limits = work.write(fences(sketches(counted)), "fences")
    return _judged(counted, limits).where("keyloom_kept").select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


__all__ = ["counts", "fences", "keep_good", "op8_quality_rules", "quality_rules", "sketches"]
