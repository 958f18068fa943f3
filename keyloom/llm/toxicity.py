"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word (lower case, between ``<`` and ``>``) is the mean of the vectors of its subwords:
the whole word and its byte n-grams of :data:`GRAMS`, hashed into :data:`BUCKETS` rows of one
embedding matrix.  A text is the mean of its words' vectors, over all its words, and a
linear softmax over two classes follows.  Embeddings and softmax are trained together by
full-batch Adam on a bounded sample of labelled texts.  A misspelling of a word shares
most of its n-grams, so it gets a like vector without having been seen.

As everything after the embeddings is linear, a trained model scores with one number for
each bucket, which is all that executors get.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import chunks, filled, mix, split_words

BUCKET_BITS, DIM, GRAMS = 18, 8, (3, 6, 8)
BUCKETS = 1 << BUCKET_BITS
#: Labelled texts that a model is fitted on at most, taken by a hash of their doc_id.
SAMPLE = 5000
STEPS, RATE, DECAY = 120, 0.2, 1e-6
#: Words of fewer texts aren't trained on; they are scored by their subwords.
LEAST_TEXTS = 4
#: Added to Adam's denominator: buckets whose gradients are far below it hardly move, so what single texts suggest isn't learnt.
FLOOR = 1e-4
#: A score of at least this is predicted toxic.
THRESHOLD = 0.3
_SCALE = 100.0


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of every subword of the given words: the word each belongs to and its row."""
    marked = pc.binary_join_element_wise(pa.scalar("<", pa.large_string()), words.cast(pa.large_string()), pa.scalar(">", pa.large_string()), pa.scalar("", pa.large_string()))
    _, offsets, data = marked.buffers()
    at = np.frombuffer(offsets, np.int64)[marked.offset : marked.offset + len(marked) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]].astype(np.uint64) + np.uint64(1)
    at = at - at[0]
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(at))
    left = at[1:][owner] - np.arange(len(raw))
    owners, buckets = [], []
    with np.errstate(over="ignore"):
        h = raw * np.uint64(0x9E3779B97F4A7C15)
        for n in range(2, max(GRAMS) + 1):
            m = len(raw) - n + 1
            if m <= 0:
                break
            h = (h[:m] * np.uint64(0x100000001B3)) ^ (raw[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F))
            if n in GRAMS:
                fits = left[:m] >= n
                owners.append(owner[:m][fits])
                buckets.append((mix(h[fits] + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(mix(raw + np.arange(len(raw), dtype=np.uint64) * np.uint64(0) + np.uint64(77)) * (np.arange(len(raw), dtype=np.uint64) - at[:-1].astype(np.uint64)[owner] + np.uint64(1)), out=sums[1:])
        whole = mix(sums[at[1:]] - sums[at[:-1]])
    owners.append(np.arange(len(words), dtype=np.int32))
    buckets.append((whole >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass
class Model:
    """What scoring needs: each bucket's part of the log odds, and the rest of them."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The probability of label 1 for each text; texts without words get that of the bias alone."""
        out = np.zeros(len(texts))
        for a, b in chunks(texts):
            flat, at = split_words(pc.utf8_lower(texts.slice(a, b - a)))
            if len(flat):
                coded = flat.dictionary_encode()
                owner, bucket = subwords(coded.dictionary)
                n = len(coded.dictionary)
                word = np.bincount(owner, self.weight[bucket], n) / np.bincount(owner, minlength=n)
                sums = np.concatenate(([0.0], np.cumsum(word[coded.indices.to_numpy()])))
                out[a:b] = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, np.diff(at))
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def fit(texts: pa.Array, labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> Model:
    """Trains embeddings and softmax together.  Without texts of both labels the model gives the labels' mean (0 without any)."""
    labels = np.asarray(labels, np.int64)
    if len(np.unique(labels)) < 2:
        mean = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(BUCKETS), 30.0 if mean else -30.0)
    flat, at = split_words(pc.utf8_lower(filled(texts)))
    coded = flat.dictionary_encode()
    n_words, n_texts = len(coded.dictionary), len(labels)
    # Texts as rows of word counts, of the words that several texts have; each count is over all of its text's words.
    key = np.repeat(np.arange(n_texts), np.diff(at)) * np.int64(n_words) + coded.indices.to_numpy()
    key, count = np.unique(key, return_counts=True)
    text, word = (key // n_words).astype(np.int32), (key % n_words).astype(np.int32)
    shared = np.bincount(word, minlength=n_words) >= LEAST_TEXTS
    use = shared[word]
    text, word, count = text[use], (np.cumsum(shared) - 1)[word[use]], count[use]
    amount = count / np.maximum(1, np.diff(at))[text]
    owner, bucket = subwords(coded.dictionary.filter(pa.array(shared)))
    n_words = int(shared.sum())
    share = 1 / np.maximum(1, np.bincount(owner, minlength=n_words))
    rng = np.random.default_rng(seed)
    params = {"e": rng.normal(0, 0.1, (BUCKETS, DIM)), "w": rng.normal(0, 0.5, (DIM, 2)), "b": np.zeros(2)}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    for step in range(1, steps + 1):
        # Of a softmax over two classes only the difference of the logits matters, and the gradients are each other's negatives.
        odds = params["e"] @ (params["w"][:, 1] - params["w"][:, 0])
        per_word = np.bincount(owner, odds[bucket], n_words) * share
        logit = np.bincount(text, per_word[word] * amount, n_texts) * _SCALE + params["b"][1] - params["b"][0]
        back = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / n_texts
        per_word = np.bincount(word, back[text] * amount, n_words) * share * _SCALE
        r = np.bincount(bucket, per_word[owner], BUCKETS)
        r = np.stack([-r, r], axis=1)
        grads = {"e": r @ params["w"].T + DECAY * params["e"], "w": params["e"].T @ r, "b": np.array([-back.sum(), back.sum()])}
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            params[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + FLOOR)
    mapped = params["e"] @ params["w"]
    return Model((mapped[:, 1] - mapped[:, 0]) * _SCALE, float(params["b"][1] - params["b"][0]))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits a model on at most ``sample`` of the labelled rows outside the held-out quarter, spread by a hash of doc_id; of rows with one doc_id the least text."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The sample's ids are bounded by the parameter, so they may be broadcast and the texts collected.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy("doc_id").limit(sample).select("text", "toxic").toArrow()
    return fit(filled(rows.column("text")), rows.column("toxic").to_numpy())


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(filled(batch.column(batch.schema.get_field_index("keyloom_text"))))
            columns = [c for c in batch.schema.names if c != "keyloom_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(scores)], names=[*columns, "keyloom_score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and keyloom_score, the probability that the row's whole text is toxic.  Null texts count as empty."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("keyloom_score", DoubleType())])
    return docs.withColumn("keyloom_text", F.col("text").cast("string")).mapInArrow(_score(model), schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``, by a model trained on ``labels`` (doc_id, toxic).

    Only text enters a score; doc_id, lang, source and labels don't.  Null and blank texts
    get the score of the bias.  Rows come back as often as they came.  Labels other than 0
    and 1 are ignored, a document labelled both counts as toxic.  Without labels of both
    kinds the score is the one kind's, 0 without any.  Other columns are ignored.
    """
    model = train(docs, labels, sample)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("keyloom_score").alias("score"), (F.col("keyloom_score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    return score(docs, train(docs, labels, sample)).where(F.col("keyloom_score") < threshold).drop("keyloom_score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
