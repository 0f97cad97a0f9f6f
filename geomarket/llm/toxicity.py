"""Toxicity by multiple-instance learning: a document is toxic when at least one sentence is.

Only documents are labelled. Each sentence gets a logistic score from the character
n-grams in it; a document's score is the noisy-or of its sentences, and the weights are
trained on the documents' labels through it. The same weights then locate the sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomarket.llm.tables import written
from geomarket.llm.tasks import fields, rows_from, with_columns
from geomarket.llm.words import ALPHANUMERIC, Chunk, byte_class, chunks, mix

# Labelled documents that the model is fitted on, at most; the lowest hashes of their ids.
SAMPLE = 20_000
# n-grams of the model at most, and how surely each must go with toxic documents.
FEATURES, LEAST_CHI2 = 4096, 30.0
NGRAM, BUCKET_BITS = 5, 20
STEPS, LEARNING_RATE, DECAY = 300, 0.1, 1e-4

_ENDS = byte_class(b".!?\n")


class Model(NamedTuple):
    buckets: np.ndarray
    weights: np.ndarray
    bias: float


class Sentences(NamedTuple):
    row: np.ndarray  # the text of each sentence that has a byte other than an end
    start: np.ndarray
    end: np.ndarray


def sentences(chunk: Chunk) -> Sentences:
    """Maximal runs without a full stop, exclamation mark, question mark or line break."""
    inside = ~_ENDS[chunk.data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[chunk.offsets[:-1][chunk.offsets[:-1] < len(inside)]] = False
    after[chunk.offsets[1:][chunk.offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Sentences(np.searchsorted(chunk.offsets, start, side="right") - 1, start, end)


def ngrams(chunk: Chunk, found: Sentences) -> tuple[np.ndarray, np.ndarray]:
    """Sentence and bucket of each n-gram of lower-case bytes.

    What is no word character counts as a space, and so does what stands around a sentence.
    """
    n = len(chunk.data) + chunk.rows + 1
    at = np.arange(len(chunk.data)) + np.repeat(np.arange(1, chunk.rows + 1), np.diff(chunk.offsets))
    plain = np.full(n, 32, dtype=np.uint64)
    plain[at] = np.where(ALPHANUMERIC[chunk.data], chunk.data, 32)
    upper = (plain >= 65) & (plain <= 90)
    plain[upper] += np.uint64(32)
    begins = np.zeros(len(chunk.data), dtype=np.int64)
    begins[found.start] = 1
    sentence = np.full(n, -1, dtype=np.int64)
    sentence[at] = np.where(_ENDS[chunk.data], -1, np.cumsum(begins) - 1)
    if n < NGRAM:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    code = np.zeros(n - NGRAM + 1, dtype=np.uint64)
    for k in range(NGRAM):
        code = (code << np.uint64(8)) | plain[k:n - NGRAM + 1 + k]
    # The first and last byte may be the ends around the sentence; what is between is in it.
    second, last = sentence[1:n - NGRAM + 2], sentence[NGRAM - 2:n - 1]
    good = (second >= 0) & (second == last)
    return second[good], (mix(code[good]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def training_rows(labels: DataFrame) -> Column:
    """Whether a labelled row may be learned from: the checksum of its id is no multiple of five."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def _associated(sample: DataFrame) -> np.ndarray:
    """The buckets that go most surely with toxic documents."""
    out = fields(bucket="int", toxic="long", other="long")

    def produce(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(0)):
                found = sentences(chunk)
                sentence, bucket = ngrams(chunk, found)
                pairs = np.unique((found.row[sentence] << BUCKET_BITS) | bucket)
                row, bucket = pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)
                label = toxic[chunk.first + row]
                for side in (0, 1):
                    counts[side] += np.bincount(bucket[label == 1 - side], minlength=1 << BUCKET_BITS)
        some = np.flatnonzero(counts.sum(axis=0))
        yield {"bucket": pa.array(some, pa.int32()), "toxic": pa.array(counts[0][some]),
               "other": pa.array(counts[1][some])}

    counted = rows_from(sample.select("text", "toxic"), produce, out).groupBy("bucket").agg(
        F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    totals = sample.agg(F.sum("toxic").cast("double").alias("t"), F.count("*").cast("double").alias("n"))
    scored = counted.join(F.broadcast(totals), F.lit(True)).where("a * (n - t) > b * t").withColumn(
        "chi2", F.expr("n * pow(a * (n - t - b) - b * (t - a), 2) / (t * (n - t) * (a + b) * (n - a - b))"))
    best = scored.where(F.coalesce("chi2", F.lit(float("inf"))) >= LEAST_CHI2).orderBy(F.desc("chi2"), "bucket")
    return np.sort(np.array([r.bucket for r in best.limit(FEATURES).select("bucket").collect()], dtype=np.int64))


def _instances(sample: DataFrame, buckets: np.ndarray) -> DataFrame:
    """Per sampled document: its label, its number of sentences, and which sentence has which feature."""
    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        index = np.full(1 << BUCKET_BITS, -1, dtype=np.int64)
        index[buckets] = np.arange(len(buckets))
        n, pairs = np.zeros(len(batch), dtype=np.int64), [[] for _ in range(len(batch))]
        for chunk in chunks(batch.column(batch.schema.names.index("text"))):
            found = sentences(chunk)
            counts = np.bincount(found.row, minlength=chunk.rows)
            n[chunk.first:chunk.first + chunk.rows] = counts
            begins = np.cumsum(counts) - counts
            sentence, bucket = ngrams(chunk, found)
            feature = index[bucket]
            sentence, feature = sentence[feature >= 0], feature[feature >= 0]
            for s, f in np.unique(np.stack([sentence, feature], axis=1), axis=0).tolist():
                row = int(found.row[s])
                pairs[chunk.first + row].append((s - int(begins[row])) * FEATURES + f)
        return {"n_sentences": pa.array(n), "pairs": pa.array(pairs, pa.list_(pa.int64()))}

    return with_columns(sample.select("text", "toxic"), compute, fields(n_sentences="long", pairs="longs")).drop("text")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the weights on at most ``sample`` labelled documents, one text for each id."""
    usable = labels.where("toxic is not null").where(training_rows(labels)).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` ids are broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    rows = written(rows.select("text", F.col("toxic").cast("long").alias("toxic")), "toxicity-sample")
    buckets = _associated(rows)
    table = _instances(rows, buckets).toArrow()
    label, n = table["toxic"].to_numpy(), table["n_sentences"].to_numpy()
    pairs = table["pairs"].combine_chunks() if len(table) else pa.array([], pa.list_(pa.int64()))
    owner = np.repeat(np.arange(len(label)), pairs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = pairs.flatten().to_numpy()
    return Model(buckets, *_fit(label, n, owner, flat // FEATURES, flat % FEATURES, len(buckets)))


def _fit(label: np.ndarray, n: np.ndarray, owner: np.ndarray, sentence: np.ndarray, feature: np.ndarray,
         size: int) -> tuple[np.ndarray, float]:
    """Gradient descent on the log loss of the noisy-or; sentences without a feature share one score."""
    keys, instance = np.unique(owner * (sentence.max(initial=0) + 1) + sentence, return_inverse=True)
    doc = keys // (sentence.max(initial=0) + 1)
    plain = n - np.bincount(doc, minlength=len(n))
    weights, bias = np.zeros(size + 1), -5.0
    weights[-1] = bias
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        z = weights[-1] + np.bincount(instance, weights=weights[feature], minlength=len(doc))
        log_none = np.logaddexp(0, weights[-1])  # minus the log of the chance that a plain sentence is not toxic
        total = plain * log_none + np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(n)) + 1e-9
        slope = np.where(label == 1, -1 / np.expm1(np.minimum(total, 50)), 1.0) / max(1, len(n))
        each = slope[doc] / (1 + np.exp(-z))
        gradient = np.bincount(feature, weights=each[instance], minlength=size + 1) + DECAY * weights / max(1, len(n))
        gradient[-1] = each.sum() + (slope * plain).sum() / (1 + np.exp(-weights[-1]))
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient ** 2
        weights -= LEARNING_RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return weights[:-1], float(weights[-1])


def _sentence_scores(chunk: Chunk, table: np.ndarray, bias: float) -> tuple[Sentences, np.ndarray]:
    found = sentences(chunk)
    sentence, bucket = ngrams(chunk, found)
    weight = table[bucket]
    some = np.flatnonzero(weight)
    once, at = np.unique((sentence[some] << BUCKET_BITS) | bucket[some], return_index=True)
    return found, bias + np.bincount(once >> BUCKET_BITS, weights=weight[some][at], minlength=len(found.row))


def _table(model: Model) -> np.ndarray:
    table = np.zeros(1 << BUCKET_BITS)
    table[model.buckets] = model.weights
    return table


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score``, the noisy-or over all sentences of the whole text; null and empty texts have score 0.

    Rows are scored each by their text alone, so repeated rows get equal scores; a column
    of that name is replaced; an empty table gives no rows.
    """
    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        table, scores = _table(model), np.zeros(len(batch))
        for chunk in chunks(batch.column(batch.schema.names.index(text))):
            found, z = _sentence_scores(chunk, table, model.bias)
            none = np.bincount(found.row, weights=np.logaddexp(0, z), minlength=chunk.rows)
            scores[chunk.first:chunk.first + chunk.rows] = 0.0 - np.expm1(-none)
        return {"score": pa.array(scores)}

    return with_columns(docs, compute, fields(score="double"))


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The offending sentences: doc_id, start and end in bytes of UTF-8, score."""
    def produce(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = _table(model)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                found, z = _sentence_scores(chunk, table, model.bias)
                bad = np.flatnonzero(1 / (1 + np.exp(-z)) >= least)
                begin = chunk.offsets[found.row[bad]]
                yield {"doc_id": batch.column(0).take(pa.array(found.row[bad] + chunk.first)),
                       "start": pa.array(found.start[bad] - begin), "end": pa.array(found.end[bad] - begin),
                       "score": pa.array(1 / (1 + np.exp(-z[bad])))}

    return rows_from(docs.select(F.col("doc_id").cast("long"), "text"), produce,
                     fields(doc_id="long", start="long", end="long", score="double"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents below the threshold, with their own columns."""
    mine = docs.select(F.struct("*").alias("document"), F.col("text").alias("text"))
    kept = score(mine, train(docs, labels)).where(F.col("score") < threshold)
    return kept.select([F.col("document").getField(c).alias(c) for c in docs.columns])


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; a null id is not held out."""
    held_out = F.coalesce(~training_rows(docs), F.lit(False))
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
