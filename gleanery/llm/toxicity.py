"""Toxicity scores from averaged subword embeddings and a linear softmax."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm.common import bounded_batches, packed, release, table, unpacked

BUCKETS = 1 << 16
WIDTH = 16
SHORTEST, LONGEST = 3, 5      # character n-grams of a word inside < and >
SLICE = 64                    # characters of a word looked at together; longer words are walked in slices
SAMPLE_ROWS = 4000            # labelled rows the classifier is fitted on, at most
EPOCHS = 16
BATCH = 32
RATE = 0.05
THRESHOLD = 0.3
WORD = re.compile(r"\w+")


def _buckets(grams: set[str]) -> tuple[int, ...]:
    return tuple(xxhash.xxh32_intdigest(g) % BUCKETS for g in sorted(grams))


@lru_cache(maxsize=1 << 14)
def word_features(word: str) -> tuple[int, ...]:
    """Bucket numbers of a word of at most SLICE characters and its character n-grams."""
    marked = f"<{word}>"
    grams = {
        marked[i:i + n]
        for n in range(SHORTEST, LONGEST + 1)
        for i in range(len(marked) - n + 1)
    }
    return _buckets(grams | {marked})


def long_word_features(word: str) -> Iterator[tuple[int, ...]]:
    """As ``word_features`` for a word of any length, slice by slice.

    Slices overlap by LONGEST - 1 characters and an n-gram belongs to the slice it
    starts in, so each place counts once; n-grams that repeat in a slice count once.
    """
    marked = f"<{word}>"
    step = SLICE - (LONGEST - 1)
    for start in range(0, len(marked), step):
        piece = marked[start:start + SLICE]
        yield _buckets({
            piece[i:i + n]
            for n in range(SHORTEST, LONGEST + 1)
            for i in range(min(step, len(piece) - n + 1))
        })
    yield _buckets({marked})


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of a text, BUCKETS at most; subwords of a word count as often as the word."""
    counts = Counter(WORD.findall(text.lower())) if text else Counter()
    total: Counter[int] = Counter()
    for word, n in counts.most_common():
        for features in [word_features(word)] if len(word) <= SLICE else long_word_features(word):
            for feature in features:
                total[feature] += n
    return np.array(list(total), np.int32), np.array(list(total.values()), np.int32)


@dataclass
class Model:
    """Embeddings per bucket and a two-class linear softmax on their average."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def __post_init__(self):
        self._word = lru_cache(maxsize=1 << 17)(self._word_logits)

    def __reduce__(self):
        return Model, (self.vectors, self.weights, self.bias)

    def _word_logits(self, word: str) -> tuple[float, int]:
        # kept as a number, not as features
        parts = [word_features.__wrapped__(word)] if len(word) <= SLICE else long_word_features(word)
        logit, size = 0.0, 0
        for features in parts:
            logit += float(self._margin[list(features)].sum())
            size += len(features)
        return logit, size

    @property
    def _margin(self) -> np.ndarray:
        if not hasattr(self, "_projected"):
            self._projected = self.vectors @ (self.weights[1] - self.weights[0])
        return self._projected

    def score(self, text: str | None) -> float:
        """Probability of label 1; a text without words has the softmax of the bias.

        Averaging and the softmax's linear part commute, so words are projected once.
        """
        total, size = 0.0, 0
        for word, n in Counter(WORD.findall(text.lower()) if text else ()).items():
            # only short words are kept, so the cache is bounded
            logit, features = (self._word if len(word) <= SLICE else self._word_logits)(word)
            total += n * logit
            size += n * features
        margin = (total / size if size else 0.0) + float(self.bias[1] - self.bias[0])
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def fit(bags: Sequence[tuple[Sequence[int], Sequence[int]]], labels: list[int], seed: int = 7) -> Model:
    """Train embeddings and softmax jointly by Adagrad on the log loss.

    Without rows of both labels the score is the share of label 1, constant.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    weights, bias = random.normal(0, 0.1, (2, WIDTH)), np.zeros(2)
    y = np.array(labels, np.int64)
    rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
    bias[1] = np.log(rate / (1 - rate))
    if len(set(labels)) < 2:
        return Model(vectors, np.zeros((2, WIDTH)), bias)
    rows = [(np.asarray(f, np.int32), (np.asarray(c) / max(1, np.sum(c))).astype(np.float32)) for f, c in bags]
    seen, seen_weights, seen_bias = np.full(BUCKETS, 1e-8), np.full((2, WIDTH), 1e-8), np.full(2, 1e-8)
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            picked = order[start:start + BATCH]
            lengths = np.array([len(rows[i][0]) for i in picked])
            features = np.concatenate([rows[i][0] for i in picked])
            shares = np.concatenate([rows[i][1] for i in picked])
            owner = np.repeat(np.arange(len(picked)), lengths)
            used, inverse = np.unique(features, return_inverse=True)
            mixture = np.zeros((len(picked), len(used)))
            mixture[owner, inverse] = shares
            means = mixture @ vectors[used]
            logits = means @ weights.T + bias
            logits -= logits.max(axis=1, keepdims=True)
            wrong = np.exp(logits)
            wrong /= wrong.sum(axis=1, keepdims=True)
            wrong[np.arange(len(picked)), y[picked]] -= 1
            wrong /= len(picked)
            down = mixture.T @ (wrong @ weights)
            up, up_bias = wrong.T @ means, wrong.sum(axis=0)
            seen[used] += (down * down).mean(axis=1)
            vectors[used] -= RATE * 4 * down / np.sqrt(seen[used])[:, None]
            seen_weights += up * up
            weights -= RATE * up / np.sqrt(seen_weights)
            seen_bias += up_bias * up_bias
            bias -= RATE * up_bias / np.sqrt(seen_bias)
    return Model(vectors.astype(np.float32), weights, bias)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents, chosen by a hash of doc_id.

    Rows with crc32(doc_id) mod 4 = 2 are held out. A document labelled more than
    once is toxic if any label says so; null labels and ids do not count.
    """
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )

    @F.arrow_udf("struct<features:array<int>,counts:array<int>>")
    def bags(texts: pa.Array) -> pa.Array:
        found = [bag(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.int32()))],
            names=["features", "counts"],
        )

    sample = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(rows)
        .select(F.col("toxic").cast("int").alias("toxic"), bags("text").alias("bag"))
    )

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, marks = [], []
        for batch in batches:
            marks += batch.column(0).to_pylist()
            features, counts = batch.column(1).field(0), batch.column(1).field(1)
            found += [(features[i].values.to_numpy(), counts[i].values.to_numpy()) for i in range(len(batch))]
        model = pickle.dumps(fit(found, marks))
        found.clear()
        word_features.cache_clear()
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    # one task holds the sample, whose size is bounded; the driver gets the model alone
    learned = sample.coalesce(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(learned["model"]) if learned else fit([], [])   # an empty plan has no task


def score_column(spark: SparkSession, model: Model, text: str = "text") -> F.Column:
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x WIDTH floats, whatever the input

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        release()
        return pa.array([shared.value.score(t) for t in texts.to_pylist()], pa.float64())

    return score(F.col(text))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``_score``, the probability of being toxic.

    Only the text is an input. Every row of any text, null and empty included, gets a
    score between 0 and 1; equal texts get equal scores. All n-grams of a word count,
    however long it is, so text without spaces is scored to its end.
    """
    bounded_batches(docs.sparkSession)
    return docs.withColumn("_score", score_column(docs.sparkSession, train(docs, labels)))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below ``THRESHOLD``, all columns kept."""
    clean = scored(packed(docs, "doc_id", "text"), labels).where(F.col("_score") < THRESHOLD)
    return unpacked(clean, docs.columns, "doc_id", "text")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return scored(docs.select("doc_id", "text"), labels).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
