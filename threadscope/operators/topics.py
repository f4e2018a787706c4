"""Topic model: TF-IDF vectors, LDA, topic terms and assignment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import IDF, CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.operators.words import KNOWN_WORDS, corpus_vocabulary, grams
from threadscope.session import scratch_path


@dataclass(frozen=True)
class TopicModel:
    features: PipelineModel
    lda: Model
    vocabulary: list[str]


@dataclass(frozen=True)
class BatchTopicModel:
    """Topic-word weights (topics x words) of the variational posterior, and the perplexity bound before each step."""

    features: PipelineModel
    weights: np.ndarray
    prior: float
    vocabulary: list[str]
    perplexities: tuple[float, ...]


def _grams(df: DataFrame, tokens: str, max_n: int, vocabulary: list[str]) -> DataFrame:
    """Add the n-grams made of words of the vocabulary; others cannot be terms of it."""
    known = sorted({word for term in vocabulary for word in term.split(" ")})
    return df.withColumn("_grams", grams(tokens, max_n, known if 0 < len(known) <= KNOWN_WORDS else None))


def fit_topics(df: DataFrame, k: int = 10, max_iter: int = 100, tokens: str = "tokens", vocab_size: int = 1000,
               min_df: float = 5, max_df: float = 0.7, max_n: int = 2, seed: int = 42) -> TopicModel:
    """Online variational LDA over TF-IDF of words and word pairs. Posts without tokens take no part."""
    features, vectors = _fit_features(df.filter(F.size(tokens) > 0), tokens, max_n, vocab_size, min_df, max_df)
    lda = LDA(k=k, maxIter=max_iter, seed=seed, optimizer="online", featuresCol="_features",
              topicDistributionCol="_topics").fit(vectors)
    return TopicModel(features, lda, features.stages[0].vocabulary)


def _fit_features(rows: DataFrame, tokens: str, max_n: int, vocab_size: int, min_df: float,
                  max_df: float) -> tuple[PipelineModel, DataFrame]:
    """Counts and inverse document frequencies of the vocabulary, and the vectors of the rows. The counts are saved, so that
    neither the frequencies nor the steps of a model go over the texts again."""
    spark = rows.sparkSession
    if min_df < 1 or max_df > 1:
        posts = rows.count()
        min_df, max_df = min_df * posts if min_df < 1 else min_df, max_df / max(1, posts) if max_df > 1 else max_df
    vocab = corpus_vocabulary(rows, vocab_size, min_df, max_df, tokens, max_n, as_numbers=True)
    terms = [r["term"] for r in vocab.orderBy(F.desc("cf"), "term").collect()]  # at most ``vocab_size``
    if not terms:
        raise ValueError("no term is in as many posts as asked")
    counts = CountVectorizerModel.from_vocabulary(terms, inputCol="_grams", outputCol="_tf")
    path = scratch_path(spark, "topic-counts")
    counts.transform(_grams(rows, tokens, max_n, terms)).select("_tf").write.parquet(path)
    saved = spark.read.parquet(path)
    idf = IDF(inputCol="_tf", outputCol="_features").fit(saved)
    return PipelineModel([counts, idf]), idf.transform(saved)


def fit_topics_batch(df: DataFrame, k: int = 10, max_iter: int = 100, tokens: str = "tokens", vocab_size: int = 1000,
                     min_df: float = 5, max_df: float = 0.7, max_n: int = 2, seed: int = 42,
                     tolerance: float = 0.0) -> BatchTopicModel:
    """Batch variational LDA (Hoffman, Blei and Bach 2010): every step reads all posts. Posts without tokens take no part.

    Vectors are saved once. In a step each task infers the topics of its posts from the weights so far, 80 kB for 10
    topics and 1,000 words, and sends one row of sums per topic; those rows are added in two levels, and only topics x
    words numbers reach the driver. Both priors are 1/k. It stops early once the perplexity bound falls by less than
    the share ``tolerance`` (0: never).
    """
    features, rows = _fit_features(df.filter(F.size(tokens) > 0), tokens, max_n, vocab_size, min_df, max_df)
    vocabulary = features.stages[0].vocabulary
    path = scratch_path(df.sparkSession, "topic-vectors")
    rows.select(*_sparse()).write.parquet(path)
    vectors = df.sparkSession.read.parquet(path)
    mass = vectors.agg(F.sum(F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x))).first()[0] or 0.0

    prior = 1.0 / k
    weights = np.random.RandomState(seed).gamma(100.0, 0.01, (k, len(vocabulary)))
    seen: list[float] = []
    for _ in range(max_iter):
        log_words = _expected_log(weights)
        sums, bound = _step_sums(vectors, np.exp(log_words), prior)
        seen.append(math.exp(-(bound + _prior_bound(weights, log_words, prior)) / mass) if mass else 1.0)
        weights = prior + sums * np.exp(log_words)
        if len(seen) > 1 and seen[-2] - seen[-1] < tolerance * seen[-2]:
            break
    return BatchTopicModel(features, weights, prior, vocabulary, tuple(seen))


def _sparse() -> list[Column]:
    vector = F.unwrap_udt("_features")
    return [vector["indices"].alias("_terms"), vector["values"].alias("_counts")]


def _step_sums(vectors: DataFrame, words: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Expected counts per (topic, word), but for the factor ``words``, and the posts' part of the bound."""
    k, width = words.shape

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, bound = np.zeros((k, width)), 0.0
        for batch in batches:
            for rows, terms, counts, weights in _blocks(batch["_terms"], batch["_counts"], words):
                shares, expected = _infer(counts, weights, prior)
                mixed = np.matmul(expected[:, None, :], weights)[:, 0, :] + 1e-100
                ratio = counts / mixed
                for t in range(k):
                    sums[t] += np.bincount(terms.ravel(), (ratio * expected[:, t, None]).ravel(), width)
                log_shares = np.log(expected + 1e-300)
                bound += float((counts * np.log(mixed)).sum() + ((prior - shares) * log_shares).sum()
                               + _log_gamma(shares).sum() - _log_gamma(shares.sum(1)).sum()
                               + len(rows) * (math.lgamma(prior * k) - k * math.lgamma(prior)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k), pa.int32()), pa.array([bound] + [0.0] * (k - 1)), pa.array(list(sums), pa.list_(pa.float64()))],
            names=["topic", "bound", "sums"])

    level = max(1, math.isqrt(vectors.rdd.getNumPartitions()))
    parts = vectors.mapInArrow(infer, "topic int, bound double, sums array<double>").select(
        "topic", "bound", array_to_vector("sums").alias("sums"), F.pmod(F.spark_partition_id(), F.lit(level)).alias("_group"))
    add = [F.sum("bound").alias("bound"), Summarizer.sum(F.col("sums")).alias("sums")]
    whole = parts.groupBy("topic", "_group").agg(*add).groupBy("topic").agg(*add)
    sums, bound = np.zeros((k, width)), 0.0
    for r in whole.collect():  # one row a topic
        sums[r["topic"]] = r["sums"].toArray()
        bound += r["bound"]
    return sums, bound


CELLS = 300_000  # numbers of a block's word weights: 2.4 MB, so that rounds stay in a core's cache


def _blocks(terms: pa.Array, counts: pa.Array, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Posts of like length, some at a time: their rows, the terms they have, the counts, and the terms' weights (posts x topics
    x terms). Shorter ones are filled up with counts of zero."""
    by_term = np.ascontiguousarray(words.T)
    lengths = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    ids, values = np.append(terms.flatten().to_numpy(zero_copy_only=False), 0), np.append(counts.flatten().to_numpy(zero_copy_only=False), 0.0)
    order = np.argsort(lengths, kind="stable")
    widths = np.maximum(lengths[order], 1)
    lo = 0
    while lo < len(order):
        few = widths[lo:lo + CELLS]
        hi = lo + max(1, int(np.searchsorted(few * np.arange(1, len(few) + 1), CELLS // len(words), side="right")))
        rows, across = order[lo:hi], np.arange(widths[hi - 1])
        at = np.where(across < lengths[rows][:, None], starts[rows][:, None] + across, len(ids) - 1)
        yield rows, ids[at], values[at], np.ascontiguousarray(by_term[ids[at]].transpose(0, 2, 1))
        lo = hi


def _infer(counts: np.ndarray, words: np.ndarray, prior: float, rounds: int = 100,
           change: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Topic weights of posts, and exp of their expected log shares; a post is done when its weights hardly change.

    ``words`` are the weights of each post's own terms (posts x topics x terms), or (topics x terms) the same for all.
    """
    if words.ndim == 2:
        words = np.broadcast_to(words, (len(counts), *words.shape))
    old = np.ones((len(counts), words.shape[1]))
    now = np.exp(_expected_log(old))
    shares, expected = old.copy(), now.copy()
    at, open_ = np.arange(len(counts)), np.ones(len(counts), bool)
    for _ in range(rounds):
        ratio = counts / (np.matmul(now[:, None, :], words)[:, 0, :] + 1e-100)
        new = prior + now * np.matmul(words, ratio[:, :, None])[:, :, 0]
        now = np.exp(_expected_log(new))
        shares[at[open_]], expected[at[open_]] = new[open_], now[open_]
        open_ &= np.abs(new - old).mean(axis=1) >= change
        old, left = new, np.count_nonzero(open_)
        if not left:
            break
        if left < 0.8 * len(at):  # posts that are done stay as they are, and go once they are many
            at, counts, words, old, now = at[open_], counts[open_], words[open_], old[open_], now[open_]
            open_ = np.ones(left, bool)
    return shares, expected


def _expected_log(weights: np.ndarray) -> np.ndarray:
    """Mean logarithms of shares that are Dirichlet with these weights, row by row."""
    found = _digamma(np.concatenate([weights, weights.sum(axis=1, keepdims=True)], axis=1))
    return found[:, :-1] - found[:, -1:]


def _digamma(x: np.ndarray) -> np.ndarray:
    """The asymptotic series at x + 6, less 1 / x + ... + 1 / (x + 5), whose terms are paired over y = x (x + 5)."""
    x = np.asarray(x, float)
    y, z = x * (x + 5), x + 6
    inverse = 1 / (z * z)
    before = (2 * x + 5) * ((3 * y + 20) * y + 24) / (y * (y + 4) * (y + 6))
    return np.log(z) - 0.5 / z - inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse / 240))) - before


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _prior_bound(weights: np.ndarray, log_words: np.ndarray, prior: float) -> float:
    """The topics' part of the bound."""
    k, width = weights.shape
    return float(((prior - weights) * log_words).sum() + _log_gamma(weights).sum() - _log_gamma(weights.sum(1)).sum()
                 + k * (math.lgamma(prior * width) - width * math.lgamma(prior)))


def topic_terms(model: TopicModel | BatchTopicModel, n: int = 10, spark: SparkSession | None = None) -> DataFrame:
    """The n heaviest terms of each topic as (topic, rank, term, weight)."""
    if isinstance(model, BatchTopicModel):
        shares = model.weights / model.weights.sum(axis=1, keepdims=True)
        rows = [(t, r + 1, model.vocabulary[w], float(shares[t, w]))
                for t in range(len(shares)) for r, w in enumerate(np.argsort(-shares[t], kind="stable")[:n])]
        return (spark or SparkSession.active()).createDataFrame(rows, "topic int, rank int, term string, weight double")
    words = F.array(*map(F.lit, model.vocabulary))
    heavy = model.lda.describeTopics(n)
    return heavy.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "t")).select(
        "topic", (F.col("pos") + 1).alias("rank"), F.element_at(words, F.col("t.termIndices") + 1).alias("term"),
        F.col("t.termWeights").alias("weight"),
    )


def topic_shares(df: DataFrame, model: TopicModel | BatchTopicModel, tokens: str = "tokens", max_n: int = 2) -> DataFrame:
    """Add ``topic_shares``, an array that sums to 1. Without known words all topics of a batch model are equally likely."""
    keep = [F.col(c) for c in df.columns]
    rows = model.features.transform(_grams(df, tokens, max_n, model.vocabulary))
    if isinstance(model, TopicModel):
        return model.lda.transform(rows).select(*keep, vector_to_array("_topics").alias("topic_shares"))
    words, prior = np.exp(_expected_log(model.weights)), model.prior

    @F.pandas_udf("array<double>")
    def infer(terms: pd.Series, counts: pd.Series) -> pd.Series:
        out = np.empty((len(terms), len(words)))
        for at, _, found, weights in _blocks(pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float64())), words):
            out[at] = _infer(found, weights, prior)[0]
        return pd.Series([r / r.sum() for r in out], dtype=object)

    return rows.select(*keep, infer(*_sparse()).alias("topic_shares"))


def assign_topics(df: DataFrame, model: TopicModel | BatchTopicModel, tokens: str = "tokens", max_n: int = 2) -> DataFrame:
    """Add ``dominant_topic`` and ``topic_confidence`` (its probability)."""
    shares = F.col("topic_shares")
    return topic_shares(df, model, tokens, max_n).select(
        *[F.col(c) for c in df.columns], (F.array_position(shares, F.array_max(shares)) - 1).cast("int").alias("dominant_topic"),
        F.array_max(shares).alias("topic_confidence"),
    )


def topic_distribution(assigned: DataFrame) -> DataFrame:
    """Posts and mean confidence per dominant topic."""
    return assigned.groupBy("dominant_topic").agg(
        F.count(F.lit(1)).alias("posts"), F.avg("topic_confidence").alias("avg_confidence")
    )
