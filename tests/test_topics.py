"""The batch topic model: planted topics, the bound, and sums that do not depend on the partitions."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadscope.operators import topics, words

THEMES = (["visa", "fee", "form", "card"], ["cat", "dog", "bird", "fish"], ["rain", "sun", "snow", "wind"])


@pytest.fixture(scope="module")
def posts(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice(THEMES[i % 3]) for _ in range(30)]) for i in range(300)]
    rows += [(300, []), (301, ["unheard"])]
    return spark.createDataFrame(rows, "id int, tokens array<string>")


@pytest.fixture(scope="module")
def model(posts):
    return topics.fit_topics_batch(posts, k=3, max_iter=20, max_n=1, vocab_size=50)


def test_planted_topics_are_found(posts, model):
    terms = topics.topic_terms(model, 4).groupBy("topic").agg(F.collect_set("term").alias("terms")).collect()
    assert sorted(sorted(r.terms) for r in terms) == sorted(map(sorted, THEMES))
    got = topics.assign_topics(posts, model, max_n=1)
    assert got.columns == ["id", "tokens", "dominant_topic", "topic_confidence"]
    by_theme = got.filter("id < 300").groupBy(F.expr("id % 3"), "dominant_topic").agg(F.min("topic_confidence").alias("c")).collect()
    assert len(by_theme) == 3 and min(r.c for r in by_theme) > 0.8
    assert [r.topic_confidence for r in got.filter("id >= 300").collect()] == pytest.approx([1 / 3, 1 / 3])


def test_perplexity_falls(model):
    assert all(b <= a * (1 + 1e-9) for a, b in zip(model.perplexities, model.perplexities[1:]))
    assert model.perplexities[-1] < 0.7 * model.perplexities[0]


def test_same_model_for_any_partitions(posts, model):
    again = topics.fit_topics_batch(posts.repartition(7), k=3, max_iter=20, max_n=1, vocab_size=50)
    order = [again.vocabulary.index(w) for w in model.vocabulary]
    # Words of equal counts may change places in the vocabulary, and with them their first weights.
    if order == sorted(order):
        np.testing.assert_allclose(again.weights, model.weights, rtol=1e-6)
    assert sorted(again.vocabulary) == sorted(model.vocabulary)


def test_stops_when_little_changes(posts):
    assert len(topics.fit_topics_batch(posts, k=3, max_iter=50, max_n=1, tolerance=0.01).perplexities) < 30


def test_special_functions():
    x = np.array([0.1, 0.5, 1.0, 3.7, 25.0])
    slope = [(math.lgamma(v + 1e-5) - math.lgamma(v - 1e-5)) / 2e-5 for v in x]
    np.testing.assert_allclose(topics._digamma(x), slope, rtol=1e-6, atol=1e-6)
    shares, _ = topics._infer(np.zeros((2, 4)), np.ones((3, 4)), 0.5)
    np.testing.assert_allclose(shares, 0.5)


def test_steps_read_saved_counts(spark, posts):
    """Neither model goes back to the tokens after their n-grams are counted."""
    features, vectors = topics._fit_features(posts.filter(F.size("tokens") > 0), "tokens", 2, 50, 5, 0.7)
    plan = vectors._jdf.queryExecution().optimizedPlan().toString()
    assert "tokens" not in plan and "_grams" not in plan and "_tf" in plan
    assert vectors.count() == 301 and len(features.stages[0].vocabulary) == 50


def test_posts_are_inferred_from_their_own_terms():
    """Blocks hold little more than the terms that posts have, whatever the vocabulary, and give what whole rows of it give."""
    rng = np.random.default_rng(6)
    rows = [sorted(rng.choice(400, n, replace=False).tolist()) for n in rng.integers(0, 60, 900)] + [list(range(400)), []]
    counts = [rng.integers(1, 9, len(r)).astype(float).tolist() for r in rows]
    words = rng.random((3, 400))
    dense = np.zeros((len(rows), 400))
    for i, (r, c) in enumerate(zip(rows, counts)):
        dense[i, r] = c
    want, cells, seen = topics._infer(dense, words, 0.3), 0, []
    terms, values = pa.array([[0], *rows], pa.list_(pa.int32()))[1:], pa.array([[1.0], *counts], pa.list_(pa.float64()))[1:]
    for at, ids, found, weights in topics._blocks(terms, values, words):
        assert weights.shape == (len(at), 3, ids.shape[1]) and weights.size <= max(topics.CELLS, 3 * ids.shape[1])
        for got, whole in zip(topics._infer(found, weights, 0.3), want):
            np.testing.assert_allclose(got, whole[at], rtol=1e-6)
        cells, seen = cells + ids.size, seen + at.tolist()
    assert sorted(seen) == list(range(len(rows))) and cells < 0.3 * dense.size


def test_terms_are_counted_as_numbers(spark):
    """The same totals as from n-grams as texts; nulls, empty posts, words with spaces and slices of few tokens included."""
    rng = random.Random(7)
    rows = [([rng.choice(["a", "b", "c", "", "d", None]) for _ in range(rng.randrange(12))],) for _ in range(200)] + [(None,), ([],)]
    df = spark.createDataFrame(rows, "tokens array<string>")
    known = ["", "a", "c"]
    for n in (1, 2, 3):
        assert sorted(words._totals(df, "tokens", known, n).collect()) == sorted(words.term_totals(df, max_n=n, known=known).collect())
    assert sorted(words._totals(df, "tokens").collect()) == sorted(words.term_totals(df, max_n=1).dropna().collect())
    spaced = spark.createDataFrame([(["a b", "c", "a", "b"],)] * 3, "tokens array<string>")
    got = words.corpus_vocabulary(spaced, 50, 1, 1.0, as_numbers=True).collect()
    assert got == words.vocabulary(words.term_totals(spaced), spaced, 50, 1, 1.0).collect()
    full = df.dropna().select(F.array_compact("tokens").alias("tokens"))
    for size, n in ((3, 2), (9, 3), (500, 2)):
        want = words.vocabulary(words.term_totals(full, max_n=n), full, size, 3, 0.9).collect()
        assert words.corpus_vocabulary(full, size, 3, 0.9, max_n=n, as_numbers=True).collect() == want
