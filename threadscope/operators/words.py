"""Word counts, vocabulary and TF-IDF over token arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadscope import presets
from threadscope.functions.text import let, ngrams
from threadscope.operators.ranking import top_k_per_group
from threadscope.session import scratch_path


def word_counts(df: DataFrame, keys: Sequence[str] = (), tokens: str = "tokens") -> DataFrame:
    """Occurrences per word (and key); counts are combined before the shuffle, so a common word is no hot spot."""
    return (
        df.select(*keys, F.explode(tokens).alias("word"))
        .groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    )


def top_words(df: DataFrame, k: int = 50, min_length: int = 3, min_count: int = 6,
              tokens: str = "tokens") -> DataFrame:
    """The k most frequent words of at least that length and count."""
    return (
        word_counts(df, (), tokens)
        .filter((F.length("word") >= min_length) & (F.col("n") >= min_count))
        .orderBy(F.desc("n"), "word").limit(k)
    )


def top_words_by(df: DataFrame, key: str, k: int = 20, min_length: int = 3, min_count: int = 3,
                 skip: Sequence[str] = (presets.UNKNOWN,), tokens: str = "tokens") -> DataFrame:
    """The same per value of a key, all values in one shuffle; adds ``rank``."""
    counts = word_counts(df.filter(~F.col(key).isin(*skip)) if skip else df, (key,), tokens)
    counts = counts.filter((F.length("word") >= min_length) & (F.col("n") >= min_count))
    return top_k_per_group(counts, [key], [F.desc("n"), F.col("word")], k)


def largest_groups(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k values with most rows (ties by value); at most k rows, so safe to broadcast."""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k).select(key)
    )


def within_largest(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    return df.join(F.broadcast(largest_groups(df, key, k)), key, "left_semi")


def word_totals(df: DataFrame, tokens: str = "tokens", approximate: bool = False) -> DataFrame:
    """Distinct words and all words, before any filter."""
    if approximate:
        words = df.select(F.explode(tokens).alias("word"))
        return words.agg(F.approx_count_distinct("word").alias("unique_words"), F.count("word").alias("total_words"))
    return word_counts(df, (), tokens).agg(
        F.count(F.lit(1)).alias("unique_words"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_words")
    )


def grams(tokens: str, max_n: int, known: Sequence[str] | None = None) -> Column:
    """All n-grams of 1 to ``max_n`` words; with ``known``, those made of these words only."""
    if known is None:
        return F.flatten(F.array(*[ngrams(F.col(tokens), n) for n in range(1, max_n + 1)]))
    # Other words become null, and a run with one of them is null as a whole.
    kept = F.transform(tokens, lambda t: F.when(t.isin(*known), t))
    return let(kept, lambda t: F.array_compact(F.flatten(F.array(*[ngrams(t, n) for n in range(1, max_n + 1)]))))


def term_totals(df: DataFrame, tokens: str = "tokens", max_n: int = 2, known: Sequence[str] | None = None) -> DataFrame:
    """(term, cf, df): occurrences of each n-gram (1 to ``max_n`` words) and posts that hold it.

    All n-grams of a post lie in one row, so its distinct ones are known there; nothing is shuffled by post. ``known`` leaves
    out n-grams with other words.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    found = grams(tokens, max_n, known)
    seen = F.transform(found, lambda t: F.struct(t.alias("term"), one.alias("cf"), none.alias("df")))
    held = F.transform(F.array_distinct(found), lambda t: F.struct(t.alias("term"), none.alias("cf"), one.alias("df")))
    return df.select(F.inline(F.concat(seen, held))).groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


SLICE = 1 << 21  # tokens that a task counts at a time


def _counted(known: Sequence[str] | None, max_n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences (cf) and posts (df) of each n-gram of known words, or of each word, in slices of whole posts.

    An n-gram is a number whose digits to the base ``len(known) + 1`` are its words, counted from 1.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posts = batch.column(0)
            ends = np.cumsum(posts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(posts):
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
                yield counted(posts.slice(start, stop - start))
                start = stop

    def counted(posts: pa.Array) -> pa.RecordBatch:
        tokens = posts.flatten()
        post = np.repeat(np.arange(len(posts)), posts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        if known is None:
            coded = tokens.dictionary_encode()
            found, words, most = coded.indices, coded.dictionary, len(coded.dictionary) + 1
        else:
            found, words, most = pa.compute.index_in(tokens, pa.array(known, tokens.type)), None, (len(known) + 1) ** max_n
        word = found.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) + 1  # 0: another word
        run, alive, seen = word, word > 0, []
        for n in range(1, max_n + 1 if known is not None else 2):
            if n > 1:  # longer by the word n - 1 places on, if it is of the same post
                size = max(len(word) - n + 1, 0)
                run = run[:size] * (len(known) + 1) + word[n - 1:]
                alive = alive[:size] & (word[n - 1:] > 0) & (post[:size] == post[n - 1:])
            seen.append(post[:len(run)][alive] * most + run[alive])
        every = np.sort(np.concatenate(seen))
        fresh = np.ones(len(every), bool)  # the first of an n-gram in a post
        fresh[1:] = every[1:] != every[:-1]
        gram, cf = np.unique(every % most, return_counts=True)
        df = np.unique(every[fresh] % most, return_counts=True)[1]
        term = words.take(pa.array(gram - 1)).cast(pa.string()) if known is None else pa.array(gram, pa.int64())
        return pa.RecordBatch.from_arrays([term, pa.array(cf, pa.int64()), pa.array(df, pa.int64())], ["term", "cf", "df"])

    return run


def _totals(df: DataFrame, tokens: str, known: Sequence[str] | None = None, max_n: int = 1) -> DataFrame:
    """:func:`term_totals` of n-grams of ``known``, or of all words, counted as numbers in tasks."""
    kind = "string" if known is None else "long"
    parts = df.select(tokens).mapInArrow(_counted(known, max_n), f"term {kind}, cf long, df long")
    totals = parts.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
    if known is None:
        return totals
    spelled, base = F.array(F.lit(None).cast("string"), *map(F.lit, known)), len(known) + 1
    digits = [F.floor(F.col("term") / F.lit(base**n)) % base if n else F.col("term") % base for n in range(max_n - 1, -1, -1)]
    words = [F.element_at(spelled, (d + 1).cast("int")) for d in digits]
    return totals.withColumn("term", F.array_join(F.array(*words), " "))  # without nulls


KNOWN_WORDS = 4000  # words that may travel inside an expression


def corpus_vocabulary(df: DataFrame, size: int = 1000, min_df: int = 5, max_df: float = 0.7, tokens: str = "tokens",
                      max_n: int = 2, as_numbers: bool = False) -> DataFrame:
    """:func:`vocabulary` of a corpus, without counting the n-grams that cannot be in it. Reads ``df`` several times.

    An n-gram is no more frequent than any of its words. Words are counted first; the ``size``-th of those that qualify has a
    count that every term of the vocabulary reaches, so only n-grams of words that reach it are counted, a small part of all.
    Where more than ``KNOWN_WORDS`` words do, all n-grams are counted. ``as_numbers`` counts in Arrow batches, for models that run
    such tasks anyway.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "word-totals")
    if as_numbers:
        _totals(df, tokens).write.parquet(path)
    else:
        # Distinct words of a post and all of them are exploded by themselves: generated code, no structs to build.
        seen = df.select(F.explode(tokens).alias("term"), F.lit(1).cast("long").alias("cf"), F.lit(0).cast("long").alias("df"))
        held = df.select(F.explode(F.array_distinct(tokens)).alias("term"), F.lit(0).cast("long").alias("cf"), F.lit(1).cast("long").alias("df"))
        seen.unionAll(held).groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")).write.parquet(path)
    totals = spark.read.parquet(path)
    least = vocabulary(totals, df, size, min_df, max_df).agg(F.min("cf").alias("least"), F.count(F.lit(1)).alias("n")).first()  # one row
    reached = totals.filter((F.col("df") >= min_df) & (F.col("cf") >= (least["least"] if least["n"] == size else 1)))
    known = [r["term"] for r in reached.select("term").limit(KNOWN_WORDS + 1).collect()]
    if not known:
        return vocabulary(totals, df, size, min_df, max_df)
    # Digits tell an n-gram as long as no word holds a space; below 2^31 there is room for the posts of a slice.
    plain = as_numbers and len(known) <= KNOWN_WORDS and (len(known) + 1) ** max_n < 1 << 31 and not any(" " in word for word in known)
    counted = _totals(df, tokens, sorted(known), max_n) if plain else term_totals(df, tokens, max_n, sorted(known) if len(known) <= KNOWN_WORDS else None)
    return vocabulary(counted, df, size, min_df, max_df)


def vocabulary(totals: DataFrame, documents: DataFrame, size: int = 1000, min_df: int = 5,
               max_df: float = 0.7) -> DataFrame:
    """Terms in at least ``min_df`` posts and at most a share ``max_df``; the ``size`` most frequent, ties by term."""
    total = documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        totals.filter((F.col("df") >= min_df) & (F.col("df") <= total * F.lit(max_df)))
        .orderBy(F.desc("cf"), "term").limit(size)
    )


def words_of(vocab: DataFrame) -> list[str]:
    """The words that the terms of a vocabulary are made of; the vocabulary is bounded by its limit."""
    return sorted({word for r in vocab.select("term").collect() for word in r["term"].split(" ")})


def tfidf(df: DataFrame, vocab: DataFrame, id_col: str = "id", tokens: str = "tokens", max_n: int = 2,
          known: Sequence[str] | None = None) -> DataFrame:
    """Weight tf * (ln((1 + n) / (1 + df)) + 1), scaled to length 1 per post. The vocabulary is bounded by its limit.

    Only hits of the vocabulary leave their row; one exchange by post serves counts and lengths. ``known``, the words of the
    vocabulary where they were collected, spares the n-grams of other words.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    hits = df.select(id_col, F.explode(grams(tokens, max_n, known)).alias("term")).join(F.broadcast(vocab.select("term", "df")), "term")
    raw = hits.repartition(id_col).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("df").alias("df"))
    raw = raw.withColumn("w", F.col("tf") * (F.log((total + 1) / (F.col("df") + 1)) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", F.round(F.col("w") / length, 6).alias("weight"))


def term_cloud(df: DataFrame, key: str | None = None, k: int = 100, tokens: str = "tokens") -> DataFrame:
    """Words with weight = count / largest count, overall or per key."""
    counts = word_counts(df, (key,) if key else (), tokens)
    if key is None:
        top = counts.orderBy(F.desc("n"), "word").limit(k)
        best = Window.partitionBy(F.lit(1))
        return top.select("word", "n", F.round(F.col("n") / F.max("n").over(best), 6).alias("weight"))
    top = top_k_per_group(counts.filter(F.col(key) != presets.UNKNOWN), [key], [F.desc("n"), F.col("word")], k)
    best = Window.partitionBy(key)
    return top.select(key, "word", "n", F.round(F.col("n") / F.max("n").over(best), 6).alias("weight"))
