"""Row-level cleaning: preprocessing, validity, duplicates, missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from threadscope import presets
from threadscope.functions import text as T
from threadscope.session import scratch_path


def preprocess(df: DataFrame, column: str = "text", min_length: int = presets.MIN_TEXT_LENGTH,
               stop_words: Sequence[str] | None = None, extra_stop_words: Sequence[str] = presets.DOMAIN_STOP_WORDS,
               lemmas: Mapping[str, str] | None = None, emoji: str = "describe", compat: bool = False, texts: bool = True) -> DataFrame:
    """Add ``cleaned_text, tokens, processed_text, word_count, is_valid``.

    A text shorter than ``min_length`` after cleaning becomes an empty, invalid record. Tokens stay an array. ``texts=False``
    leaves ``cleaned_text`` out and spares the steps that tokens do not depend on; the other columns are the same.
    """
    stop = list(presets.ENGLISH_STOP_WORDS if stop_words is None else stop_words) + list(extra_stop_words)
    empty = F.array().cast("array<string>")

    def words_of(clean: Column) -> Column:
        # Punctuation marks are tokens of one character, which the length filter would drop anyway. Without lemmas, which may
        # shorten a token, that filter is part of the pattern.
        if lemmas:
            return T.filter_tokens(T.lemmatize(T.remove_stopwords(T.tokenize_words(clean), stop), lemmas))
        return T.remove_stopwords(T.tokenize_kept(clean), stop)

    def record(clean: Column) -> Column:
        long_enough = F.length(clean) >= min_length
        return F.struct(
            F.when(long_enough, clean).otherwise("").alias("cleaned_text"),
            F.when(long_enough, words_of(clean)).otherwise(empty).alias("tokens"),
        )

    def tokens_alone(raw: Column) -> Column:
        # A kept token has two characters at least, so most texts are known to be long enough; the others go along. Lemmas may
        # be longer than what they stand for.
        loose = T.clean_text(raw, emoji, compat, runs=False)
        unsure = lambda words: F.lit(True) if lemmas else F.size(words) * 2 < min_length
        return T.let(words_of(loose), lambda words: F.struct(words.alias("tokens"), F.when(unsure(words), F.coalesce(raw, F.lit(""))).alias("_unsure")))

    # The generator keeps a later filter on the tokens above it; pushed below, it would clean every text twice.
    source, build = (T.clean_text(F.col(column), emoji, compat), record) if texts else (F.col(column), tokens_alone)
    keep = [c for c in df.columns if c not in ("cleaned_text", "tokens")]
    rows = df.select(*keep, F.inline(F.transform(F.array(source), build)))
    if not texts:
        measured = F.length(T.clean_text(F.col("_unsure"), emoji, compat)) >= min_length
        rows = rows.withColumn("tokens", F.when(F.col("_unsure").isNull() | measured, F.col("tokens")).otherwise(empty)).drop("_unsure")
    return rows.withColumns({
        "processed_text": F.array_join("tokens", " "),
        "word_count": F.size("tokens"),
        "is_valid": F.size("tokens") > 0,
    })


def drop_invalid(df: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Keep valid rows; an observation receives ``rows_in`` and ``rows_removed`` from the same pass."""
    if observation is not None:
        df = df.observe(
            observation, F.count(F.lit(1)).alias("rows_in"), F.count_if(~F.col("is_valid")).alias("rows_removed")
        )
    return df.filter(F.col("is_valid"))


def dedupe(df: DataFrame, keys: Sequence[str] = ("text", "subreddit"),
           order: Sequence[str] = ("created_utc", "id")) -> DataFrame:
    """Keep the first row per key in ``order``; null keys are equal to each other.

    A minimum over whole rows is aggregated before the shuffle, so a text copied a billion times sends one row per
    task. The hash of the keys goes first only to make the comparison of long texts cheap; the keys still decide.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    nulls_last = [f for c in order for f in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))]
    row = F.struct(*nulls_last, *[F.col(c) for c in rest])
    first = df.groupBy(F.xxhash64(*keys).alias("_key"), *keys).agg(F.min(row).alias("_row"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


CHUNK_ROWS = 4096
BITS_BROADCAST = 90_000  # chunks, of about 700 bytes each: 64 MB


def dedupe_files(df: DataFrame, keys: Sequence[str] = ("text", "subreddit"), order: Sequence[str] = ("created_utc", "id"),
                 max_chunks: int = BITS_BROADCAST) -> DataFrame:
    """As :func:`dedupe`, for rows as they come from files; rows stay where they are read.

    Call it right after the read (columns may be chosen and rows filtered before, but not joined, exploded or grouped),
    while a row's address, its file and place in it, is known. Only a digest of the keys, ``order`` and the address are
    shuffled; the first row of each digest is marked in a bitmap of its file, and the scan keeps the rows marked. Bitmaps
    are broadcast up to ``max_chunks`` chunks of 4,096 rows; beyond that a semi join on the address moves the rows. Rows
    that tie in ``order`` are told by a hash of the whole row, then by address.
    """
    digest = F.unhex(F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)).alias("_digest")
    file, at = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")
    first_of = [f for c in order for f in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))]
    place = F.struct(*first_of, F.xxhash64(*df.columns).alias("_row"), file, at)
    first = df.select(digest, place.alias("_place")).groupBy("_digest").agg(F.min("_place").alias("_place"))
    kept = first.select("_place._file", "_place._at")

    word = F.shiftright("_at", 6).bitwiseAND(F.lit(CHUNK_ROWS // 64 - 1)).cast("int").alias("_word")
    chunk = F.shiftright("_at", 12).alias("_chunk")
    bit = F.expr("shiftleft(1L, cast(_at & 63 as int))")
    words = kept.select("_file", chunk, word, bit.alias("_bit")).groupBy("_file", "_chunk", "_word").agg(F.bit_or("_bit").alias("_bits"))
    filled = F.map_from_entries(F.collect_list(F.struct("_word", "_bits")))
    maps = words.groupBy("_file", "_chunk").agg(filled.alias("_map"))  # 64 words at most
    dense = F.transform(F.sequence(F.lit(0), F.lit(CHUNK_ROWS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("_map", i), F.lit(0).cast("long")))
    path = scratch_path(df.sparkSession, "kept-rows")
    maps.select("_file", "_chunk", dense.alias("_bits")).write.parquet(path)
    bits = df.sparkSession.read.parquet(path)

    rows = df.select("*", file, at)
    if bits.count() > max_chunks:
        each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(CHUNK_ROWS - 1)), lambda i: _bit_of(F.col("_bits"), i)))
        marked = bits.select("_file", "_chunk", each.alias("_i")).select("_file", (F.col("_chunk") * CHUNK_ROWS + F.col("_i")).alias("_at"))
        return rows.join(marked, ["_file", "_at"], "left_semi").select(*df.columns)
    joined = rows.withColumn("_chunk", F.shiftright("_at", 12)).join(F.broadcast(bits), ["_file", "_chunk"])
    return joined.filter(_bit_of(F.col("_bits"), F.col("_at").bitwiseAND(F.lit(CHUNK_ROWS - 1)).cast("int"))).select(*df.columns)


def _bit_of(bits: Column, i: Column) -> Column:
    word = F.get(bits, F.shiftright(i, 6))
    return F.call_function("shiftrightunsigned", word, i.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1


def fill_missing(df: DataFrame, now: datetime | None = None, names: Sequence[str] = ("subreddit", "author"),
                 seconds: str = "created_utc") -> DataFrame:
    """Missing names become ``unknown``; the time becomes a number, and ``now`` where it is not one.

    Without ``now`` a missing time stays null, so that it does not pile up in one month of the time reports.
    """
    fills = {c: F.coalesce(F.col(c), F.lit(presets.UNKNOWN)) for c in names if c in df.columns}
    if seconds in df.columns:
        number = F.col(seconds).cast("string").try_cast("double")
        fills[seconds] = number if now is None else F.coalesce(number, F.lit(float(now.timestamp())))
    return df.withColumns(fills)


def cleaning_summary(df: DataFrame, words: str = "word_count", group: str = "subreddit",
                     valid: str = "is_valid") -> DataFrame:
    """One row: rows, valid rows, word-count statistics, distinct groups.

    The exact median comes from counts per distinct word count, which are few, not from the rows themselves.
    """
    per_value = df.groupBy(group, words).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("valid")
    )
    w = F.col(words)
    return per_value.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_entries"),
        F.coalesce(F.sum("valid"), F.lit(0)).cast("long").alias("valid_entries"),
        F.round(F.try_divide(F.sum(w * F.col("n")), F.sum(F.when(w.isNotNull(), F.col("n")))), 6).alias(
            "avg_word_count"),
        F.count_distinct(group).alias("unique_subreddits"),
        F.min(words).alias("min_words"),
        F.max(words).alias("max_words"),
        F.expr(f"round(percentile({words}, 0.5, n), 6)").alias("median_words"),
        F.round(weighted_std(words, "n"), 6).alias("std_words"),
    )


def weighted_std(value: str, weight: str):
    """Sample standard deviation of ``value`` repeated ``weight`` times; null below two rows."""
    v = F.col(value).cast("double")
    n = F.when(F.col(value).isNotNull(), F.col(weight)).cast("double")
    spread = F.sum(v * v * n) - F.try_divide(F.sum(v * n) * F.sum(v * n), F.sum(n))
    return F.when(F.sum(n) > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.sum(n) - 1)))
