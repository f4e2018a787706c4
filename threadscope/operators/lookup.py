"""Joins with user-supplied word tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadscope import presets
from threadscope.functions.text import literal_map
from threadscope.session import scratch_path

BROADCAST_ROWS = 500_000
SALTS = 32


def join_words(tokens: DataFrame, table: DataFrame, column: str, how: str = "left", max_rows: int = BROADCAST_ROWS,
               salts: int = SALTS) -> DataFrame:
    """Join on a word column whose values are very uneven.

    The table's size is checked with a bounded count: up to ``max_rows`` rows it is broadcast. Beyond that both sides
    are salted, so that the occurrences of one common word spread over ``salts`` tasks.
    """
    if table.limit(max_rows + 1).count() <= max_rows:
        return tokens.join(F.broadcast(table), column, how)
    salted = table.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    seed = F.pmod(F.xxhash64(*[c for c in tokens.columns if c != column]), F.lit(salts)).cast("int")
    return tokens.withColumn("_salt", seed).join(salted, [column, "_salt"], how).drop("_salt")


def lemmatize_by_table(df: DataFrame, lemmas: DataFrame, id_col: str = "id", tokens: str = "tokens",
                       max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Replace tokens by the lemma of a (token, lemma) table; order is kept, unknown tokens stay.

    Each post looks up its distinct tokens and gets back a small map of those found; its token list is never taken apart
    and put together again.
    """
    words = df.select(id_col, F.explode(F.array_distinct(tokens)).alias("token"))
    found = join_words(words, lemmas.groupBy("token").agg(F.min("lemma").alias("lemma")), "token", "inner", max_rows)
    maps = found.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("token", "lemma"))).alias("_lemmas")
    )
    replaced = F.transform(tokens, lambda t: F.coalesce(F.try_element_at("_lemmas", t), t))
    return (
        df.join(maps, id_col, "left")
        .withColumn(tokens, F.when(F.col("_lemmas").isNull(), F.col(tokens)).otherwise(replaced)).drop("_lemmas")
    )


def corpus_words(df: DataFrame, min_posts: int = 3, tokens: str = "tokens") -> DataFrame:
    """Words that at least so many posts use, as (token): a vocabulary where no word list is at hand."""
    used = df.select(F.explode(F.array_distinct(tokens)).alias("token"))
    return used.groupBy("token").agg(F.count(F.lit(1)).alias("_posts")).filter(F.col("_posts") >= min_posts).select("token")


def noun_lemmas(words: DataFrame, vocabulary: DataFrame, exceptions: Mapping[str, str] = presets.LEMMA_STARTER,
                endings: Sequence[tuple[str, str]] = presets.NOUN_ENDINGS) -> DataFrame:
    """Singulars as a (token, lemma) table, for the words of a (token) table that are not their own lemma.

    Each ending a word has is detached and its replacement put there; of the forms the vocabulary (token) knows, the word
    itself among them, the shortest counts, then the first ending. Listed exceptions go first. Nothing is left of an
    empty form, and null words have no lemma. Works on distinct words, so a common word counts once.
    """
    token = F.col("token")
    forms = [F.struct(F.lit(0).alias("order"), token.alias("form"))] + [
        F.when(token.endswith(old) & (F.length(token) > len(old)), F.struct(
            F.lit(i + 1).alias("order"), F.concat(token.substr(F.lit(1), F.length(token) - len(old)), F.lit(new)).alias("form")))
        for i, (old, new) in enumerate(endings)
    ]
    listed = list(exceptions)
    distinct = words.filter(token.isNotNull()).select("token").distinct()
    ended = F.lit(False)
    for old, _ in endings:
        ended = ended | token.endswith(old)
    tried = distinct.filter(ended & ~token.isin(*listed)).select(
        "token", F.explode(F.filter(F.array(*forms), lambda f: f.isNotNull())).alias("f")).select("token", "f.*")
    known = vocabulary.select(F.col("token").alias("form")).filter("form is not null").distinct()
    ruled = tried.join(known, "form").groupBy("token").agg(
        F.min(F.struct(F.length("form"), "order", "form")).alias("best")).select("token", F.col("best.form").alias("lemma"))
    fixed = distinct.filter(token.isin(*listed)).select(
        "token", F.try_element_at(literal_map(exceptions), token).alias("lemma"))
    return ruled.unionByName(fixed).filter("token <> lemma")


def lemmatize_nouns(df: DataFrame, vocabulary: DataFrame, id_col: str = "id", tokens: str = "tokens",
                    exceptions: Mapping[str, str] = presets.LEMMA_STARTER, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Replace plurals by singulars that :func:`noun_lemmas` derives from the words in use; order is kept.

    The derived table is saved, as :func:`lemmatize_by_table` asks for its size before it joins.
    """
    words = df.select(F.explode(tokens).alias("token"))
    path = scratch_path(df.sparkSession, "lemmas")
    noun_lemmas(words, vocabulary, exceptions).write.parquet(path)
    return lemmatize_by_table(df, df.sparkSession.read.parquet(path), id_col, tokens, max_rows)


IN_ROW = 10_000  # words of a table that travels inside the expression


def word_value(values: Mapping[str, float]) -> Callable[[Column], Column]:
    """A word's value in a bounded literal table, null if it has none. Maps search one key after the other, so the table
    is dealt into many small ones by the word's checksum."""
    n = 1 << max(0, len(values) // 2 - 1).bit_length()
    parts: list[dict[str, float]] = [{} for _ in range(n)]
    for word, value in values.items():
        parts[zlib.crc32(word.encode()) % n][word] = float(value)
    table = F.array(*[F.map_from_arrays(F.array(*map(F.lit, p)).cast("array<string>"), F.array(*map(F.lit, p.values())).cast("array<double>")) for p in parts])
    return lambda word: F.try_element_at(F.get(table, F.pmod(F.crc32(word.cast("binary")), F.lit(n)).cast("int")), word)


def sentiment_of(hits: Column, reach: int = 3, turn: float = -0.5) -> Column:
    """Mean polarity of ``hits`` (pos, polarity, strength, negates) by position, 0 without a polar one.

    A word directly after strengthening words is multiplied by their strengths, and stays within -1 and 1. A polar word
    at most ``reach`` words after a negation is multiplied by ``turn``, and uses the negation up.
    """
    number, place = (lambda x: F.lit(float(x))), (lambda x: F.lit(x).cast("int"))
    start = F.struct(number(0).alias("total"), place(0).alias("n"), number(1).alias("strength"), place(-2).alias("strong_at"), place(-1_000_000).alias("negated_at"))

    def step(s: Column, h: Column) -> Column:
        polar, strong = h["polarity"].isNotNull(), h["strength"].isNotNull()
        strength = F.when(s["strong_at"] == h["pos"] - 1, s["strength"]).otherwise(1.0)
        negated = s["negated_at"] >= h["pos"] - reach
        value = F.greatest(F.least(h["polarity"] * strength, F.lit(1.0)), F.lit(-1.0)) * F.when(negated, turn).otherwise(1.0)
        return F.struct(
            (s["total"] + F.when(polar, value).otherwise(0.0)).alias("total"), (s["n"] + polar.cast("int")).alias("n"),
            F.when(~polar & strong, strength * h["strength"]).otherwise(1.0).alias("strength"),
            F.when(~polar & strong, h["pos"]).otherwise(place(-2)).alias("strong_at"),
            F.when(polar & negated, place(-1_000_000)).when(~polar & ~strong & h["negates"], h["pos"]).otherwise(s["negated_at"]).alias("negated_at"),
        )

    return F.aggregate(hits, start, step, lambda s: F.coalesce(F.try_divide(s["total"], s["n"]), F.lit(0.0)))


def score_sentiment(df: DataFrame, polarity: DataFrame | Mapping[str, float], id_col: str = "id", tokens: str = "tokens",
                    max_rows: int = BROADCAST_ROWS, negations: Collection[str] = (),
                    strengths: Mapping[str, float] | None = None, in_row: int = IN_ROW) -> DataFrame:
    """Add ``sentiment``: mean polarity over the tokens found in a (token, polarity) table, 0 without a hit.

    With ``negations`` and ``strengths`` a word counts in its context, see :func:`sentiment_of`; give it tokens from which
    stop words, and with them the negations, have not been removed. A table of at most ``in_row`` words, looked up first,
    becomes part of the expression, and no row is shuffled; beyond that the tokens found, and only they, are joined and
    collected per post. A word that is polar is neither negation nor strength. A null token list gives null.
    """
    strengths = dict(strengths or {})
    if not isinstance(polarity, Mapping):
        scores = polarity.filter("token is not null").groupBy("token").agg(F.avg(F.col("polarity").cast("double")).alias("polarity"))
        found = scores.filter("polarity is not null").limit(in_row + 1).collect()
        values = {r["token"]: r["polarity"] for r in found} if len(found) <= in_row else None
    else:
        values = polarity
        scores = None if len(values) <= in_row else df.sparkSession.createDataFrame(list(values.items()), "token string, polarity double")
    if values is not None and len(values) <= in_row:
        of, strong = word_value(values), word_value(strengths)
        known = sorted({*values, *strengths, *negations})
        marked = F.transform(tokens, lambda t, i: F.struct(i.alias("pos"), t.alias("token")))
        hits = F.transform(F.filter(marked, lambda x: x["token"].isin(*known)), lambda x: F.struct(
            x["pos"].alias("pos"), of(x["token"]).alias("polarity"), strong(x["token"]).alias("strength"),
            x["token"].isin(*negations).alias("negates")))
        return df.withColumn("sentiment", F.when(F.col(tokens).isNotNull(), sentiment_of(hits)))
    extra = df.sparkSession.createDataFrame(
        [(w, strengths.get(w), w in negations) for w in {*strengths, *negations}], "token string, strength double, negates boolean")
    lexicon = scores.join(F.broadcast(extra), "token", "full_outer").withColumn("negates", F.coalesce("negates", F.lit(False)))
    words = df.select(id_col, F.posexplode(tokens).alias("pos", "token"))
    found = join_words(words, lexicon, "token", "inner", max_rows)
    hits = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "polarity", "strength", "negates"))).alias("_hits"))
    return (
        df.join(hits.select(id_col, sentiment_of(F.col("_hits")).alias("_mean")), id_col, "left")
        .withColumn("sentiment", F.when(F.col(tokens).isNotNull(), F.coalesce("_mean", F.lit(0.0)))).drop("_mean")
    )
