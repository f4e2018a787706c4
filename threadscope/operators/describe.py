"""Descriptive tables: counts over time, groups, sentiment, cross tables, quality."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement
from math import isfinite, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from threadscope import presets
from threadscope.functions import timeparts
from threadscope.operators.cleaning import weighted_std
from threadscope.operators.words import word_counts, within_largest


def time_distribution(df: DataFrame, ts: str = "created_ts", by: Sequence[str] = (),
                      units: Sequence[str] = ("year", "month", "weekday", "hour")) -> DataFrame:
    """Rows per value of each unit as (keys, unit, value, n), from one scan with grouping sets."""
    exprs = {
        "year": F.year(ts), "month": F.month(ts), "weekday": timeparts.weekday_name(F.col(ts)), "hour": F.hour(ts),
        "quarter": F.quarter(ts),
    }
    parts = df.select(*by, *[exprs[u].cast("string").alias(f"_{u}") for u in units])
    cols = [f"_{u}" for u in units]
    unit = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(u)) for u, c in zip(units, cols)])
    return (
        parts.groupingSets([[*by, c] for c in cols], *by, *cols)
        .agg(unit.alias("unit"), F.coalesce(*cols).alias("value"), F.count(F.lit(1)).alias("n"))
        .drop(*cols).filter("value is not null").select(*by, "unit", "value", "n")
    )


def time_distribution_by(df: DataFrame, key: str, ts: str = "created_ts", skip: Sequence[str] = (presets.UNKNOWN,),
                         largest: int | None = None) -> DataFrame:
    """Year and month-of-year counts per key value, without ``skip``, or for the largest values only."""
    rows = df.filter(~F.col(key).isin(*skip)) if skip else df
    rows = within_largest(rows, key, largest) if largest else rows
    return time_distribution(rows, ts, (key,), ("year", "month"))


def date_range(df: DataFrame, ts: str = "created_ts") -> DataFrame:
    """First and last time, and whole 24-hour blocks between them plus one."""
    return df.agg(F.min(ts).alias("start"), F.max(ts).alias("end")).withColumn(
        "days",
        F.floor((timeparts.micros(F.col("end")) - timeparts.micros(F.col("start"))) / 86_400_000_000) + F.lit(1),
    )


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, ties by value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col(column).isNotNull())
    ordered = counts.orderBy(F.desc("n"), column)
    return ordered.limit(k) if k else ordered


def group_profile(df: DataFrame, key: str = "subreddit", stage: str = "visa_stage", words: str = "word_count",
                  text: str = "processed_text", k: int = 20) -> DataFrame:
    """The k largest groups: rows, mean words, mean text length, and rows per stage (one row per group and stage)."""
    fine = df.groupBy(key, stage).agg(
        F.count(F.lit(1)).alias("stage_posts"), F.sum(words).alias("_w"), F.count(words).alias("_wn"),
        F.sum(F.length(text)).alias("_l"), F.count(text).alias("_ln"),
    )
    group = Window.partitionBy(key)
    total = lambda c: F.sum(c).over(group)
    return within_top(
        fine.select(
            key, total("stage_posts").alias("posts"),
            F.round(F.try_divide(total("_w"), total("_wn")), 6).alias("avg_word_count"),
            F.round(F.try_divide(total("_l"), total("_ln")), 6).alias("avg_text_length"),
            stage, "stage_posts",
        ),
        key, k,
    )


def within_top(profile: DataFrame, key: str, k: int) -> DataFrame:
    """Rows of the k groups with the largest ``posts``; the list of groups is bounded by k."""
    top = profile.groupBy(key).agg(F.max("posts").alias("p")).orderBy(F.desc("p"), key).limit(k).select(key)
    return profile.join(F.broadcast(top), key, "left_semi")


def n_distinct(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column as (column, n)."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    one = df.agg(*[count(c).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns
    ])))


def distinct_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("year", "month"), lg_k: int = 14) -> DataFrame:
    """A mergeable sketch of the distinct values of each column per period: ``by, column, sketch``, 16 KB each at most.

    Meant to be stored once and united for any range by :func:`distinct_from_sketches`; exact counts are
    :func:`n_distinct`. Nulls are no value.
    """
    made = df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(f"_{i}") for i, c in enumerate(columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("sketch")) for i, c in enumerate(columns)])
    return made.select(*by, F.inline(each))


def distinct_from_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct values per column (and ``by``) over all sketches given, within about 1 % at the default size."""
    united = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy(*by, "column").agg(united.alias("n"))


def sentiment_summary(df: DataFrame, by: Sequence[str] = (), column: str = "sentiment",
                      threshold: float = presets.SENTIMENT_THRESHOLD) -> DataFrame:
    """Mean, sample deviation, share above and below the threshold; overall or per key."""
    s = F.col(column)
    return df.groupBy(*by).agg(
        F.round(F.avg(s), 6).alias("mean"), F.round(F.stddev_samp(s), 6).alias("std"),
        F.round(F.avg(F.coalesce(s > threshold, F.lit(False)).cast("int")), 6).alias("positive_ratio"),
        F.round(F.avg(F.coalesce(s < -threshold, F.lit(False)).cast("int")), 6).alias("negative_ratio"),
    )


def sentiment_by(df: DataFrame, key: str, skip: Sequence[str] = (presets.UNKNOWN,), largest: int | None = None,
                 column: str = "sentiment") -> DataFrame:
    """Sentiment per key value, without ``skip``; with ``largest`` just mean and deviation of the largest groups."""
    rows = df.filter(~F.col(key).isin(*skip)) if skip else df
    if largest:
        return sentiment_summary(within_largest(rows, key, largest), [key], column).select(key, "mean", "std")
    return sentiment_summary(rows, [key], column)


def crosstab(df: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """Rows of ``a`` by listed values of ``b``, zero filled. The list keeps the pivot free of an extra job."""
    return df.groupBy(a).pivot(b, list(values)).agg(F.count(F.lit(1))).na.fill(0, subset=list(values))


def cooccurrence_edges(df: DataFrame, a: str, b: str) -> DataFrame:
    """Weighted edges between two columns."""
    return df.dropna(subset=[a, b]).groupBy(
        F.col(a).alias("source"), F.col(b).alias("target")
    ).agg(F.count(F.lit(1)).alias("weight"))


def cooccurrence_nodes(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Typed nodes of the edge table."""
    ends = F.array(
        F.struct(F.col("source").alias("node"), F.lit(a).alias("node_type")),
        F.struct(F.col("target").alias("node"), F.lit(b).alias("node_type")),
    )
    return edges.select(F.inline(ends)).distinct()


def _bounds(df: DataFrame, value: Column) -> tuple[Column, Column]:
    pair = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("b")).scalar()
    return pair.getField("lo"), pair.getField("hi")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Rows per equal-width bin (1 to ``bins``, the maximum in the last); empty bins have no row."""
    x = F.col(column).cast("double")
    lo, hi = _bounds(df, x)
    width = (hi - lo) / F.lit(bins)
    bin_no = F.when(hi == lo, F.lit(1)).otherwise(F.least(F.floor(F.try_divide(x - lo, width)) + 1, F.lit(bins)))
    return df.filter(x.isNotNull()).groupBy(bin_no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair (both orders); a pair uses the rows where both are set.

    Without a list, all numeric columns of the table. A first pass takes counts and means. The second adds up products
    of what is left after the means, which keeps figures with a large mean and a small spread exact. Where neither
    column has nulls a pair needs one sum; where one has, its count, sums and squares are those of the pair's own rows.
    Pairs go in blocks, as one aggregate of all of them is too wide for generated code; a block reads its own columns.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    first = df.agg(F.count(F.lit(1)).alias("n"), *[
        f for i, c in enumerate(columns) for f in (F.count(c).alias(f"n{i}"), F.avg(F.col(c).cast("double")).alias(f"m{i}"))
    ]).collect()[0]  # one row
    whole = [first[f"n{i}"] == first["n"] for i in range(len(columns))]
    mean = [first[f"m{i}"] if first[f"m{i}"] is not None and isfinite(first[f"m{i}"]) else 0.0 for i in range(len(columns))]
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    rows = [row for at in range(0, len(pairs), PAIRS) for row in _correlations(df, columns, mean, whole, pairs[at:at + PAIRS])]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


PAIRS = 40


def _correlations(df: DataFrame, columns: Sequence[str], mean: Sequence[float], whole: Sequence[bool],
                  pairs: Sequence[tuple[int, int]]) -> list[tuple[str, str, float | None]]:
    """(a, b, r) from one row of sums."""
    used = sorted({i for pair in pairs for i in pair})

    def centred(i: int) -> Column:
        x = F.col(columns[i]).cast("double") - F.lit(mean[i])
        return (F.coalesce(x, F.lit(0.0)) if whole[i] else x).alias(f"x{i}")  # known not to be null: shorter code

    sums: dict[str, Column] = {}  # named by what they add up, so that pairs share them

    def total(name: str, value: Column, j: int) -> str:
        """Sum over the rows where column j is set as well; ``value`` is null where its own column is."""
        name = name if whole[j] else f"{name} where {j}"
        sums.setdefault(name, F.sum(value if whole[j] else F.when(F.col(f"x{j}").isNotNull(), value)))
        return name

    figures = {}
    for i, j in pairs:
        x, y = F.col(f"x{i}"), F.col(f"x{j}")
        n = "n" if whole[i] and whole[j] else f"n {i} {j}"
        sums.setdefault(n, F.count(F.lit(1)) if n == "n" else F.count_if(x.isNotNull() & y.isNotNull()))
        sums.setdefault(f"p {i} {j}", F.sum(x * y))
        figures[i, j] = (n, total(f"s{i}", x, j), total(f"s{j}", y, i), total(f"q{i}", x * x, j), total(f"q{j}", y * y, i), f"p {i} {j}")
    one = df.select(*[centred(i) for i in used]).agg(*[value.alias(name) for name, value in sums.items()]).collect()[0].asDict()
    out = []
    for (i, j), names in figures.items():
        n, sx, sy, sxx, syy, sxy = (one[name] for name in names)
        r = None
        if n > 1:
            # A spread that is all rounding is none: the column is constant in these rows, and r undefined.
            vx, vy = (q - s * s / n for s, q in ((sx, sxx), (sy, syy)))
            if vx > n * (abs(mean[i]) * 1e-12) ** 2 and vy > n * (abs(mean[j]) * 1e-12) ** 2:
                r = round((sxy - sx * sy / n) / sqrt(vx) / sqrt(vy), 6)
        out += [(columns[a], columns[b], r) for a, b in dict.fromkeys([(i, j), (j, i)])]
    return out


def quality_report(df: DataFrame, text_columns: Sequence[str], time_columns: Sequence[str]) -> DataFrame:
    """Tidy (check, column, n): nulls, empty texts, unparsable times, repeated rows.

    Repeated rows are counted by a 256-bit digest, so no row's content is shuffled; all other checks are one aggregate.
    """
    checks: list[tuple[str, str, Column]] = [("null", c, F.count_if(F.col(c).isNull())) for c in df.columns]
    checks += [("empty_text", c, F.count_if(F.trim(F.col(c)) == "")) for c in text_columns]
    checks += [
        ("invalid_timestamp", c,
         F.count_if(F.col(c).isNull() | F.col(c).cast("string").try_cast("timestamp").isNull())) for c in time_columns
    ]
    one = df.agg(*[v.alias(f"_{i}") for i, (_, _, v) in enumerate(checks)])
    found = one.select(F.inline(F.array(*[
        F.struct(F.lit(kind).alias("check"), F.lit(c).alias("column"), F.col(f"_{i}").alias("n"))
        for i, (kind, c, _) in enumerate(checks)
    ])))
    row = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    copies = df.groupBy(F.sha2(row, 256)).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    return found.unionByName(copies.select(F.lit("duplicate_rows").alias("check"), F.lit("").alias("column"), F.col("n").cast("long").alias("n")))


def text_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Length statistics of a text column; the exact median comes from counts per distinct length."""
    lengths = df.groupBy(F.length(text).alias("len")).agg(F.count(F.lit(1)).alias("n")).filter("len is not null")
    return lengths.agg(
        F.min("len").alias("min_length"), F.max("len").alias("max_length"),
        F.round(F.try_divide(F.sum(F.col("len") * F.col("n")), F.sum("n")), 6).alias("mean_length"),
        F.round(weighted_std("len", "n"), 6).alias("std_length"),
        F.expr("round(percentile(len, 0.5, n), 6)").alias("median_length"),
    )


def vocabulary_size(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    return word_counts(df, (), tokens).agg(F.count(F.lit(1)).alias("vocabulary_size"))


def group_size_stats(df: DataFrame, key: str = "subreddit") -> DataFrame:
    """Number of groups and the smallest, largest and mean group."""
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("groups"), F.min("n").alias("min_posts"), F.max("n").alias("max_posts"),
        F.round(F.avg("n"), 6).alias("mean_posts"),
    )
