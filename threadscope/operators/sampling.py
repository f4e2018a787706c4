"""Reproducible samples, splits and their summaries. All draws follow the md5 order of (seed, id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadscope import presets
from threadscope.operators.ranking import hash_cutoffs, hash_ranked, keep_by_hash, within_cutoff


def _rate_quota(rate: float, at_least: int):
    return lambda n: F.greatest(F.floor(n * F.lit(rate)), F.lit(at_least))


def sample_per_file_rate(df: DataFrame, rate: float = presets.SAMPLE_RATE,
                         min_rows: int = presets.MIN_ROWS_PER_FILE, file: str = "source_file",
                         ids: Sequence[str] = ("id",), seed: str = "42") -> DataFrame:
    """Per file keep ``max(floor(n * rate), min_rows)`` rows, all if there are fewer."""
    return keep_by_hash(df, [file], ids, _rate_quota(rate, min_rows), seed)


def sample_per_file_n(df: DataFrame, n: int, file: str = "source_file", ids: Sequence[str] = ("id",),
                      seed: str = "42") -> DataFrame:
    """Per file keep ``min(n, rows)`` rows."""
    return keep_by_hash(df, [file], ids, lambda _: F.lit(n), seed)


def sample_files_per_month(files: DataFrame, n: int, path: str = "path", month: Sequence[str] = ("year", "month"),
                           seed: str = "42") -> DataFrame:
    """At most n files of each month from a file list."""
    return keep_by_hash(files, month, [path], lambda _: F.lit(n), seed)


def stratified_sample(df: DataFrame, keys: Sequence[str] = ("subreddit", "month", "visa_stage"),
                      rate: float = presets.SAMPLE_RATE, ids: Sequence[str] = ("id",), seed: str = "42") -> DataFrame:
    """Per stratum keep ``max(floor(n * rate), 1)`` rows; rows with a null key belong to no stratum."""
    return keep_by_hash(df, keys, ids, _rate_quota(rate, 1), seed)


def oversample(df: DataFrame, condition: Column, factor: int = 2, ids: Sequence[str] = ("id",),
               seed: str = "42") -> DataFrame:
    """Draw ``factor * n`` rows with replacement from the n rows that meet the condition; adds ``draw``.

    Draw i picks the row whose rank is a hash of i modulo n. The i-th draws are made from the rows themselves, ``factor``
    per row, so neither n nor the draws pass through the driver.
    """
    ranked = hash_ranked(df.filter(condition), [], ids, seed)
    draws = ranked.select(
        F.explode(F.array(*[(F.col("_rank") - 1) * factor + j for j in range(factor)])).alias("draw"), "_n"
    )
    # 8 hex digits fit a long; the draw number itself is the only input, so any engine can repeat it.
    picked = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("draw").cast("string"))), 1, 8), 16, 10)
    draws = draws.select("draw", (picked.cast("long") % F.col("_n") + 1).alias("_rank"))
    return ranked.drop("_n").join(draws, "_rank").drop("_rank")


def union_samples(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, repeats included; columns a part lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def annotation_sample(df: DataFrame, n: int = 1000, keys: Sequence[str] = ("visa_stage", "subreddit"),
                      ids: Sequence[str] = ("id",), seed: str = "42") -> DataFrame:
    """Rows to annotate: per group ``max(1, floor(n * group / total))``, then n of them in hash order."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    quota = lambda size: F.greatest(F.lit(1), F.floor(F.lit(n).cast("double") * size / total))
    ranked = keep_by_hash(df, keys, ids, quota, seed)
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), *[F.col(c).cast("string") for c in ids]))
    return ranked.orderBy(order, *ids).limit(n).withColumns({
        "annotated": F.lit(False), "labels": F.lit(""), "confidence": F.lit(0.0), "annotator_notes": F.lit(""),
    })


def sampling_summary(df: DataFrame, group: str = "subreddit", stage: str = "visa_stage",
                     flags: Sequence[str] = ("has_fear", "has_question", "is_rare_event")) -> DataFrame:
    """Tidy (metric, subject, value): rows, groups, rows per stage, sum and mean of the flags.

    The rows are read once into counts per (group, stage); all figures are taken from that.
    """
    fine = df.groupBy(group, stage).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(f).alias(f) for f in flags]
    )
    levels = fine.rollup(stage).agg(
        F.grouping_id().alias("level"), F.sum("n").alias("n"), F.count_distinct(group).alias("groups"),
        *[F.sum(f).alias(f) for f in flags],
    )
    overall = [("rows", "", F.col("n")), ("groups", "", F.col("groups"))]
    overall += [("flag_sum", f, F.col(f)) for f in flags]
    overall += [("flag_mean", f, F.try_divide(F.col(f), F.col("n"))) for f in flags]
    per_stage = F.array(entry("stage_rows", F.col(stage), F.col("n")))
    return levels.select(F.inline(
        F.when(F.col("level") == 1, F.array(*[entry(*e) for e in overall])).otherwise(per_stage)
    ))


def entry(metric: str, subject: str | Column, value: Column) -> Column:
    """One row of a tidy report."""
    subject = F.lit(subject) if isinstance(subject, str) else subject.cast("string")
    return F.struct(F.lit(metric).alias("metric"), subject.alias("subject"),
                    F.round(value.cast("double"), 6).alias("value"))


def first_positive(df: DataFrame, labels: Sequence[str], out: str = "stratum") -> DataFrame:
    """Position of the first 0/1 label column that is 1; 0 if none is."""
    expr = F.lit(None).cast("int")
    for i, name in enumerate(labels):
        expr = F.coalesce(expr, F.when(F.col(name) == 1, F.lit(i)))
    return df.withColumn(out, F.coalesce(expr, F.lit(0)))


def stratified_split(df: DataFrame, stratum: str, fraction: float = 0.2, ids: Sequence[str] = ("id",),
                     seed: str = "42") -> DataFrame:
    """Add ``split``: the first ``round(fraction * n)`` rows of each stratum in hash order validate, the rest train."""
    share = lambda n: F.floor(n * F.lit(fraction) + F.lit(0.5))
    cuts = hash_cutoffs(df, [stratum], ids, share, seed)
    if cuts is None:
        ranked = hash_ranked(df, [stratum], ids, seed).withColumn("_inside", F.col("_rank") <= share(F.col("_n")))
    else:
        ranked = within_cutoff(df, cuts, [stratum], ids, seed, "left")
    return ranked.withColumn("split", F.when(F.col("_inside"), "validation").otherwise("train")).select(
        *df.columns, "split"
    )


def coverage_report(df: DataFrame, listed: DataFrame | None = None, year: str = "year", month: str = "month",
                    content_type: str = "content_type", file: str = "source_file",
                    size: str = "file_size") -> DataFrame:
    """Tidy (metric, subject, value): rows by year, month and content type, rows per file, files, bytes, success rate.

    ``listed`` is the list of files meant to be read (column ``path``); without it the files seen are the list.
    """
    fine = df.groupBy(year, month, content_type, file).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("size"))
    parts = {"rows_by_year": year, "rows_by_month": month, "rows_by_content_type": content_type, "file": file}
    level = F.lit(None).cast("string")
    subject = F.lit(None).cast("string")
    for metric, column in parts.items():
        level = F.coalesce(level, F.when(F.grouping(column) == 0, F.lit(metric)))
        subject = F.coalesce(subject, F.col(column).cast("string"))
    values = (
        fine.groupingSets([[c] for c in parts.values()], *parts.values())
        .agg(level.alias("metric"), F.sum("n").alias("n"), F.max("size").alias("size"))
        .withColumn("subject", F.when(F.col("metric") != "file", subject))
    )
    # Files fold into one more row of statistics; every other value stays a row of its own.
    stats = values.groupBy("metric", "subject").agg(
        F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"),
        F.stddev_samp("n").alias("std"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
        F.sum("n").alias("rows"),
    )
    wanted = F.col("files") if listed is None else listed.agg(F.count_distinct("path").alias("n")).scalar()
    totals = [
        ("rows_per_file", "min", F.col("min")), ("rows_per_file", "max", F.col("max")),
        ("rows_per_file", "mean", F.col("mean")), ("rows_per_file", "std", F.col("std")),
        ("total", "files", F.col("files")), ("total", "bytes", F.col("bytes")), ("total", "rows", F.col("rows")),
        ("total", "success_rate", F.try_divide(F.col("files"), wanted) * 100),
    ]
    plain = F.array(F.struct(
        F.col("metric").alias("metric"), F.col("subject").alias("subject"), F.col("rows").cast("double").alias("value")
    ))
    return stats.select(F.inline(
        F.when(F.col("metric") == "file", F.array(*[entry(*e) for e in totals])).otherwise(plain)
    ))
