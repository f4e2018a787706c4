"""Monthly and yearly lexicon reports and the comparison of two years."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from threadscope import presets
from threadscope.functions import timeparts
from threadscope.operators.tagging import tag_posts

STAGES = tuple(presets.STAGES_6_WIDE)


def _rate(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 6)


def file_counts(df: DataFrame, text: str = "text", ts: str = "created_ts", file: str = "source_file",
                size: str | None = None, stages: Mapping[str, Sequence[str]] = presets.STAGES_6_WIDE,
                fear: Sequence[str] = presets.FEAR_9, question: Sequence[str] = presets.QA_9) -> DataFrame:
    """Counts per year, month and file over every record: the one scan that all reports below start from.

    Flags are summed before the shuffle, so the exchange carries one row per task, month and file.
    """
    keys = [F.year(ts).alias("year"), F.month(ts).alias("month"), F.col(file).alias("file")]
    sizes = F.col(size) if size else F.lit(0).cast("long")
    rows = df.select(*keys, F.col(text).alias("_text"), sizes.alias("_size"))
    tagged = tag_posts(rows, "_text", fear, question, stages)
    return tagged.groupBy("year", "month", "file").agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if("has_fear").alias("total_fear"),
        F.count_if("is_question").alias("total_qa"),
        *[F.count_if(f"stage_{s}").alias(f"stage_{s}") for s in stages],
        F.max("_size").alias("file_size"),
    )


def file_report(counts: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Totals and rates per file."""
    out = counts.groupBy("file").agg(*_sums(stages))
    return _with_rates(out).select("file", *_report_columns(stages))


def monthly_report(counts: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    out = counts.groupBy("year", "month").agg(*_sums(stages), F.count_distinct("file").alias("files"))
    return _with_rates(out).select("year", "month", *_report_columns(stages), "files")


def yearly_report(counts: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Totals and rates per year with months covered, distinct files and their bytes.

    A file whose posts span several months is counted once per year.
    """
    per_file = counts.groupBy("year", "file").agg(
        *_sums(stages), F.max("file_size").alias("_bytes"), F.collect_set("month").alias("_months")
    )
    out = per_file.groupBy("year").agg(
        *_sums(stages), F.size(F.array_distinct(F.flatten(F.collect_set("_months")))).cast("long").alias("months"),
        F.count(F.lit(1)).alias("files"), F.sum("_bytes").alias("bytes"),
    )
    return _with_rates(out).select("year", *_report_columns(stages), "months", "files", "bytes")


def rollup_report(counts: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Months, years and the grand total in one table; ``level`` is month, year or all."""
    level = F.when(F.grouping("year") == 1, "all").when(F.grouping("month") == 1, "year").otherwise("month")
    out = counts.rollup("year", "month").agg(
        level.alias("level"), *_sums(stages), F.count_distinct("file").alias("files")
    )
    return _with_rates(out).select("level", "year", "month", *_report_columns(stages), "files")


def _sums(stages: Sequence[str]) -> list[Column]:
    names = ["total_records", "total_fear", "total_qa", *[f"stage_{s}" for s in stages]]
    return [F.sum(c).alias(c) for c in names]


def _with_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "fear_rate": _rate(F.col("total_fear"), F.col("total_records")),
        "qa_rate": _rate(F.col("total_qa"), F.col("total_records")),
    })


def _report_columns(stages: Sequence[str]) -> list[str]:
    return ["total_records", "total_fear", "total_qa", "fear_rate", "qa_rate", *[f"stage_{s}" for s in stages]]


def monthly_activity(df: DataFrame, ts: str = "created_ts", file: str = "source_file") -> DataFrame:
    """Rows and distinct files per calendar month; rows whose time cannot be read are left out."""
    when = F.col(ts).try_cast("timestamp")
    return (
        df.select(timeparts.month_label(when).alias("month"), F.col(file).alias("file")).filter("month is not null")
        .groupBy("month").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("file").alias("files"))
    )


def year_summary(yearly: DataFrame) -> DataFrame:
    return yearly.select(
        "year", "total_records", "total_fear", "total_qa", "fear_rate", "qa_rate",
        F.round(F.col("total_records") / F.greatest(F.col("files"), F.lit(1)), 6).alias("avg_records_per_file"),
    )


# --- two years side by side ------------------------------------------------------------------------------------------


def _in_years(df: DataFrame, ts: str, first: int, last: int) -> Column:
    """A half-open time range in the column's own type, so that it reaches the scan."""
    kind = df.schema[ts].dataType
    kind = kind.simpleString() if isinstance(kind, (TimestampType, TimestampNTZType, DateType)) else "timestamp"
    bound = lambda year: F.lit(f"{year:04d}-01-01 00:00:00").cast(kind)
    return (F.col(ts) >= bound(first)) & (F.col(ts) < bound(last + 1))


def tidy_years(df: DataFrame, years: Sequence[int], text: str = "text", ts: str = "created_ts", file: str = "source_file",
               stages: Mapping[str, Sequence[str]] = presets.STAGES_6_WIDE,
               fear: Sequence[str] = presets.FEAR_9, question: Sequence[str] = presets.QA_9) -> DataFrame:
    """Each year as (year, kind, metric, value): totals, rates, days covered and stage counts, from one scan.

    A year without rows has totals of 0.
    """
    rows = df.filter(_in_years(df, ts, min(years), max(years)) & F.year(ts).isin(*years)).select(
        F.col(text).alias("_text"), F.col(ts).alias("_ts"), F.col(file).alias("_file"))
    tagged = tag_posts(rows, "_text", fear, question, stages)
    counts = {"total_records": F.count(F.lit(1)), "total_fear": F.count_if("has_fear"), "total_qa": F.count_if("is_question"),
              **{f"stage_{s}": F.count_if(f"stage_{s}") for s in stages}}
    found = tagged.groupBy(F.year("_ts").alias("year")).agg(
        *[c.alias(name) for name, c in counts.items()], F.min("_ts").alias("_lo"), F.max("_ts").alias("_hi"))
    asked = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(y) for y in years])).alias("year"))
    every = asked.join(found, "year", "left").fillna(0, list(counts))
    days = F.floor((timeparts.micros(F.col("_hi")) - timeparts.micros(F.col("_lo"))) / 86_400_000_000) + F.lit(1)
    every = _with_rates(every).withColumn("total_days", days)
    entries = [("summary", c) for c in ("total_records", "total_fear", "total_qa", "fear_rate", "qa_rate",
                                        "total_days")]
    entries += [("stage", f"stage_{s}") for s in stages]
    return every.select("year", F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(c.removeprefix("stage_")).alias("metric"),
                 F.col(c).cast("double").alias("value"))
        for kind, c in entries
    ])))


def compare_years(tidy: DataFrame, a: int, b: int) -> DataFrame:
    """Two years side by side: (kind, metric, value_a, value_b)."""
    of = lambda year: F.max(F.when(F.col("year") == year, F.col("value")))
    return tidy.groupBy("kind", "metric").agg(of(a).alias("value_a"), of(b).alias("value_b"))


def pct_changes(compared: DataFrame) -> DataFrame:
    """Percent change per metric. Totals and stages give 0 when the first year has none; a rate then gives null.

    Stages are those of the first year.
    """
    a, b = F.col("value_a"), F.coalesce(F.col("value_b"), F.when(F.col("kind") == "stage", 0.0))
    change = F.try_divide(b - a, a) * 100
    guarded = F.when(F.col("metric").endswith("_rate"), change).otherwise(F.when(a > 0, change).otherwise(0.0))
    return compared.filter(a.isNotNull() & (F.col("metric") != "total_days")).select(
        "kind", "metric", "value_a", F.coalesce(F.col("value_b"), b).alias("value_b"),
        F.round(guarded, 6).alias("change_pct"),
    )


def stage_changes(changes: DataFrame) -> DataFrame:
    return changes.filter("kind = 'stage'").select(F.col("metric").alias("stage"), "value_a", "value_b", "change_pct")


def top_changes(changes: DataFrame, k: int = 3) -> DataFrame:
    """The k stages that changed most either way."""
    return stage_changes(changes).orderBy(F.desc(F.abs("change_pct")), "stage").limit(k)


def insights(changes: DataFrame) -> DataFrame:
    """Direction and size for volume, fear and questions, and the stages that grew and shrank most."""
    pct = F.col("change_pct")
    names = {"total_records": "volume", "fear_rate": "fear", "qa_rate": "questions"}
    subject = F.coalesce(*[F.when(F.col("metric") == m, F.lit(s)) for m, s in names.items()])
    trend = changes.filter(F.col("metric").isin(*names) & pct.isNotNull()).select(
        F.lit("trend").alias("kind"), subject.alias("subject"), pct.alias("value"),
        F.when(pct > 0, "increased").otherwise("decreased").alias("direction"),
    )
    stages = stage_changes(changes).agg(
        F.max_by(F.struct("stage", "change_pct"), F.struct(pct, F.col("stage"))).alias("up"),
        F.min_by(F.struct("stage", "change_pct"), F.struct(pct, F.col("stage"))).alias("down"),
    ).select(F.inline(F.array(
        F.struct(F.lit("largest_increase").alias("kind"), F.col("up.stage").alias("subject"),
                 F.col("up.change_pct").alias("value"), F.lit("increased").alias("direction")),
        F.struct(F.lit("largest_decrease").alias("kind"), F.col("down.stage").alias("subject"),
                 F.col("down.change_pct").alias("value"), F.lit("decreased").alias("direction")),
    ))).filter("(kind = 'largest_increase' and value > 0) or (kind = 'largest_decrease' and value < 0)")
    return trend.unionByName(stages).withColumn(
        "text", F.format_string("%s %s by %.1f%%", "subject", "direction", F.abs("value"))
    )
