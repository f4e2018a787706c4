"""Command line, meant for spark-submit: ``study``, ``report`` and ``compare`` over a folder of posts."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.functions import timeparts
from threadscope.plans import reports, study
from threadscope.session import use_utc
from threadscope.sources import files, readers, writers


def load(spark: SparkSession, path: str) -> DataFrame:
    """A post folder with the text column found by name, and its files as lineage."""
    raw = files.with_lineage(spark.read.parquet(path))
    column = readers.resolve_column(raw)
    if column is None:
        raise SystemExit("no column looks like text")
    posts = raw.withColumn("text", readers.text_or_empty(raw, column))
    if missing := readers.missing_columns(posts):
        raise SystemExit(f"missing columns: {', '.join(missing)}")
    return posts.withColumn("created_ts", timeparts.epoch_to_timestamp(F.col("created_utc")))


def main() -> None:
    parser = argparse.ArgumentParser(prog="threadscope")
    parser.add_argument("command", choices=("study", "report", "compare"))
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--steps", nargs="+", default=list(study.STEPS), choices=study.STEPS)
    parser.add_argument("--years", nargs=2, type=int, default=(2024, 2025))
    args = parser.parse_args()
    spark = use_utc(SparkSession.builder.appName("threadscope").getOrCreate())
    posts = load(spark, args.input)
    if args.command == "study":
        study.run_study(posts.drop("created_ts"), args.output, args.steps)
        return
    if args.command == "report":
        store = study.StageStore(spark, args.output)
        counts = store.save("file_counts", reports.file_counts(posts, size="file_size"))
        tables = {"files": reports.file_report(counts), "months": reports.monthly_report(counts),
                  "years": reports.yearly_report(counts), "rollup": reports.rollup_report(counts)}
    else:
        changes = reports.pct_changes(reports.compare_years(reports.tidy_years(posts, args.years), *args.years))
        tables = {"changes": changes, "top_changes": reports.top_changes(changes), "insights": reports.insights(changes)}
    for name, table in tables.items():
        writers.write_report(table, f"{args.output}/reports/{name}", mode="overwrite")


if __name__ == "__main__":
    main()
