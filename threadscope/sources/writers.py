"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Snappy Parquet. With partition columns the rows are rebalanced on them first: few files per folder, and a folder
    with a third of the rows is still split over several tasks."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def all_string(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def write_csv_all_string(df: DataFrame, csv_path: str, parquet_path: str | None = None,
                         mode: str = "errorifexists") -> None:
    """Every column as string, to CSV and then Parquet."""
    rows = all_string(df)
    rows.write.mode(mode).option("header", "true").option("escape", '"').csv(csv_path)
    if parquet_path:
        rows.write.mode(mode).parquet(parquet_path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row of a report."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report table as JSON lines."""
    df.write.mode(mode).json(path)
