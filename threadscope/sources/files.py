"""File lists as DataFrames: discovery, the first n, lineage and failure reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.session import scratch_path


def discover_files(spark: SparkSession, root: str, suffixes: Sequence[str] = (".parquet", ".csv")) -> DataFrame:
    """All files below a folder with one of the suffixes: path, size, suffix, and year and month taken from the path.

    Only file metadata is read; the content column of the source is pruned.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(root)
    )
    part = lambda name: F.nullif(F.regexp_extract("path", rf"/{name}=(\d+)(?:/|$)", 1), F.lit("")).cast("int")
    return listed.select(
        "path", F.col("length").alias("file_size"),
        F.concat(F.lit("."), F.substring_index("path", ".", -1)).alias("suffix"),
        part("year").alias("year"), part("month").alias("month"),
    )


def first_files(files: DataFrame, n: int) -> DataFrame:
    """The first n files by path."""
    return files.orderBy("path").limit(n)


def paths_of(files: DataFrame) -> list[str]:
    """Paths of a file list as reader input. Spark's readers take names from the driver, a few hundred bytes each; for
    whole folders give the reader the folder instead."""
    return [r.path for r in files.select("path").orderBy("path").toLocalIterator()]


def with_lineage(df: DataFrame) -> DataFrame:
    """Add source file and its size. Call it right after the read, while file metadata is available."""
    return df.select("*", F.col("_metadata.file_path").alias("source_file"),
                     F.col("_metadata.file_size").alias("file_size"))


FILES_BROADCAST = 500_000


def with_file_rows(df: DataFrame, file: str = "source_file", rate: float | None = None,
                   blocks: int = 64, max_files: int = FILES_BROADCAST) -> DataFrame:
    """Add ``total_rows`` of the file each row came from, and the sample rate if given.

    The counts, one row a file, are saved and broadcast, so no row moves. Beyond ``max_files`` files they are joined
    back on (file, block), so one huge file spreads over ``blocks`` join keys.
    """
    path = scratch_path(df.sparkSession, "file-rows")
    df.groupBy(file).agg(F.count(F.lit(1)).alias("total_rows")).write.parquet(path)
    counts = df.sparkSession.read.parquet(path)
    if counts.count() <= max_files:
        out = df.join(F.broadcast(counts), file, "left")
    else:
        block = F.pmod(F.xxhash64(*df.columns), F.lit(blocks)).cast("int")
        salted = counts.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        out = df.withColumn("_block", block).join(salted, [file, "_block"], "left").drop("_block")
    return out if rate is None else out.withColumn("sample_rate", F.lit(rate))


EMPTY_BYTES = 16 << 20  # a Parquet file without rows is its footer; bigger ones are reported unopened


def failure_report(files: DataFrame, rows: DataFrame, file: str = "source_file") -> DataFrame:
    """Listed files from which no row was read: unreadable or empty ones, but no whole Parquet file that just has no rows.

    Writers leave such files where a task had nothing to write. They hold a footer and no data between the marks at both ends;
    only files without rows are opened to see it.
    """
    spark = files.sparkSession
    name = lambda c: F.substring_index(c, ":", -1)  # noqa: E731  file:/x and file:///x are the same file
    clean = lambda c: F.regexp_replace(name(c), "^/+", "/")
    seen = rows.select(clean(F.col(file)).alias("_seen")).distinct()
    saved = scratch_path(spark, "unread-files")
    files.join(seen, clean(F.col("path")) == F.col("_seen"), "left_anti").write.parquet(saved)
    unread = spark.read.parquet(saved)
    paths = paths_of(unread)
    if not paths:
        return unread
    mark = F.lit(b"PAR1")
    digits = F.hex(F.substring("content", -8, 4))  # length of the footer, smallest byte first
    footer = F.conv(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    whole = (F.substring("content", 1, 4) == mark) & (F.substring("content", -4, 4) == mark) & (footer + 12 == F.col("length"))
    opened = spark.read.format("binaryFile").load(paths).filter((F.col("length") >= 12) & (F.col("length") <= EMPTY_BYTES))
    rowless = opened.filter(whole).select(F.col("path").alias("_rowless"))
    return unread.join(rowless, clean(F.col("path")) == clean(F.col("_rowless")), "left_anti")
