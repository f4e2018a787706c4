"""Readers for post tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from threadscope import presets
from threadscope.operators.sampling import union_samples
from threadscope.session import scratch_path

POST_SCHEMA = StructType([
    StructField("id", StringType()), StructField("text", StringType()), StructField("subreddit", StringType()),
    StructField("author", StringType()), StructField("created_utc", StringType()),
])


def read_posts(spark: SparkSession, base: str, years: Sequence[int] | None = None,
               months: Sequence[int] | None = None, schema: StructType | None = None) -> DataFrame:
    """Parquet in ``year=/month=`` folders; the filters prune folders before any file is opened."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(base)
    if years:
        df = df.filter(F.col("year").isin(*years))
    if months:
        df = df.filter(F.col("month").isin(*months))
    return df


def spread_small(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has cores, such as one small file with a single row group.

    Looks at the planned splits only; an input with enough of them stays as it is and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def read_json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str = POST_SCHEMA) -> DataFrame:
    """One JSON object per line."""
    return spark.read.schema(schema).json(path)


def _invalid_utf8_files(spark: SparkSession, paths: Sequence[str]) -> set[str]:
    """Names of the listed files with a line that is not UTF-8; the check itself runs on the executors."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), "value")
    bad = lines.filter(~F.is_valid_utf8("value")).select("path").distinct()
    return {r.path for r in bad.collect()}


def read_csv_tolerant(spark: SparkSession, paths: Sequence[str], columns: Sequence[str],
                      multi_line: bool = True, header: bool = True) -> DataFrame:
    """CSV, all columns as strings; rows with too many fields are skipped, short rows are padded.

    A file with invalid UTF-8 is read as Latin-1. ``multi_line`` allows line breaks inside quotes, as forum text has
    them; a file is then read by one task. Turn it off to split big files without such breaks.
    """
    bad = {_bare(p) for p in _invalid_utf8_files(spark, paths)}
    groups = {
        "UTF-8": [p for p in paths if _bare(p) not in bad],
        "ISO-8859-1": [p for p in paths if _bare(p) in bad],
    }
    parts = [_read_csv(spark, p, columns, enc, multi_line, header) for enc, p in groups.items() if p]
    return union_samples(*parts)


def _bare(path: str) -> str:
    return "/" + path.split(":", 1)[-1].lstrip("/")


def _read_csv(spark: SparkSession, paths: list[str], columns: Sequence[str], encoding: str,
              multi_line: bool, header: bool) -> DataFrame:
    schema = StructType([StructField(c, StringType()) for c in (*columns, "_line")])
    rows = (
        spark.read.schema(schema).option("header", str(header).lower()).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_line").option("encoding", encoding)
        .option("multiLine", str(multi_line).lower()).option("escape", '"').option("columnPruning", "false")
        .csv(paths)
    )
    extra = _too_many("_line", len(columns))
    # Always true, but it keeps a value column in the scan, without which Spark refuses to read the marks (as in a count).
    any_value = F.coalesce(F.length(columns[0]), F.lit(0)) >= 0
    return rows.filter(any_value & (F.col("_line").isNull() | ~extra)).select(*columns)


def _too_many(line: str, columns: int) -> Column:
    """Whether a record has too many fields. Both short and long rows arrive marked; only the long ones have more
    separators outside quotes than columns allow. A doubled quote inside quotes just ends one quoted run and starts the
    next."""
    outside = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(F.regexp_replace(outside, "[^,]", "")) >= columns


BLOCKS_BROADCAST = 400_000  # of about 150 bytes each: 60 MB
_BLOCK = ["_file", "_start", "_length"]


def read_csv_folder(spark: SparkSession, path: str | list[str], columns: Sequence[str], header: bool = True,
                    glob: str = "*.csv", max_blocks: int = BLOCKS_BROADCAST) -> DataFrame:
    """As :func:`read_csv_tolerant`, for whole folders, and many tasks read one big file though quoted text has line breaks.

    Files are read as lines in Spark's usual splits. A line break ends a record if an even number of quotes stands before
    it in the file; a first pass counts quotes per split, their running sum tells how each split begins, and lines of
    one record are joined. Only lines of records with line breaks are shuffled, each record by itself.

    Quotes must be written as the format asks: around a field, doubled inside it. One that never closes takes the rest
    of its file into one record, as in every CSV reader. Line breaks inside a field stay as they are; blank records are
    skipped. A file with invalid UTF-8 anywhere is read as Latin-1. No file, or empty ones, give no rows. Splits that
    differ between the two passes (the cluster grew in between) end the job; the next try reads them anew.
    """
    scan = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    )
    meta = {"_file": "file_path", "_start": "file_block_start", "_length": "file_block_length"}
    place = [F.col(f"_metadata.{source}").alias(name) for name, source in meta.items()]
    quotes = (F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))).cast("long").alias("_quotes")
    valid = F.is_valid_utf8("value").alias("_valid")

    blocks = _csv_blocks(_running(scan.select(*place, quotes, valid)))
    saved = scratch_path(spark, "csv-blocks")
    blocks.write.parquet(saved)
    blocks = spark.read.parquet(saved)
    if blocks.count() <= max_blocks:
        blocks = F.broadcast(blocks)
    # Bytes, as a file in another encoding is decoded only after its split is known.
    lines = _running(scan.select(*place, quotes, F.col("value").cast("binary").alias("_bytes"))).join(blocks, _BLOCK, "left")
    known = F.when(F.col("_odd").isNull(), F.raise_error(F.lit("files were split otherwise in the first pass"))).otherwise(F.col("_odd"))
    text = F.when(F.col("_latin"), F.decode("_bytes", "ISO-8859-1")).otherwise(F.col("_bytes").cast("string"))
    inside = (F.col("_before") + known) % 2 == 1
    begun = F.when(F.col("_odd") == 0, F.col("_even_lines")).otherwise(F.col("_line") - F.col("_even_lines"))
    lines = lines.select("_file", "_start", "_line", "_quotes", text.alias("_text"), inside.alias("_inside"), begun.alias("_begun"),
                         "_last_start", "_last_begun")

    single = lines.filter(~F.col("_inside") & (F.col("_quotes") % 2 == 0)).select(
        "_text", F.col("_start").alias("_at"), F.col("_begun").alias("_nth"))
    several = lines.filter(F.col("_inside") | (F.col("_quotes") % 2 == 1))
    here = F.col("_begun") > 0
    joined = several.groupBy(
        "_file", F.when(here, F.col("_start")).otherwise(F.col("_last_start")).alias("_at"),
        F.when(here, F.col("_begun")).otherwise(F.col("_last_begun")).alias("_nth"),
    ).agg(F.sort_array(F.collect_list(F.struct("_start", "_line", "_text"))).alias("_lines"))
    records = single.unionByName(joined.select(F.array_join("_lines._text", "\n").alias("_text"), "_at", "_nth"))

    first = (F.col("_at") == 0) & (F.col("_nth") == 1)
    if header:
        records = records.filter(~first)
    bare = F.regexp_replace(F.when(first, F.ltrim("_text", F.lit("\ufeff"))).otherwise(F.col("_text")), r"\r\z", "")
    schema = ", ".join(f"`{c}` string" for c in (*columns, "_line"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line", "escape": '"'}
    parsed = records.select(bare.alias("_text")).filter(F.trim("_text") != "").select(
        F.from_csv("_text", schema, options).alias("_row")).select("_row.*")
    return parsed.filter(F.col("_line").isNull() | ~_too_many("_line", len(columns))).select(*columns)


def _running(lines: DataFrame) -> DataFrame:
    """Add, per line and within its split: its number from 1, the quotes before it, and how many lines up to it have an
    even number of quotes before them. Lines keep the order of the file inside a task, which no shuffle would keep."""
    added = [StructField(c, LongType()) for c in ("_line", "_before", "_even_lines")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, carried = None, (0, 0, 0)
        for batch in batches:
            starts = np.concatenate(([0], _changes(batch), [batch.num_rows]))
            sums = [np.empty(batch.num_rows, np.int64) for _ in added]
            quotes = batch["_quotes"].to_numpy()
            for lo, hi in zip(starts[:-1], starts[1:]):
                if lo == hi:
                    continue
                here = tuple(batch[c][int(lo)].as_py() for c in _BLOCK)
                line, before, even = carried if here == block else (0, 0, 0)
                sums[0][lo:hi] = line + np.arange(1, hi - lo + 1)
                total = before + np.cumsum(quotes[lo:hi])
                sums[1][lo:hi] = total - quotes[lo:hi]
                sums[2][lo:hi] = even + np.cumsum(sums[1][lo:hi] % 2 == 0)
                block, carried = here, (int(sums[0][hi - 1]), int(total[-1]), int(sums[2][hi - 1]))
            names = [*batch.schema.names, *[f.name for f in added]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, sums)], names=names)

    return lines.mapInArrow(count, StructType([*lines.schema.fields, *added]))


def _changes(batch: pa.RecordBatch) -> np.ndarray:
    """Rows at which another split begins; splits are compared by their start, length and file."""
    if batch.num_rows < 2:
        return np.empty(0, np.int64)
    new = np.zeros(batch.num_rows - 1, bool)
    for column in _BLOCK:
        values = batch[column]
        new |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def _csv_blocks(lines: DataFrame) -> DataFrame:
    """Per split: whether it begins inside quotes, the last record begun before it, and whether its file is Latin-1."""
    totals = lines.groupBy(*_BLOCK).agg(
        F.sum("_quotes").alias("_quotes"), F.max("_line").alias("_lines"), F.max("_even_lines").alias("_even"),
        F.bool_or(~F.col("_valid")).alias("_invalid"))
    file = Window.partitionBy("_file")
    earlier = file.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    odd = totals.withColumn("_odd", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2).withColumn(
        "_begins", F.when(F.col("_odd") == 0, F.col("_even")).otherwise(F.col("_lines") - F.col("_even")))
    last = F.last(F.when(F.col("_begins") > 0, F.struct("_start", "_begins")), ignorenulls=True).over(earlier)
    return odd.select(*_BLOCK, "_odd", F.max("_invalid").over(file).alias("_latin"), last.alias("_last")).select(
        *_BLOCK, "_odd", "_latin", F.col("_last._start").alias("_last_start"), F.col("_last._begins").alias("_last_begun"))


def read_lenient_parquet(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Parquet where an unreadable or vanished file gives no rows instead of ending the job."""
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return reader.option("recursiveFileLookup", "true").parquet(*([path] if isinstance(path, str) else path))


def resolve_column(df: DataFrame, parts: Sequence[str] = presets.TEXT_NAME_PARTS) -> str | None:
    """First column whose lower-cased name contains one of the parts; looks at the schema only."""
    return next((c for c in df.columns if any(p in c.lower() for p in parts)), None)


def text_or_empty(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def missing_columns(df: DataFrame, required: Sequence[str] = presets.REQUIRED_COLUMNS) -> list[str]:
    return [c for c in required if c not in df.columns]


def schema_violations(df: DataFrame, required: Sequence[str] = presets.REQUIRED_COLUMNS) -> DataFrame:
    """Rows that miss a required value, per column; a column that is absent misses it in every row."""
    absent = set(missing_columns(df, required))
    one = df.agg(*[
        F.count(F.lit(1)).alias(c) if c in absent else F.count_if(F.col(c).isNull()).alias(c) for c in required
    ])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(c not in absent).alias("present"), F.col(c).alias("violations"))
        for c in required
    ])))
