"""Streams over arriving post files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from threadscope import presets
from threadscope.operators.tagging import tag_posts


def post_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 50,
                glob: str | None = None) -> DataFrame:
    """New Parquet files below a folder, some per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def start(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, then stop; the checkpoint lets the next start go on where this one ended."""
    return (
        df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(target)
    )


def ingest_stream(posts: DataFrame, target: str, checkpoint: str, text: str = "text",
                  fear: Sequence[str] = presets.FEAR_9, question: Sequence[str] = presets.QA_9,
                  stages: Mapping[str, Sequence[str]] = presets.STAGES_6_WIDE) -> StreamingQuery:
    """Tag arriving posts exactly as the batch operators do and append them."""
    return start(tag_posts(posts, text, fear, question, stages), target, checkpoint)


def ingest_batches(posts: DataFrame, target: str, text: str = "text", fear: Sequence[str] = presets.FEAR_9,
                   question: Sequence[str] = presets.QA_9,
                   stages: Mapping[str, Sequence[str]] = presets.STAGES_6_WIDE) -> StreamingQuery:
    """As :func:`ingest_stream`, batch by batch into folders of their own, each entered into a ledger once it is whole.

    A batch that is run again, after a loss between its write and its entry, replaces its folder, so its rows are there
    once; :func:`committed` reads entered batches only. Checkpoint, rows and ledger lie below ``target``, as the
    numbers of batches mean nothing without their checkpoint. An empty batch leaves an empty folder.
    """

    def save(batch: DataFrame, number: int) -> None:
        path = f"{target}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        _enter(batch.sparkSession, target, number, batch.sparkSession.read.parquet(path).count())

    tagged = tag_posts(posts, text, fear, question, stages)
    writer = tagged.writeStream.foreachBatch(save).option("checkpointLocation", f"{target}/checkpoint")
    return writer.trigger(availableNow=True).start()


def _enter(spark: SparkSession, target: str, number: int, rows: int) -> None:
    entry = spark.range(1).select(F.lit(rows).cast("long").alias("rows"))
    entry.write.mode("overwrite").parquet(f"{target}/ledger/batch={number}")


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """Entered batches with their rows."""
    return spark.read.schema("rows long, batch long").parquet(f"{target}/ledger")


def committed(spark: SparkSession, target: str) -> DataFrame:
    """Rows of the batches in the ledger; folders of other batches are not opened."""
    rows = spark.read.parquet(f"{target}/rows").withColumn("batch", F.col("batch").cast("long"))
    return rows.join(ledger(spark, target).select("batch"), "batch", "left_semi").drop("batch")


def live_counts(posts: DataFrame, ts: str = "created_ts", text: str = "text", delay: str = "1 hour",
                stages: Mapping[str, Sequence[str]] = presets.STAGES_6_WIDE) -> DataFrame:
    """Posts, fear, question and stage counts per UTC day; a day is emitted once the watermark has passed its end, and
    rows later than that are dropped."""
    tagged = tag_posts(posts.select(ts, text), text, stages=stages)
    return (
        tagged.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"))
        .agg(
            F.count(F.lit(1)).alias("total_records"), F.count_if("has_fear").alias("total_fear"),
            F.count_if("is_question").alias("total_qa"),
            *[F.count_if(f"stage_{s}").alias(f"stage_{s}") for s in stages],
        )
        .select(F.to_date("window.start").alias("day"), "total_records", "total_fear", "total_qa",
                *[f"stage_{s}" for s in stages])
    )


def stream_dedupe(posts: DataFrame, keys: Sequence[str] = ("text", "subreddit"), ts: str = "created_ts",
                  delay: str = "1 day") -> DataFrame:
    """First row per key within the watermark. A copy that arrives later than that passes; the batch ``dedupe`` removes
    those too. State holds a hash of the keys, not the texts."""
    hashed = posts.withColumn("_key", F.sha2(F.to_json(F.struct(*keys)), 256)).withWatermark(ts, delay)
    return hashed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def stream_first(posts: DataFrame, keys: Sequence[str] = ("text", "subreddit"), ts: str = "created_ts",
                 order: Sequence[str] = ("id",), delay: str = "1 day") -> DataFrame:
    """First row per key by its time, then by ``order``, whatever the order of arrival.

    Copies that follow one another within ``delay`` are one group, a session; its first row comes out once the watermark,
    ``delay`` behind the latest time, has passed its last copy by ``delay``. Rows behind the watermark are late and
    dropped, and so are rows without a time. State holds one row per open group. All columns must be sortable (no maps).
    """
    rest = [c for c in posts.columns if c != ts and c not in order]
    hashed = posts.withColumn("_key", F.sha2(F.to_json(F.struct(*keys)), 256)).withWatermark(ts, delay)
    first = hashed.groupBy(F.session_window(ts, delay), "_key").agg(F.min(F.struct(ts, *order, *rest)).alias("_row"))
    return first.select(*[F.col(f"_row.{c}").alias(c) for c in posts.columns])
