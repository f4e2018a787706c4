"""Views that turn the driver tables into post tables, for Spark here and for SQL in ``sql.py``."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope import presets
from threadscope.operators import cleaning, labelling, tagging
from threadscope.plans.study import StageStore
from threadscope.session import scratch_path, use_utc
from threadscope.sources.readers import spread_small

PHRASES = {
    0: " I am worried my H1B will be denied. What should I do?",
    1: " How long does STEM OPT take? See https://a.example/x~y#z",
    2: " **Green card** approved, thanks u/some_user and r/USCIS",
    3: " Scared about the naturalization interview!!!",
    4: " [guide](https://b.example/p) for the I-140 and `code` 😀",
}
GROUPS = {"src0": "F1Visa", "src1": "h1b", "src2": "greencard", "src3": "citizenship", "src4": "immigrationnews"}

# Text tables, whose rows are expensive to process, and a unique key of each.
TEXT_KEYS = {"documents": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn")}

# Events inside the time span of the test tables.
TEST_EVENTS = (presets.PolicyEvent("spring_rule", date(2024, 6, 22)), presets.PolicyEvent("new_year", date(2025, 1, 20)),
               presets.PolicyEvent("edge_rule", date(2025, 11, 6)))
ORDER_EVENTS = (presets.PolicyEvent("early", date(1996, 1, 27)), presets.PolicyEvent("late", date(2001, 7, 20)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


_ROWS: dict[tuple[str, str], int] = {}


def rows_in(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Row count of a driver table, from its footers."""
    if (sf_dir, name) not in _ROWS:
        _ROWS[sf_dir, name] = spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    return _ROWS[sf_dir, name]


BROADCAST_TIMES = 4_000_000  # documents; the time of each takes about 40 bytes of a broadcast


def posts(spark: SparkSession, sf_dir: str, texts_stay: bool = False) -> DataFrame:
    """Documents as posts: phrases with known hits appended, five groups renamed, times spread over 24 months.

    ``texts_stay`` sends the times to the texts, up to ``BROADCAST_TIMES`` documents; for queries that take little else from events.
    """
    docs, events = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    step = rows_in(spark, sf_dir, "events") // rows_in(spark, sf_dir, "documents")
    phrase = F.lit("")
    for rest, words in PHRASES.items():
        phrase = F.when(F.col("doc_id") % 8 == rest, F.lit(words)).otherwise(phrase)
    group = F.col("source")
    for source, name in GROUPS.items():
        group = F.when(F.col("source") == source, F.lit(name)).otherwise(group)
    # Other events match no document, so they need not reach the join.
    times = events.filter(F.col("event_id") % step == 0 if step else F.col("event_id") == 0)
    times = times.select((F.col("event_id")).alias("_event"), "ts", "user_id", "event_type")
    if texts_stay and rows_in(spark, sf_dir, "documents") <= BROADCAST_TIMES:
        times = F.broadcast(times)
    shift = F.make_dt_interval((F.col("doc_id") % 24 * 30).cast("int"))
    return docs.join(times, F.col("_event") == F.col("doc_id") * step).select(
        F.col("doc_id").alias("id"), F.concat("text", phrase).alias("text"), group.alias("subreddit"),
        F.concat(F.lit("a"), F.col("user_id")).alias("author"), (F.col("ts").cast("timestamp") + shift).alias("created_ts"),
        F.col("event_type").alias("content_type"),
        F.concat(F.lit("part-"), (F.col("doc_id") % 7).cast("string")).alias("source_file"),
        ((F.col("doc_id") % 7 + 1) * 1000).alias("file_size"), "lang",
    )


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with stage and whole-word flags."""
    return tagging.flag_rare(tagging.assign_stage(posts(spark, sf_dir)))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid posts with tokens, without the cleaned texts, which no query over them reads."""
    return cleaning.drop_invalid(cleaning.preprocess(tagging.assign_stage(posts(spark, sf_dir, texts_stay=True)), texts=False))


_STAGES: dict[tuple[str, str, str], str] = {}


def saved(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write a stage to the shared scratch folder and read it back, for queries that go over it more than once."""
    return StageStore(spark, scratch_path(spark, "stage")).save("rows", df)


def _saved_once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """One stage table for each application and input, however many queries read it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        path = scratch_path(spark, name)
        StageStore(spark, path).save("rows", build(spark, sf_dir))
        _STAGES[key] = path
    return StageStore(spark, _STAGES[key]).load("rows")


def saved_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved_once(spark, sf_dir, "staged", staged)


def saved_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, group and stage of valid posts. Of their texts nothing else is written; the joined tokens come back as they are read."""
    build = lambda *at: cleaned(*at).select("id", "subreddit", "visa_stage", "tokens", "word_count")
    return _saved_once(spark, sf_dir, "cleaned", build).withColumn("processed_text", F.array_join("tokens", " "))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with automatic labels; the low threshold gives every label some rows."""
    rows = posts(spark, sf_dir).withColumn("cleaned_text", F.col("text"))
    return labelling.auto_label(labelling.score_labels(rows), threshold=0.3)


def order_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts over several years."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_ts"),
        F.col("o_orderpriority").alias("subreddit"), F.col("o_orderstatus").alias("visa_stage"),
        F.col("o_custkey").alias("author"), F.col("o_totalprice").alias("word_count"),
        F.col("o_orderstatus").alias("processed_text"),
    )


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts with a numeric column in place of sentiment."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_ts"),
        F.col("event_type").alias("subreddit"), F.col("user_id").alias("author"), F.col("value").alias("sentiment"),
        F.col("props").alias("processed_text"), F.length("props").alias("word_count"),
        F.col("event_type").alias("visa_stage"),
    )


EVAL_LABELS = ("quality", "toxic")


def eval_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as an evaluation table with tied scores."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.inline(F.array(*[
        F.struct(F.lit(name).alias("label"), F.col(name).alias("y_true"), F.lit(k).alias("k"))
        for k, name in enumerate(EVAL_LABELS)
    ])))
    score = ((F.col("id") * 37 + F.col("k") * 11 + F.col("y_true") * 20) % 101).cast("double") / 101
    return rows.select(
        "id", "label", "y_true", ((F.col("id") * 7 + F.col("k")) % 5 < 2).cast("int").alias("y_pred"),
        score.alias("score"),
    )
