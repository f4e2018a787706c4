"""A14, I1–I3."""

from pyspark.sql import functions as F

from threadscope import presets
from threadscope.catalog import sql as S
from threadscope.catalog.fixtures import posts, use_utc
from threadscope.catalog.registry import query
from threadscope.session import scratch_path
from threadscope.streaming import jobs

FLAGS = ["has_fear", "is_question", *[f"stage_{s}" for s in presets.STAGES_6_WIDE]]


def post_folder(spark, sf):
    """Posts as several Parquet files in one folder, and their schema."""
    path = scratch_path(spark, "arriving")
    posts(spark, sf).write.parquet(path)
    return path, spark.read.parquet(path).schema


@query("ingest_stream", f"with {S.POSTS}, {S.tagged()} select id, {', '.join(FLAGS)} from tagged")
def ingest_stream(spark, sf):
    """Started twice: the second start finds nothing new, so the rows are there once."""
    path, schema = post_folder(spark, sf)
    out = scratch_path(spark, "ingested")
    for _ in range(2):
        stream = jobs.post_stream(spark, path, schema, files_per_batch=4)
        jobs.ingest_stream(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("id", *FLAGS)


@query("ingest_batches", f"with {S.POSTS}, {S.tagged()} select id, {', '.join(FLAGS)} from tagged")
def ingest_batches(spark, sf):
    """Started twice as well; rows are read through the ledger."""
    path, schema = post_folder(spark, sf)
    out = scratch_path(spark, "batches")
    for _ in range(2):
        jobs.ingest_batches(jobs.post_stream(spark, path, schema, files_per_batch=4), out).awaitTermination()
    return jobs.committed(spark, out).select("id", *FLAGS)


def event_stream(spark, sf):
    schema = use_utc(spark).read.parquet(f"{sf}/events.parquet").schema
    stream = jobs.post_stream(spark, sf, schema, glob="events.parquet")
    return stream.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_ts"),
        F.concat_ws(" ", "event_type", "props").alias("text"), F.col("event_type").alias("subreddit"), "user_id")


@query("live_counts", f"""with posts as (select ts as created_ts, concat_ws(' ', event_type, props) as text from events), {S.tagged()}
select cast(created_ts as date) as day, count(*) as total_records,
  {S.big('sum(cast(has_fear as int))', 'total_fear')}, {S.big('sum(cast(is_question as int))', 'total_qa')},
  {', '.join(S.big(f'sum(cast(stage_{s} as int))', f'stage_{s}') for s in presets.STAGES_6_WIDE)}
from tagged group by 1
having cast(cast(created_ts as date) + 1 as timestamp) <= (select max(ts) from events) - interval 1 hour""")
def live_counts(spark, sf):
    out = scratch_path(spark, "live")
    jobs.start(jobs.live_counts(event_stream(spark, sf)), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("stream_dedupe", "select distinct user_id, event_type as subreddit from events")
def stream_dedupe(spark, sf):
    """One file is one micro-batch, so every pair comes out once."""
    out = scratch_path(spark, "unique")
    unique = jobs.stream_dedupe(event_stream(spark, sf), ("user_id", "subreddit"), delay="60 days")
    jobs.start(unique, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("user_id", "subreddit")


@query("stream_first", """with steps as (
  select *, case when ts <= lag(ts) over w + interval 1 day then 0 else 1 end as begins from events
  window w as (partition by user_id, event_type order by ts)),
groups as (select *, sum(begins) over (partition by user_id, event_type order by ts) as nth from steps),
ranked as (select *, max(ts) over g as last_ts, row_number() over (g order by ts, event_id) as r from groups
  window g as (partition by user_id, event_type, nth))
select event_id as id, ts as created_ts, concat_ws(' ', event_type, props) as text, event_type as subreddit, user_id
from ranked where r = 1 and last_ts + interval 1 day <= (select max(ts) from events) - interval 1 day""")
def stream_first(spark, sf):
    """Whole rows of the groups that the watermark has passed."""
    out = scratch_path(spark, "first")
    first = jobs.stream_first(event_stream(spark, sf), ("user_id", "subreddit"))
    jobs.start(first, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")
