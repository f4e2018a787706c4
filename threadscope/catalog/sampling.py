"""B1–B10."""

from pyspark.sql import functions as F

from threadscope import presets
from threadscope.catalog import sql as S
from threadscope.catalog.fixtures import EVAL_LABELS, eval_long, posts, saved_staged, staged, table
from threadscope.catalog.registry import query
from threadscope.operators import sampling

STAGED = f"{S.POSTS}, {S.STAGED}, months as (select *, cast(month(created_ts) as int) as month from staged)"


def _hash(seed: str = "42", id_: str = "id") -> str:
    return f"md5(concat_ws(':', '{seed}', cast({id_} as varchar)))"


def _ranked(source: str, keys: str, id_: str = "id") -> str:
    return (f"select *, row_number() over (partition by {keys} order by {_hash(id_=id_)}, {id_}) as r, "
            f"count(*) over (partition by {keys}) as n from {source}")


@query("sample_per_file_rate", f"""with {S.POSTS} select id, source_file from ({_ranked('posts', 'source_file')})
where r <= greatest(floor(n * cast(0.1 as double)), 5)""")
def sample_per_file_rate(spark, sf):
    return sampling.sample_per_file_rate(posts(spark, sf), 0.1, 5).select("id", "source_file")


@query("sample_per_file_rate_default", f"""with {S.POSTS} select id, source_file from ({_ranked('posts', 'source_file')})
where r <= greatest(floor(n * cast(0.01 as double)), 100)""")
def sample_per_file_rate_default(spark, sf):
    return sampling.sample_per_file_rate(posts(spark, sf)).select("id", "source_file")


@query("sample_per_file_n", f"with {S.POSTS} select id, source_file from ({_ranked('posts', 'source_file')}) where r <= 50")
def sample_per_file_n(spark, sf):
    return sampling.sample_per_file_n(posts(spark, sf), 50).select("id", "source_file")


@query("sample_events_per_user", f"""select event_id, user_id from ({_ranked('events', 'user_id', 'event_id')})
where r <= greatest(floor(n * cast(0.05 as double)), 1)""")
def sample_events_per_user(spark, sf):
    return sampling.stratified_sample(table(spark, sf, "events"), ["user_id"], 0.05, ["event_id"]).select(
        "event_id", "user_id")


FILES = """files as (select distinct concat('part-', o_custkey % 40) as path, cast(year(o_orderdate) as int) as year,
  cast(month(o_orderdate) as int) as month from orders)"""


@query("sample_files_per_month", f"""with {FILES} select path, year, month from (
  select *, row_number() over (partition by year, month order by {_hash(id_='path')}, path) as r from files) where r <= 7""")
def sample_files_per_month(spark, sf):
    files = table(spark, sf, "orders").select(
        F.concat(F.lit("part-"), F.col("o_custkey") % 40).alias("path"), F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month")).distinct()
    return sampling.sample_files_per_month(files, 7)


@query("stratified_sample", f"""with {STAGED} select id, subreddit, month, visa_stage from (
  {_ranked('months', 'subreddit, month, visa_stage')}) where r <= greatest(floor(n * cast(0.25 as double)), 1)""")
def stratified_sample(spark, sf):
    rows = saved_staged(spark, sf).withColumn("month", F.month("created_ts"))
    return sampling.stratified_sample(rows, rate=0.25).select("id", "subreddit", "month", "visa_stage")


OVERSAMPLED = f"""rare as (select *, row_number() over (order by {_hash()}, id) as r from staged where is_rare_event),
draws as (select i as draw, cast('0x' || substr({_hash(id_='i')}, 1, 8) as bigint)
    % (select count(*) from rare) + 1 as r from range(2 * (select count(*) from rare)) t(i))"""


@query("oversample", f"""with {S.POSTS}, {S.STAGED}, {OVERSAMPLED}
select draw, id, subreddit from draws join rare using (r)""")
def oversample(spark, sf):
    return sampling.oversample(saved_staged(spark, sf), F.col("is_rare_event")).select("draw", "id", "subreddit")


@query("union_samples", f"""with {STAGED}, {OVERSAMPLED}
select id, subreddit, cast(null as bigint) as draw from ({_ranked('months', 'subreddit, month, visa_stage')})
where r <= greatest(floor(n * cast(0.01 as double)), 1)
union all select id, subreddit, draw from draws join rare using (r)""")
def union_samples(spark, sf):
    rows = saved_staged(spark, sf).withColumn("month", F.month("created_ts"))
    parts = sampling.stratified_sample(rows), sampling.oversample(rows, F.col("is_rare_event"))
    return sampling.union_samples(*parts).select("id", "subreddit", "draw")


@query("annotation_sample", f"""with {S.POSTS}, {S.STAGED}
select id, visa_stage, subreddit, false as annotated, '' as labels, cast(0.0 as double) as confidence,
  '' as annotator_notes
from ({_ranked('staged', 'visa_stage, subreddit')})
where r <= greatest(1, floor(cast(200 as double) * n / (select count(*) from staged)))
order by {_hash('42/order')}, id limit 200""")
def annotation_sample(spark, sf):
    return sampling.annotation_sample(saved_staged(spark, sf), 200).select(
        "id", "visa_stage", "subreddit", "annotated", "labels", "confidence", "annotator_notes")


FLAGS = ("has_fear", "has_question", "is_rare_event")


@query("sampling_summary", f"""with {S.POSTS}, {S.STAGED}, one as (select count(*) as rows,
    count(distinct subreddit) as groups, {', '.join(f'sum(cast({f} as int)) as {f}' for f in FLAGS)} from staged)
{S.inline_rows('one', [('rows', '', 'rows'), ('groups', '', 'groups'), *[('flag_sum', f, f) for f in FLAGS],
                       *[('flag_mean', f, f'{f} / rows') for f in FLAGS]])}
union all select 'stage_rows', visa_stage, cast(count(*) as double) from staged group by visa_stage""")
def sampling_summary(spark, sf):
    return sampling.sampling_summary(staged(spark, sf))


@query("stratified_split", f"""with {S.EVAL}, wide as (
  select id, max(y_true) filter (where label = 'quality') as quality, max(y_true) filter (where label = 'toxic') as toxic
  from eval_long group by id),
strata as (select *, case when quality = 1 then 0 when toxic = 1 then 1 else 0 end as stratum from wide)
select id, cast(stratum as int) as stratum, case when r <= floor(n * cast(0.2 as double) + 0.5) then 'validation' else 'train' end as split
from ({_ranked('strata', 'stratum')})""")
def stratified_split(spark, sf):
    wide = eval_long(spark, sf).groupBy("id").agg(*[
        F.max(F.when(F.col("label") == x, F.col("y_true"))).alias(x) for x in EVAL_LABELS])
    return sampling.stratified_split(sampling.first_positive(wide, EVAL_LABELS), "stratum").select(
        "id", "stratum", "split")


@query("split_events", f"""select event_id, event_type, case when r <= floor(n * cast(0.2 as double) + 0.5)
  then 'validation' else 'train' end as split from ({_ranked('events', 'event_type', 'event_id')})""")
def split_events(spark, sf):
    return sampling.stratified_split(table(spark, sf, "events"), "event_type", ids=["event_id"]).select(
        "event_id", "event_type", "split")


@query("coverage_report", f"""with {S.POSTS},
files as (select source_file, count(*) as n, max(file_size) as size from posts group by 1),
one as (select min(n) as a, max(n) as b, avg(n) as c, stddev_samp(n) as d, count(*) as e, sum(size) as f, sum(n) as g from files)
select 'rows_by_year' as metric, cast(year(created_ts) as varchar) as subject, cast(count(*) as double) as value from posts group by 2
union all select 'rows_by_month', cast(month(created_ts) as varchar), cast(count(*) as double) from posts group by 2
union all select 'rows_by_content_type', content_type, cast(count(*) as double) from posts group by 2
union all {S.inline_rows('one', [('rows_per_file', 'min', 'a'), ('rows_per_file', 'max', 'b'),
    ('rows_per_file', 'mean', 'c'), ('rows_per_file', 'std', 'd'), ('total', 'files', 'e'), ('total', 'bytes', 'f'),
    ('total', 'rows', 'g'), ('total', 'success_rate', '100.0')])}""")
def coverage_report(spark, sf):
    rows = posts(spark, sf).withColumns({"year": F.year("created_ts"), "month": F.month("created_ts")})
    return sampling.coverage_report(rows)
