"""F1–F10."""

from pyspark.sql import functions as F

from threadscope import presets
from threadscope.catalog import sql as S
from threadscope.catalog.fixtures import posts
from threadscope.catalog.registry import query
from threadscope.plans import reports

STAGES = list(presets.STAGES_6_WIDE)
TAGGED = f"{S.POSTS}, {S.tagged()}"
TOTALS = ", ".join(
    ["count(*) as total_records", S.big("sum(cast(has_fear as int))", "total_fear"),
     S.big("sum(cast(is_question as int))", "total_qa"),
     S.rate("sum(cast(has_fear as int))", "count(*)") + " as fear_rate",
     S.rate("sum(cast(is_question as int))", "count(*)") + " as qa_rate",
     *[S.big(f"sum(cast(stage_{s} as int))", f"stage_{s}") for s in STAGES]])
YEAR, MONTH = "cast(year(created_ts) as int)", "cast(month(created_ts) as int)"


def counts(spark, sf):
    return reports.file_counts(posts(spark, sf), size="file_size")


@query("file_report", f"with {TAGGED} select source_file as file, {TOTALS} from tagged group by 1")
def file_report(spark, sf):
    return reports.file_report(counts(spark, sf))


@query("monthly_report", f"""with {TAGGED} select {YEAR} as year, {MONTH} as month, {TOTALS},
  count(distinct source_file) as files from tagged group by 1, 2""")
def monthly_report(spark, sf):
    return reports.monthly_report(counts(spark, sf))


YEARLY = f"""select {YEAR} as year, {TOTALS}, count(distinct month(created_ts)) as months,
  count(distinct source_file) as files,
  cast(sum(file_size) filter (where first_in_file) as bigint) as bytes
  from (select *, row_number() over (partition by year(created_ts), source_file order by id) = 1 as first_in_file
        from tagged) group by 1"""


@query("yearly_report", f"with {TAGGED} {YEARLY}")
def yearly_report(spark, sf):
    return reports.yearly_report(counts(spark, sf))


@query("rollup_report", f"""with {TAGGED}
select case when grouping({YEAR}) = 1 then 'all' when grouping({MONTH}) = 1 then 'year' else 'month' end as level,
  {YEAR} as year, {MONTH} as month, {TOTALS}, count(distinct source_file) as files
from tagged group by rollup ({YEAR}, {MONTH})""")
def rollup_report(spark, sf):
    return reports.rollup_report(counts(spark, sf))


@query("monthly_activity", f"""with {S.POSTS} select strftime(created_ts, '%Y-%m') as month, count(*) as total,
  count(distinct source_file) as files from posts where id % 9 <> 0 group by 1""")
def monthly_activity(spark, sf):
    rows = posts(spark, sf).withColumn(
        "created_ts", F.when(F.col("id") % 9 == 0, F.lit("no time")).otherwise(F.col("created_ts").cast("string"))
    )
    return reports.monthly_activity(rows)


@query("year_summary", f"""with {TAGGED}, yearly as ({YEARLY})
select year, total_records, total_fear, total_qa, fear_rate, qa_rate,
  round(total_records / greatest(files, 1), 6) as avg_records_per_file from yearly""")
def year_summary(spark, sf):
    return reports.year_summary(reports.yearly_report(counts(spark, sf)))


def _tidy(year: int) -> str:
    days = "cast(floor((epoch_us(max(created_ts)) - epoch_us(min(created_ts))) / 86400000000) + 1 as double)"
    one = f"one_{year} as (select {TOTALS}, {days} as total_days from tagged where year(created_ts) = {year})"
    entries = [("summary", c, c) for c in
               ("total_records", "total_fear", "total_qa", "fear_rate", "qa_rate", "total_days")]
    entries += [("stage", s, f"stage_{s}") for s in STAGES]
    rows = " union all ".join(
        f"select '{k}' as kind, '{m}' as metric, cast({v} as double) as value from one_{year}" for k, m, v in entries)
    return f"{one}, tidy_{year} as ({rows})"


COMPARED = f"""{TAGGED}, {_tidy(2024)}, {_tidy(2025)}, compared as (
  select kind, metric, a.value as value_a, b.value as value_b
  from tidy_2024 a full join tidy_2025 b using (kind, metric))"""
CHANGES = f"""{COMPARED}, changes as (
  select kind, metric, value_a, value_b, round(case when metric in ('fear_rate', 'qa_rate')
      then (value_b - value_a) / nullif(value_a, 0) * 100
    when value_a > 0 then (value_b - value_a) / value_a * 100 else 0 end, 6) as change_pct
  from compared where metric <> 'total_days')"""


def compared(spark, sf):
    return reports.compare_years(reports.tidy_years(posts(spark, sf), (2024, 2025)), 2024, 2025)


@query("compare_years", f"with {COMPARED} select * from compared")
def compare_years(spark, sf):
    return compared(spark, sf)


@query("pct_changes", f"with {CHANGES} select * from changes")
def pct_changes(spark, sf):
    return reports.pct_changes(compared(spark, sf))


@query("stage_changes", f"with {CHANGES} select metric as stage, value_a, value_b, change_pct from changes where kind = 'stage'")
def stage_changes(spark, sf):
    return reports.stage_changes(reports.pct_changes(compared(spark, sf)))


@query("top_changes", f"""with {CHANGES} select metric as stage, value_a, value_b, change_pct from changes
where kind = 'stage' order by abs(change_pct) desc, metric limit 3""")
def top_changes(spark, sf):
    return reports.top_changes(reports.pct_changes(compared(spark, sf)))


@query("insights", f"""with {CHANGES}, facts as (
  select 'trend' as kind, case metric when 'total_records' then 'volume' when 'fear_rate' then 'fear' else 'questions' end
    as subject, change_pct as value, case when change_pct > 0 then 'increased' else 'decreased' end as direction
  from changes where metric in ('total_records', 'fear_rate', 'qa_rate') and change_pct is not null
  union all select * from (select 'largest_increase', metric, change_pct, 'increased' from changes
    where kind = 'stage' order by change_pct desc, metric desc limit 1) where change_pct > 0
  union all select * from (select 'largest_decrease', metric, change_pct, 'decreased' from changes
    where kind = 'stage' order by change_pct, metric limit 1) where change_pct < 0)
select *, printf('%s %s by %.1f%%', subject, direction, abs(value)) as text from facts""")
def insights(spark, sf):
    return reports.insights(reports.pct_changes(compared(spark, sf)))
