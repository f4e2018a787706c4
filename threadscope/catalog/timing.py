"""G1–G11."""

from pyspark.sql import functions as F

from threadscope import presets
from threadscope.catalog import sql as S
from threadscope.catalog.fixtures import ORDER_EVENTS, TEST_EVENTS, cleaned, event_posts, order_posts, posts
from threadscope.catalog.registry import query
from threadscope.operators import temporal


def _interval_rows(events) -> str:
    rows = temporal.event_intervals(events, presets.WINDOWS)
    values = ", ".join(f"('{e}', '{w}', '{s}', timestamp '{lo}', timestamp '{hi}')" for e, w, s, lo, hi in rows)
    return f"intervals(event, \"window\", side, lo, hi) as (values {values})"


PARTS = """cast(year(created_ts) as int) as year, cast(month(created_ts) as int) as month,
  cast(day(created_ts) as int) as day, dayname(created_ts) as weekday, cast(hour(created_ts) as int) as hour,
  cast(week(created_ts) as int) as week, cast(quarter(created_ts) as int) as quarter"""


@query("time_parts", f"with {S.POSTS} select id, {PARTS} from posts")
def time_parts(spark, sf):
    return temporal.with_time_parts(posts(spark, sf)).select(
        "id", "year", "month", "day", "weekday", "hour", "week", "quarter")


@query("time_parts_orders", f"with {S.ORDER_POSTS} select id, {PARTS} from order_posts")
def time_parts_orders(spark, sf):
    return temporal.with_time_parts(order_posts(spark, sf)).select(
        "id", "year", "month", "day", "weekday", "hour", "week", "quarter")


def _bins(source: str) -> str:
    return f"""b as (select min(epoch_us(created_ts)) as lo, max(epoch_us(created_ts)) as hi from {source})
select id, cast(greatest(ceil((epoch_us(created_ts) - lo) * 30 / (hi - lo)) - 1, 0) as int) as time_bin from {source}, b"""


@query("time_bins", f"with {S.POSTS}, {_bins('posts')}")
def time_bins(spark, sf):
    return temporal.time_bins(posts(spark, sf)).select("id", "time_bin")


@query("time_bins_orders", f"with {S.ORDER_POSTS}, {_bins('order_posts')}")
def time_bins_orders(spark, sf):
    return temporal.time_bins(order_posts(spark, sf)).select("id", "time_bin")


@query("event_windows", f"""with {S.POSTS}, {_interval_rows(TEST_EVENTS)}
select id, event, "window", side from posts join intervals on created_ts >= lo and created_ts < hi""")
def event_windows(spark, sf):
    return temporal.event_windows(posts(spark, sf), TEST_EVENTS).select("id", "event", "window", "side")


@query("period_stage_mix", f"""with {S.ORDER_POSTS}, {_interval_rows(ORDER_EVENTS)}
select event, "window", side, visa_stage, count(*) as posts
from order_posts join intervals on created_ts >= lo and created_ts < hi group by 1, 2, 3, 4""")
def period_stage_mix(spark, sf):
    return temporal.period_stage_mix(temporal.event_windows(order_posts(spark, sf), ORDER_EVENTS))


EVENT_DAYS = (presets.PolicyEvent("mid_month", TEST_EVENTS[0].day.replace(month=1, day=15)),)
METRICS = """count(*) as total_posts, count(distinct subreddit) as unique_subreddits,
  count(distinct author) as unique_authors"""
MOOD = """round(avg(sentiment), 6) as avg_sentiment, round(stddev_samp(sentiment), 6) as sentiment_std,
  round(avg(cast(sentiment > 0.1 as int)), 6) as positive_ratio, round(avg(cast(sentiment < -0.1 as int)), 6) as negative_ratio"""
SIZES = "round(avg(word_count), 6) as avg_word_count, round(avg(length(processed_text)), 6) as avg_text_length"


def _metrics(source: str, extra: str) -> str:
    return f"""metrics as (select event, "window", side, {METRICS}, {extra}
  from {source} join intervals on created_ts >= lo and created_ts < hi group by 1, 2, 3)"""


@query("period_metrics", f"""with {S.EVENT_POSTS}, {_interval_rows(EVENT_DAYS)}, {_metrics('event_posts', MOOD + ', ' + SIZES)}
select * from metrics""")
def period_metrics(spark, sf):
    return temporal.period_metrics(temporal.event_windows(event_posts(spark, sf), EVENT_DAYS))


@query("period_metrics_labels", f"""with {S.POSTS}, {S.STAGED}, {_interval_rows(TEST_EVENTS)},
rows as (select *, cast(has_fear as int) as fear, cast(has_question as int) as question, 1 - cast(has_question as int) as fear_pred from staged)
select event, "window", side, {METRICS}, round(avg(cast(fear_pred as double)), 6) as fear_ratio,
  round(avg(cast(question as double)), 6) as question_ratio
from rows join intervals on created_ts >= lo and created_ts < hi group by 1, 2, 3""")
def period_metrics_labels(spark, sf):
    from threadscope.catalog.fixtures import staged

    rows = staged(spark, sf).withColumns({
        "fear": F.col("has_fear").cast("int"), "question": F.col("has_question").cast("int"),
        "fear_pred": 1 - F.col("has_question").cast("int")})
    return temporal.period_metrics(temporal.event_windows(rows, TEST_EVENTS))


NAMES = ("total_posts", "unique_subreddits", "unique_authors", "avg_word_count", "avg_text_length")
ORDER_METRICS = f"{S.ORDER_POSTS}, {_interval_rows(ORDER_EVENTS)}, {_metrics('order_posts', SIZES)}"
CHANGES = f"""{ORDER_METRICS}, long as (
  {' union all '.join(f"select event, {chr(34)}window{chr(34)}, side, '{m}' as metric, cast({m} as double) as v from metrics" for m in NAMES)}),
changes as (select event, "window", metric, a.v as pre_value, b.v as post_value, round(b.v - a.v, 6) as absolute_change,
  round(case when a.v <> 0 then (b.v - a.v) / a.v * 100 when b.v = 0 then 0 else cast('inf' as double) end, 6) as percentage_change
  from (select * from long where side = 'pre') a join (select * from long where side = 'post') b using (event, "window", metric))"""


def changes(spark, sf):
    return temporal.period_changes(temporal.period_metrics(temporal.event_windows(order_posts(spark, sf), ORDER_EVENTS)))


@query("period_changes", f"with {CHANGES} select * from changes")
def period_changes(spark, sf):
    return changes(spark, sf)


@query("impact_matrix", f"""with {CHANGES} select event, metric, """
       + ", ".join(f"round(avg(percentage_change) filter (where \"window\" = '{w}'), 6) as {w}" for w in presets.WINDOWS)
       + " from changes group by 1, 2")
def impact_matrix(spark, sf):
    return temporal.impact_matrix(changes(spark, sf))


@query("impact_heatmap", f"with {CHANGES} select metric, " + ", ".join(
    f"round(avg(percentage_change) filter (where event = '{e.name}' and \"window\" = '{w}'), 6) as {e.name}_{w}"
    for e in ORDER_EVENTS for w in presets.WINDOWS) + " from changes group by 1")
def impact_heatmap(spark, sf):
    return temporal.impact_heatmap(changes(spark, sf), [e.name for e in ORDER_EVENTS])


@query("significant_changes", f"""with {CHANGES} select event, "window", count(*) as significant from changes
where abs(percentage_change) > 1 group by 1, 2""")
def significant_changes(spark, sf):
    return temporal.significant_changes(changes(spark, sf), 1.0)


SEASONS = {"month": "month(created_ts)", "quarter": "quarter(created_ts)", "weekday": "dayname(created_ts)",
           "hour": "hour(created_ts)"}


def _seasonal(source: str, mood: str) -> str:
    return " union all ".join(
        f"select '{u}' as unit, cast({e} as varchar) as value, count(processed_text) as posts, "
        f"round(avg(word_count), 6) as avg_word_count, round(avg({mood}), 6) as avg_sentiment from {source} group by 1, 2"
        for u, e in SEASONS.items())


@query("seasonal", f"with {S.EVENT_POSTS} {_seasonal('event_posts', 'sentiment')}")
def seasonal(spark, sf):
    return temporal.seasonal(event_posts(spark, sf))


@query("seasonal_posts", lambda: f"with {S.cleaned_cte()} {_seasonal('cleaned', 'cast(0 as double)')}")
def seasonal_posts(spark, sf):
    return temporal.seasonal(cleaned(spark, sf))


def _rolling(source: str, key: str, name: str, before: int, after: int) -> str:
    w = f"(order by k rows between {before} preceding and {after} following)"
    k = before + after + 1
    return f"""counts as (select {key} as k, count(*) as n from {source} group by 1),
sums as (select *, sum(n) over {w} as t, {k} * sum(n * n) over {w} - sum(n) over {w} * sum(n) over {w} as v from counts), full_rows as (select *, count(*) over {w} = {k} as whole from sums)
select k as {name}, n, case when whole then round(t / {k}, 6) end as rolling_mean,
  case when whole then round(sqrt(v / {k * (k - 1)}), 6) end as rolling_std,
  whole and ({k} * n - t) * ({k} * n - t) * {k - 1} > 4 * {k} * v as is_anomaly from full_rows"""


@query("daily_anomalies", f"with {S.EVENT_POSTS}, {_rolling('event_posts', 'cast(created_ts as date)', 'day', 3, 3)}")
def daily_anomalies(spark, sf):
    return temporal.daily_anomalies(event_posts(spark, sf))


@query("daily_anomalies_orders", f"with {S.ORDER_POSTS}, {_rolling('order_posts', 'cast(created_ts as date)', 'day', 3, 3)}")
def daily_anomalies_orders(spark, sf):
    return temporal.daily_anomalies(order_posts(spark, sf))


@query("weekly_anomalies", f"with {S.ORDER_POSTS}, {_rolling('order_posts', 'cast(week(created_ts) as int)', 'week', 2, 1)}")
def weekly_anomalies(spark, sf):
    return temporal.weekly_anomalies(order_posts(spark, sf))


@query("peak", f"""with {S.ORDER_POSTS}, y as (select cast(year(created_ts) as int) as year, count(*) as n from order_posts group by 1)
select (select year from y order by n desc, year limit 1) as peak_year, max(n) as peak_posts, count(*) as years from y""")
def peak(spark, sf):
    return temporal.peak(order_posts(spark, sf))
