"""Time parts, event windows, seasonality and anomalies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadscope import presets
from threadscope.functions import timeparts

PERIOD_KEYS = ("event", "window", "side")


def with_time_parts(df: DataFrame, ts: str = "created_ts") -> DataFrame:
    t = F.col(ts)
    return df.withColumns({
        "year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "weekday": timeparts.weekday_name(t),
        "hour": F.hour(t), "week": timeparts.iso_week(t), "quarter": F.quarter(t),
    })


def time_bins(df: DataFrame, ts: str = "created_ts", bins: int = 30, out: str = "time_bin") -> DataFrame:
    """Equal-width bins 0 to ``bins - 1``, closed on the right, the minimum in bin 0."""
    x = timeparts.micros(F.col(ts))
    pair = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("b")).scalar()
    lo, hi = pair.getField("lo"), pair.getField("hi")
    position = F.try_divide((x - lo) * F.lit(bins), hi - lo)
    return df.withColumn(
        out, F.when(x.isNotNull(), F.greatest(F.ceil(F.coalesce(position, F.lit(0.0))) - 1, F.lit(0))).cast("int")
    )


def event_intervals(events: Sequence[presets.PolicyEvent] = presets.POLICY_EVENTS,
                    windows: Mapping[str, int] = presets.WINDOWS) -> list[tuple[str, str, str, str, str]]:
    """(event, window, side, from, to) for the days before [e - w, e) and after [e, e + w) each event."""
    rows = []
    for e in events:
        for name, days in windows.items():
            span = timedelta(days=days)
            rows.append((e.name, name, "pre", str(e.day - span), str(e.day)))
            rows.append((e.name, name, "post", str(e.day), str(e.day + span)))
    return rows


def event_windows(df: DataFrame, events: Sequence[presets.PolicyEvent] = presets.POLICY_EVENTS,
                  windows: Mapping[str, int] = presets.WINDOWS, ts: str = "created_ts") -> DataFrame:
    """One row per post and interval it lies in.

    The intervals are a literal array that each row filters, so there is no join and no shuffle; the outer range is a
    plain comparison that reaches the scan.
    """
    intervals = event_intervals(events, windows)
    day = lambda s: F.lit(s).cast("timestamp")
    table = F.array(*[
        F.struct(F.lit(e).alias("event"), F.lit(w).alias("window"), F.lit(s).alias("side"),
                 day(lo).alias("lo"), day(hi).alias("hi"))
        for e, w, s, lo, hi in intervals
    ])
    t = F.col(ts)
    inside = F.filter(table, lambda i: (i["lo"] <= t) & (t < i["hi"]))
    first, last = min(r[3] for r in intervals), max(r[4] for r in intervals)
    return (
        df.filter((t >= day(first)) & (t < day(last)))
        .withColumn("_i", F.explode(inside))
        .withColumns({k: F.col(f"_i.{k}") for k in PERIOD_KEYS}).drop("_i")
    )


def period_metrics(df: DataFrame, labels: Sequence[str] = presets.LABELS, group: str = "subreddit",
                   author: str = "author", words: str = "word_count", text: str = "processed_text",
                   sentiment: str = "sentiment", threshold: float = presets.SENTIMENT_THRESHOLD) -> DataFrame:
    """One row per (event, window, side) with every metric the columns at hand allow."""
    has = set(df.columns)
    s = F.col(sentiment)
    aggs: dict[str, Column] = {
        "total_posts": F.count(F.lit(1)),
        "unique_subreddits": F.count_distinct(group),
        "unique_authors": F.count_distinct(author) if author in has else F.lit(0).cast("long"),
    }
    if sentiment in has:
        aggs |= {
            "avg_sentiment": F.avg(s), "sentiment_std": F.stddev_samp(s),
            "positive_ratio": F.avg(F.coalesce(s > threshold, F.lit(False)).cast("int")),
            "negative_ratio": F.avg(F.coalesce(s < -threshold, F.lit(False)).cast("int")),
        }
    for label in labels:
        for name in (f"{label}_pred", label):
            if name in has:
                aggs[f"{label}_ratio"] = F.avg(F.col(name).cast("double"))
                break
    if words in has:
        aggs["avg_word_count"] = F.avg(words)
    if text in has:
        aggs["avg_text_length"] = F.avg(F.length(text))
    out = df.groupBy(*PERIOD_KEYS).agg(*[v.alias(k) for k, v in aggs.items()])
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.withColumns({c: F.round(c, 6) for c in doubles})


def period_stage_mix(df: DataFrame, stage: str = "visa_stage") -> DataFrame:
    return df.groupBy(*PERIOD_KEYS, stage).agg(F.count(F.lit(1)).alias("posts"))


def period_changes(metrics: DataFrame) -> DataFrame:
    """Before and after side by side per metric, with the absolute and the percent change.

    A zero before gives 0 percent if the value stays zero, else infinity. Windows with an empty side are left out.
    """
    names = [c for c in metrics.columns if c not in PERIOD_KEYS]
    pairs = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names
    ])
    long = metrics.select(*PERIOD_KEYS, F.inline(pairs))
    sides = long.groupBy("event", "window", "metric").agg(
        F.count_if(F.col("side") == "pre").alias("_pre"), F.count_if(F.col("side") == "post").alias("_post"),
        F.max(F.when(F.col("side") == "pre", F.col("value"))).alias("pre_value"),
        F.max(F.when(F.col("side") == "post", F.col("value"))).alias("post_value"),
    ).filter("_pre > 0 and _post > 0")
    pre, post = F.col("pre_value"), F.col("post_value")
    pct = F.when(pre != 0, (post - pre) / F.when(pre != 0, pre) * 100).when(
        pre == 0, F.when(post == 0, 0.0).otherwise(float("inf"))
    )
    return sides.select(
        "event", "window", "metric", "pre_value", "post_value",
        F.round(post - pre, 6).alias("absolute_change"), F.round(pct, 6).alias("percentage_change"),
    )


def impact_matrix(changes: DataFrame, windows: Sequence[str] = tuple(presets.WINDOWS),
                  by: Sequence[str] = ("event", "metric")) -> DataFrame:
    """Percent changes with one column per window."""
    return changes.groupBy(*by).pivot("window", list(windows)).agg(F.round(F.avg("percentage_change"), 6))


def impact_heatmap(changes: DataFrame, events: Sequence[str],
                   windows: Sequence[str] = tuple(presets.WINDOWS)) -> DataFrame:
    """Mean percent change per metric with one column per event and window."""
    cells = [f"{e}_{w}" for e in events for w in windows]
    return (
        changes.withColumn("cell", F.concat_ws("_", "event", "window")).groupBy("metric")
        .pivot("cell", cells).agg(F.round(F.avg("percentage_change"), 6))
    )


def significant_changes(changes: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Number of metrics per event and window whose percent change exceeds the threshold either way."""
    return (
        changes.filter(F.abs("percentage_change") > threshold)
        .groupBy("event", "window").agg(F.count(F.lit(1)).alias("significant"))
    )


def seasonal(df: DataFrame, ts: str = "created_ts", words: str = "word_count", text: str = "processed_text",
             sentiment: str = "sentiment") -> DataFrame:
    """Posts, mean words and mean sentiment by month, quarter, weekday and hour in one scan."""
    units = {
        "month": F.month(ts), "quarter": F.quarter(ts), "weekday": timeparts.weekday_name(F.col(ts)),
        "hour": F.hour(ts),
    }
    score = F.col(sentiment) if sentiment in df.columns else F.lit(0.0)
    rows = df.select(
        *[e.cast("string").alias(f"_{u}") for u, e in units.items()],
        F.col(text).isNotNull().alias("_has"), F.col(words).alias("_w"), score.alias("_s"),
    )
    cols = [f"_{u}" for u in units]
    unit = F.coalesce(*[F.when(F.grouping(f"_{u}") == 0, F.lit(u)) for u in units])
    return (
        rows.groupingSets([[c] for c in cols], *cols)
        .agg(unit.alias("unit"), F.coalesce(*cols).alias("value"), F.count_if("_has").alias("posts"),
             F.round(F.avg("_w"), 6).alias("avg_word_count"), F.round(F.avg("_s"), 6).alias("avg_sentiment"))
        .drop(*cols).filter("value is not null")
    )


def _rolling_flags(counts: DataFrame, order: str, before: int, after: int, sigmas: float) -> DataFrame:
    """Centred rolling mean and deviation over a small table of counts (one row per day or week)."""
    k = before + after + 1
    frame = Window.partitionBy(F.lit(1)).orderBy(order).rowsBetween(-before, after)
    n = F.col("n").cast("double")
    full = F.count(F.lit(1)).over(frame) == k
    total = F.when(full, F.sum(n).over(frame))
    # k (k - 1) times the sample variance; whole numbers, so a count exactly on the band edge is not flagged.
    spread = F.when(full, k * F.sum(n * n).over(frame) - F.sum(n).over(frame) * F.sum(n).over(frame))
    off = k * n - total
    return counts.withColumns({
        "rolling_mean": F.round(total / k, 6),
        "rolling_std": F.round(F.sqrt(spread / (k * (k - 1))), 6),
        "is_anomaly": F.coalesce(off * off * (k - 1) > F.lit(sigmas * sigmas * k) * spread, F.lit(False)),
    })


def daily_anomalies(df: DataFrame, ts: str = "created_ts", window: int = 7, sigmas: float = 2.0) -> DataFrame:
    """Posts per day, flagged where they leave the centred 7-row band; the ends without a full window are not."""
    counts = df.filter(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return _rolling_flags(counts, "day", window // 2, window - window // 2 - 1, sigmas)


def weekly_anomalies(df: DataFrame, ts: str = "created_ts", window: int = 4, sigmas: float = 2.0) -> DataFrame:
    """The same per ISO week number with all years merged, window of 4."""
    counts = df.filter(F.col(ts).isNotNull()).groupBy(timeparts.iso_week(F.col(ts)).alias("week")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return _rolling_flags(counts, "week", window // 2, window - window // 2 - 1, sigmas)


def peak(df: DataFrame, ts: str = "created_ts") -> DataFrame:
    """The year with most posts (ties to the earlier), its count and the number of years."""
    years = df.filter(F.col(ts).isNotNull()).groupBy(F.year(ts).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return years.agg(
        F.max_by("year", F.struct("n", -F.col("year"))).alias("peak_year"), F.max("n").alias("peak_posts"),
        F.count(F.lit(1)).alias("years"),
    )
