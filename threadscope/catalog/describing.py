"""E1–E18, E23–E30."""

from pyspark.sql import functions as F

from threadscope import presets
from threadscope.catalog import sql as S
from threadscope.catalog.fixtures import cleaned, order_posts, posts, saved, saved_cleaned, staged, table
from threadscope.catalog.registry import query
from threadscope.functions import text as T
from threadscope.operators import describe, lookup, words

KNOWN = "visa_stage <> 'unknown'"
TOP10 = "(select subreddit from {0} group by 1 order by count(*) desc, subreddit limit 10)"


@query("top_words", lambda: f"""with {S.words_cte()} select word, count(*) as n from words
where length(word) >= 3 group by word having count(*) >= 6 order by n desc, word limit 50""")
def top_words(spark, sf):
    return words.top_words(cleaned(spark, sf))


def _ranked_words(key: str, k: int, least: int, where: str = "true") -> str:
    return f"""select {key}, word, n, cast(rank as int) as rank from (
      select *, row_number() over (partition by {key} order by n desc, word) as rank from (
        select {key}, word, count(*) as n from words where length(word) >= 3 and {where}
        group by 1, 2 having count(*) >= {least})) where rank <= {k}"""


@query("top_words_by_stage", lambda: f"with {S.words_cte()} {_ranked_words('visa_stage', 20, 3, KNOWN)}")
def top_words_by_stage(spark, sf):
    return words.top_words_by(saved_cleaned(spark, sf), "visa_stage", 20, min_count=3)


@query("top_words_by_group", lambda: f"""with {S.words_cte()}
{_ranked_words('subreddit', 15, 2, 'subreddit in ' + TOP10.format('cleaned'))}""")
def top_words_by_group(spark, sf):
    rows = words.within_largest(saved_cleaned(spark, sf), "subreddit", 10)
    return words.top_words_by(rows, "subreddit", 15, min_count=2, skip=())


@query("word_totals", lambda: f"with {S.words_cte()} select count(distinct word) as unique_words, count(*) as total_words from words")
def word_totals(spark, sf):
    return words.word_totals(cleaned(spark, sf))


def _times(source: str, units: dict, by: str = "", where: str = "true") -> str:
    key = f"{by}, " if by else ""
    return " union all ".join(
        f"select {key}'{u}' as unit, cast({e} as varchar) as value, count(*) as n from {source} where {where} "
        f"group by {key}2, 3" if not by else
        f"select {key}'{u}' as unit, cast({e} as varchar) as value, count(*) as n from {source} where {where} group by 1, 2, 3"
        for u, e in units.items())


UNITS = {"year": "year(created_ts)", "month": "month(created_ts)", "weekday": "dayname(created_ts)",
         "hour": "hour(created_ts)"}


def _overall(source: str, units: dict) -> str:
    return " union all ".join(
        f"select '{u}' as unit, cast({e} as varchar) as value, count(*) as n from {source} group by 1, 2"
        for u, e in units.items())


@query("time_distribution", f"with {S.POSTS} {_overall('posts', UNITS)}")
def time_distribution(spark, sf):
    return describe.time_distribution(posts(spark, sf))


@query("time_distribution_orders", f"with {S.ORDER_POSTS} {_overall('order_posts', UNITS)}")
def time_distribution_orders(spark, sf):
    return describe.time_distribution(order_posts(spark, sf))


YM = {u: UNITS[u] for u in ("year", "month")}


@query("time_distribution_by_stage",
       f"with {S.POSTS}, {S.STAGED} {_times('staged', YM, 'visa_stage', KNOWN)}")
def time_distribution_by_stage(spark, sf):
    return describe.time_distribution_by(staged(spark, sf), "visa_stage")


@query("time_distribution_by_group",
       f"with {S.POSTS} {_times('posts', YM, 'subreddit', 'subreddit in ' + TOP10.format('posts'))}")
def time_distribution_by_group(spark, sf):
    return describe.time_distribution_by(posts(spark, sf), "subreddit", skip=(), largest=10)


@query("date_range", f"""with {S.POSTS} select min(created_ts) as "start", max(created_ts) as "end",
  cast(floor((epoch_us(max(created_ts)) - epoch_us(min(created_ts))) / 86400000000) + 1 as bigint) as days from posts""")
def date_range(spark, sf):
    return describe.date_range(posts(spark, sf)).select(
        F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "days")


@query("value_counts", f"with {S.POSTS} select subreddit, count(*) as n from posts group by 1 order by n desc, 1 limit 10")
def value_counts(spark, sf):
    return describe.value_counts(posts(spark, sf), "subreddit", 10)


@query("value_counts_all", "select l_shipdate, count(*) as n from (select cast(l_shipdate as date) as l_shipdate from lineitem) group by 1")
def value_counts_all(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("l_shipdate"))
    return describe.value_counts(rows, "l_shipdate")


@query("group_profile", lambda: f"""with {S.cleaned_cte()},
g as (select subreddit, count(*) as posts, round(avg(word_count), 6) as avg_word_count,
  round(avg(length(processed_text)), 6) as avg_text_length from cleaned group by 1 order by 2 desc, 1 limit 20)
select g.*, visa_stage, count(*) as stage_posts from cleaned join g using (subreddit) group by all""")
def group_profile(spark, sf):
    return describe.group_profile(saved_cleaned(spark, sf))


@query("n_distinct", """select 'user_id' as "column", count(distinct user_id) as n from events
union all select 'event_type', count(distinct event_type) from events""")
def n_distinct(spark, sf):
    return describe.n_distinct(table(spark, sf, "events"), ["user_id", "event_type"])


@query("distinct_from_sketches", """select 'o_custkey' as "column", count(distinct o_custkey) as exact, true as close from orders
where month(o_orderdate) between 2 and 9
union all select 'o_totalprice', count(distinct o_totalprice), true from orders where month(o_orderdate) between 2 and 9""")
def distinct_from_sketches(spark, sf):
    """Sketches per month, stored, then united over a range of months; close means within 3 % of the exact count."""
    orders = table(spark, sf, "orders").withColumns({"year": F.year("o_orderdate"), "month": F.month("o_orderdate")})
    columns = ["o_custkey", "o_totalprice"]
    stored = saved(spark, describe.distinct_sketches(orders, columns))
    estimated = describe.distinct_from_sketches(stored.filter("month between 2 and 9"))
    exact = describe.n_distinct(orders.filter("month between 2 and 9"), columns).withColumnRenamed("n", "exact")
    close = F.abs(F.col("n") - F.col("exact")) <= F.col("exact") * 0.03
    return exact.join(F.broadcast(estimated), "column").select("column", "exact", close.alias("close"))


def polarity(spark):
    return spark.createDataFrame(list(presets.POLARITY_STARTER.items()), "token string, polarity double")


def scored(spark, sf):
    return lookup.score_sentiment(saved_cleaned(spark, sf), polarity(spark))


def _scored() -> str:
    pairs = ", ".join(f"({S.lit(k)}, cast({v} as double))" for k, v in presets.POLARITY_STARTER.items())
    return f"""{S.words_cte()}, polarity(word, p) as (values {pairs}),
hits as (select id, avg(p) as s from words join polarity using (word) group by id),
scored as (select c.*, coalesce(s, 0.0) as sentiment from cleaned c left join hits using (id))"""


@query("sentiment", lambda: f"with {_scored()} select id, round(sentiment, 6) as sentiment from scored")
def sentiment(spark, sf):
    return scored(spark, sf).select("id", F.round("sentiment", 6).alias("sentiment"))


def _mapped(values: dict) -> str:
    return "map {" + ", ".join(f"{S.lit(k)}: cast({v} as double)" for k, v in values.items()) + "}"


def _in_context() -> str:
    """The same fold as a reduce over structs that hold both the state and one token."""
    zero = "cast(0 as double)"
    state = "{{'total': {0}, 'n': {1}, 's': {2}, 'at': {3}, 'neg': {4}, 'p': cast(null as double), 'k': cast(null as double), 'no': false, 'i': cast(0 as bigint)}}".format
    polar, strong, negated = "x.p is not null", "x.p is null and x.k is not null", "a.neg >= x.i - 3"
    strength = "case when a.at = x.i - 1 then a.s else 1.0 end"
    value = f"greatest(least(x.p * ({strength}), 1.0), -1.0) * case when {negated} then -0.5 else 1.0 end"
    step = state(f"a.total + case when {polar} then {value} else {zero} end", f"a.n + cast({polar} as bigint)",
                 f"cast(case when {strong} then ({strength}) * x.k else 1.0 end as double)", f"case when {strong} then x.i else -2 end",
                 f"case when {polar} and {negated} then -1000000 when x.p is null and x.k is null and x.no then x.i else a.neg end")
    start = state(zero, "cast(0 as bigint)", "cast(1 as double)", "cast(-2 as bigint)", "cast(-1000000 as bigint)")
    token = start.replace("'p': cast(null as double)", f"'p': {_mapped(presets.POLARITY_STARTER)}[t]").replace(
        "'k': cast(null as double)", f"'k': {_mapped(presets.STRENGTH_STARTER)}[t]").replace(
        "'no': false", f"'no': t in ({S.lits(presets.NEGATION_STARTER)})").replace("'i': cast(0 as bigint)", "'i': cast(i as bigint)")
    words = r"regexp_extract_all(lower(text), '[a-z]+')"
    known = S.lits(sorted({*presets.POLARITY_STARTER, *presets.STRENGTH_STARTER, *presets.NEGATION_STARTER}))
    return f"""with {S.POSTS}, listed as (select id, {words} as tokens from posts),
hits as (select id, list_filter(list_transform(tokens, lambda t, i: case when t in ({known}) then {token} end), lambda h: h is not null) as hits from listed),
folded as (select id, list_reduce(list_concat([{start}], hits), lambda a, x: {step}) as f from hits)
select id, round(case when f.n > 0 then f.total / f.n else 0.0 end, 6) as sentiment from folded"""


@query("sentiment_in_context", _in_context)
def sentiment_in_context(spark, sf):
    """Negations and strengthening words count, so the tokens are all words of the text."""
    rows = posts(spark, sf).withColumn("tokens", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    scored = lookup.score_sentiment(rows, presets.POLARITY_STARTER, negations=presets.NEGATION_STARTER, strengths=presets.STRENGTH_STARTER)
    return scored.select("id", F.round("sentiment", 6).alias("sentiment"))


SHARES = """round(avg(sentiment), 6) as mean, round(stddev_samp(sentiment), 6) as std,
  round(avg(cast(sentiment > 0.1 as int)), 6) as positive_ratio, round(avg(cast(sentiment < -0.1 as int)), 6) as negative_ratio"""


@query("sentiment_summary", lambda: f"with {_scored()} select {SHARES} from scored")
def sentiment_summary(spark, sf):
    return describe.sentiment_summary(scored(spark, sf))


@query("sentiment_by_stage", lambda: f"with {_scored()} select visa_stage, {SHARES} from scored where visa_stage <> 'unknown' group by 1")
def sentiment_by_stage(spark, sf):
    return describe.sentiment_by(scored(spark, sf), "visa_stage")


@query("sentiment_by_group", lambda: f"""with {_scored()} select subreddit, round(avg(sentiment), 6) as mean,
  round(stddev_samp(sentiment), 6) as std from scored where subreddit in {TOP10.format('scored')} group by 1""")
def sentiment_by_group(spark, sf):
    return describe.sentiment_by(saved(spark, scored(spark, sf)), "subreddit", (), 10)


def _bigrams(tokens: str) -> str:
    return f"[concat({tokens}[i], ' ', {tokens}[i + 1]) for i in range(1, len({tokens}))]"


@query("ngrams", lambda: f"with {S.cleaned_cte()} select id, array_to_string({_bigrams('tokens')}, '|') as bigrams from cleaned")
def ngrams(spark, sf):
    return cleaned(spark, sf).select("id", F.array_join(T.ngrams(F.col("tokens"), 2), "|").alias("bigrams"))


def _vocab(size: int) -> str:
    return f"""{S.cleaned_cte()},
terms as (select id, unnest(list_concat(tokens, {_bigrams('tokens')})) as term from cleaned),
counts as (select id, term, count(*) as tf from terms group by 1, 2),
vocab as (select term, cast(sum(tf) as bigint) as cf, count(*) as df from counts group by 1
  having count(*) >= 5 and count(*) <= (select count(*) from cleaned) * cast(0.7 as double) order by cf desc, term limit {size})"""


@query("vocabulary", lambda: f"with {_vocab(1000)} select * from vocab")
def vocabulary(spark, sf):
    docs = saved_cleaned(spark, sf)
    return words.corpus_vocabulary(docs)


@query("tfidf", lambda: f"""with {_vocab(300)}, w as (select id, term,
  tf * (ln((1 + (select count(*) from cleaned)) / (1 + df)) + 1) as w from counts join vocab using (term))
select id, term, round(w / sqrt(sum(w * w) over (partition by id)), 6) as weight from w""")
def tfidf(spark, sf):
    docs = saved_cleaned(spark, sf)
    vocab = saved(spark, words.corpus_vocabulary(docs, 300))
    return words.tfidf(docs, vocab, known=words.words_of(vocab))


STAGE_NAMES = [s.name for s in presets.STAGES_5] + ["unknown"]


@query("crosstab", f"with {S.POSTS}, {S.STAGED} select subreddit, "
       + ", ".join(f"count(*) filter (where visa_stage = '{s}') as {s}" for s in STAGE_NAMES)
       + " from staged group by 1")
def crosstab(spark, sf):
    return describe.crosstab(staged(spark, sf), "subreddit", "visa_stage", STAGE_NAMES)


@query("crosstab_lineitem", "select l_returnflag, count(*) filter (where l_linestatus = 'O') as \"O\", "
       "count(*) filter (where l_linestatus = 'F') as \"F\" from lineitem group by 1")
def crosstab_lineitem(spark, sf):
    return describe.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"])


EDGES = f"{S.POSTS}, {S.STAGED}, edges as (select subreddit as source, visa_stage as target, count(*) as weight from staged group by 1, 2)"


@query("cooccurrence_edges", f"with {EDGES} select * from edges")
def cooccurrence_edges(spark, sf):
    return describe.cooccurrence_edges(staged(spark, sf), "subreddit", "visa_stage")


@query("cooccurrence_nodes", f"""with {EDGES} select distinct source as node, 'subreddit' as node_type from edges
union all select distinct target, 'visa_stage' from edges""")
def cooccurrence_nodes(spark, sf):
    edges = describe.cooccurrence_edges(staged(spark, sf), "subreddit", "visa_stage")
    return describe.cooccurrence_nodes(edges, "subreddit", "visa_stage")


@query("histogram", """with b as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)
select cast(least(floor((l_extendedprice - lo) / ((hi - lo) / 50)) + 1, 50) as int) as bin, count(*) as n
from lineitem, b group by 1""")
def histogram(spark, sf):
    return describe.histogram(table(spark, sf, "lineitem"), "l_extendedprice")


@query("histogram_words", lambda: f"""with {S.cleaned_cte()}, b as (select min(word_count) as lo, max(word_count) as hi from cleaned)
select cast(least(floor((word_count - lo) / ((hi - lo) / 50)) + 1, 50) as int) as bin, count(*) as n
from cleaned, b group by 1""")
def histogram_words(spark, sf):
    return describe.histogram(saved_cleaned(spark, sf), "word_count")


NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("correlation_matrix", " union all ".join(
    f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for a in NUMERIC for b in NUMERIC))
def correlation_matrix(spark, sf):
    return describe.correlation_matrix(table(spark, sf, "lineitem"))


@query("term_cloud", lambda: f"""with {S.words_cte()}, top as (select word, count(*) as n from words group by 1
  order by n desc, word limit 100) select word, n, round(n / max(n) over (), 6) as weight from top""")
def term_cloud(spark, sf):
    return words.term_cloud(cleaned(spark, sf))


@query("term_cloud_by_stage", lambda: f"""with {S.words_cte()}, ranked as (
  select *, row_number() over (partition by visa_stage order by n desc, word) as r from (
    select visa_stage, word, count(*) as n from words where visa_stage <> 'unknown' group by 1, 2))
select visa_stage, word, n, round(n / max(n) over (partition by visa_stage), 6) as weight from ranked where r <= 50""")
def term_cloud_by_stage(spark, sf):
    return words.term_cloud(saved_cleaned(spark, sf), "visa_stage", 50)


HOLED = """holed as (select case when event_id % 10 = 0 then null else user_id end as user_id,
  case when event_id % 4 = 0 then ' ' else event_type end as event_type,
  case when event_id % 6 = 0 then 'bad' else strftime(ts, '%Y-%m-%d') end as day from events)"""


@query("quality_report", f"""with {HOLED}
select 'null' as "check", 'user_id' as "column", count(*) filter (where user_id is null) as n from holed
union all select 'null', 'event_type', count(*) filter (where event_type is null) from holed
union all select 'null', 'day', count(*) filter (where day is null) from holed
union all select 'empty_text', 'event_type', count(*) filter (where trim(event_type) = '') from holed
union all select 'invalid_timestamp', 'day', count(*) filter (where try_cast(day as date) is null) from holed
union all select 'duplicate_rows', '', (select count(*) from holed) - (select count(*) from (select distinct * from holed))""")
def quality_report(spark, sf):
    i = F.col("event_id")
    rows = table(spark, sf, "events").select(
        F.when(i % 10 != 0, F.col("user_id")).alias("user_id"),
        F.when(i % 4 == 0, " ").otherwise(F.col("event_type")).alias("event_type"),
        F.when(i % 6 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"))
    return describe.quality_report(rows, ["event_type"], ["day"])


@query("quality_documents", " union all ".join(
    f"""select 'null' as "check", '{c}' as "column", count(*) filter (where {c} is null) as n from documents"""
    for c in ("doc_id", "text", "lang", "source", "n_chars")) + """
union all select 'empty_text', 'text', count(*) filter (where trim(text) = '') from documents
union all select 'duplicate_rows', '', (select count(*) from documents) - (select count(*) from (select distinct * from documents))""")
def quality_documents(spark, sf):
    return describe.quality_report(table(spark, sf, "documents"), ["text"], [])


@query("text_stats", """select min(length(text)) as min_length, max(length(text)) as max_length,
  round(avg(length(text)), 6) as mean_length, round(stddev_samp(length(text)), 6) as std_length,
  round(median(length(text)), 6) as median_length from (select text from documents)""")
def text_stats(spark, sf):
    out = describe.text_stats(table(spark, sf, "documents"))
    return out.withColumns({c: F.col(c).cast("long") for c in ("min_length", "max_length")})


@query("vocabulary_size", lambda: f"with {S.words_cte()} select count(distinct word) as vocabulary_size from words")
def vocabulary_size(spark, sf):
    return describe.vocabulary_size(cleaned(spark, sf))


@query("group_size_stats", f"""with {S.POSTS} select count(*) as groups, min(n) as min_posts, max(n) as max_posts,
  round(avg(n), 6) as mean_posts from (select subreddit, count(*) as n from posts group by 1)""")
def group_size_stats(spark, sf):
    return describe.group_size_stats(posts(spark, sf))
