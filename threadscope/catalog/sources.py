"""A1–A13. The files each reader needs are first written by Spark from the driver tables into a scratch folder."""

from pyspark.sql import functions as F

from threadscope.catalog import sql as S
from threadscope.catalog.fixtures import order_posts, posts, table
from threadscope.catalog.registry import query
from threadscope.plans import reports
from threadscope.plans.study import StageStore
from threadscope.session import scratch_path
from threadscope.sources import files, readers, writers

LENGTHS = "count(*) as n, cast(sum(length(text)) as bigint) as chars"


def lengths(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


def stored_posts(spark, sf):
    """Posts in year and month folders."""
    path = scratch_path(spark, "posts")
    rows = posts(spark, sf).withColumns({"year": F.year("created_ts"), "month": F.month("created_ts")})
    writers.write_parquet(rows, path, ["year", "month"])
    return path


SPLITS_PER_FILE = 4


def few_files(df):
    """Fewer and bigger files than the input has splits, two at least; their number grows with the input, so that no task
    writes more than some splits."""
    return df.coalesce(max(2, -(-df.rdd.getNumPartitions() // SPLITS_PER_FILE)))


@query("read_posts", f"""with {S.POSTS} select cast(year(created_ts) as int) as year, cast(month(created_ts) as int) as month,
  {LENGTHS} from posts where year(created_ts) = 2024 and month(created_ts) in (1, 2, 3) group by 1, 2""")
def read_posts(spark, sf):
    return lengths(readers.read_posts(spark, stored_posts(spark, sf), [2024], [1, 2, 3]), "year", "month")


@query("read_json_lines", f"select lang, {LENGTHS} from documents group by 1")
def read_json_lines(spark, sf):
    path = scratch_path(spark, "json")
    table(spark, sf, "documents").write.json(path)
    return lengths(readers.read_json_lines(spark, path, "doc_id long, text string, lang string"), "lang")


@query("read_csv_tolerant", """with kept as (select doc_id, source,
    case when lang <> 'fr' and doc_id % 7 = 0 then null else replace(text, chr(13), ' ') end as text, lang
  from documents where lang = 'fr' or doc_id % 10 <> 0)
select lang, count(*) as n, count(text) as with_text, cast(sum(length(text)) as bigint) as chars from kept
join (select distinct doc_id, lang from documents) using (doc_id, lang) group by 1""")
def read_csv_tolerant(spark, sf):
    """French texts go to Latin-1 files; the others to UTF-8 files where every tenth line has a field too many and
    every seventh one too few."""
    utf, latin = scratch_path(spark, "csv-utf8"), scratch_path(spark, "csv-latin1")
    docs = table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", "\r", " "))
    quoted = F.concat(F.lit('"'), F.regexp_replace("text", '"', '""'), F.lit('"'))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), F.col("source"),
                       F.when((F.col("doc_id") % 7 != 0) | (F.col("doc_id") % 10 == 0), quoted),
                       F.when(F.col("doc_id") % 10 == 0, "one,more"))
    docs.filter("lang <> 'fr'").select(line).write.text(utf)
    docs.filter("lang = 'fr'").select("doc_id", "source", "text").write.option("encoding", "ISO-8859-1").option(
        "escape", '"').csv(latin)
    found = files.discover_files(spark, utf, (".txt",)).unionByName(files.discover_files(spark, latin))
    names = files.paths_of(found)
    rows = readers.read_csv_tolerant(spark, names, ["doc_id", "source", "text"], header=False)
    langs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang")
    return rows.join(langs, "doc_id").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count("text").alias("with_text"),
        F.sum(F.length("text").cast("long")).alias("chars"))


@query("read_csv_folder", """with kept as (select doc_id, source,
    case when doc_id % 10 <> 0 and doc_id % 7 = 0 then null else replace(text, chr(13), ' ') end as text
  from documents where doc_id % 10 <> 0 or doc_id % 4 = 0)
select cast(doc_id as varchar) as doc_id, source, md5(text) as digest, cast(length(text) as bigint) as chars from kept""")
def read_csv_folder(spark, sf):
    """Big files with line breaks in quoted texts, each read by many tasks; every tenth line has a field too many, but for every
    twentieth, and every seventh one too few."""
    path = scratch_path(spark, "csv-folder")
    docs = table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", "\r", " "))
    quoted = F.concat(F.lit('"'), F.regexp_replace("text", '"', '""'), F.lit('"'))
    tenth = F.col("doc_id") % 10 == 0
    line = F.concat_ws(",", F.col("doc_id").cast("string"), F.col("source"), F.when(tenth | (F.col("doc_id") % 7 != 0), quoted),
                       F.when(tenth & (F.col("doc_id") % 4 != 0), "one,more"))
    few_files(docs.select(line)).write.text(path)
    rows = readers.read_csv_folder(spark, path, ["doc_id", "source", "text"], header=False, glob="*.txt")
    return rows.select("doc_id", "source", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))


@query("discover_files", f"""with {S.POSTS} select distinct '.parquet' as suffix, cast(year(created_ts) as int) as year,
  cast(month(created_ts) as int) as month from posts""")
def discover_files(spark, sf):
    found = files.discover_files(spark, stored_posts(spark, sf))
    return found.filter("file_size > 0").select("suffix", "year", "month").distinct()


@query("skip_bad_files", "select count(*) as n, cast(1 as bigint) as failed from orders")
def skip_bad_files(spark, sf):
    """Good files beside one that is no Parquet: all good rows, and the bad file in the report."""
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    orders.write.parquet(good)
    broken = orders.agg(F.concat(F.lit("rows="), F.count(F.lit(1)).cast("string")).alias("value"))
    broken.write.option("compression", "none").text(bad)
    rows = files.with_lineage(readers.read_lenient_parquet(spark, [good, bad], orders.schema))
    listed = files.discover_files(spark, good).unionByName(files.discover_files(spark, bad, (".txt",)))
    report = files.failure_report(listed, rows).agg(F.count(F.lit(1)).alias("failed"))
    return rows.agg(F.count(F.lit(1)).alias("n")).select("n", report.scalar().alias("failed"))


def priority_files(spark, sf):
    """Orders with one file per priority."""
    path = scratch_path(spark, "by-priority")
    table(spark, sf, "orders").repartition("o_orderpriority").write.partitionBy("o_orderpriority").parquet(path)
    return path


@query("with_lineage", """select o_orderpriority, cast(1 as bigint) as files, count(*) as total_rows, count(*) as n,
  cast(0.5 as double) as sample_rate from orders group by 1""")
def with_lineage(spark, sf):
    rows = files.with_lineage(spark.read.parquet(priority_files(spark, sf))).filter("file_size > 0")
    return files.with_file_rows(rows, rate=0.5).groupBy("o_orderpriority").agg(
        F.count_distinct("source_file").alias("files"), F.max("total_rows").alias("total_rows"),
        F.count(F.lit(1)).alias("n"), F.max("sample_rate").alias("sample_rate"))


@query("first_files", """select o_orderpriority, count(*) as n from orders where o_orderpriority in
  (select distinct o_orderpriority from orders order by 1 limit 2) group by 1""")
def first_files(spark, sf):
    path = priority_files(spark, sf)
    chosen = files.paths_of(files.first_files(files.discover_files(spark, path), 2))
    return spark.read.option("basePath", path).parquet(*chosen).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"))


@query("resolve_column", """select 'text' as resolved, cast(sum(length(text)) as bigint) as chars from documents""")
def resolve_column(spark, sf):
    docs = table(spark, sf, "documents").withColumn("text_2", F.lit(""))
    column = readers.resolve_column(docs)
    return docs.agg(F.lit(column).alias("resolved"), F.sum(F.length(readers.text_or_empty(docs, column)).cast("long")).alias("chars"))


@query("schema_violations", f"""with {S.POSTS} select 'text' as "column", true as present, cast(0 as bigint) as violations
union all select 'subreddit', true, count(*) filter (where id % 5 = 0) from posts
union all select 'created_utc', false, count(*) from posts""")
def schema_violations(spark, sf):
    rows = posts(spark, sf).withColumn("subreddit", F.when(F.col("id") % 5 != 0, F.col("subreddit")))
    return readers.schema_violations(rows)


@query("write_parquet", f"""with {S.POSTS} select id, cast(year(created_ts) as int) as year,
  cast(month(created_ts) as int) as month, length(text) as chars from posts""")
def write_parquet(spark, sf):
    return spark.read.parquet(stored_posts(spark, sf)).select(
        "id", "year", "month", F.length("text").cast("long").alias("chars"))


@query("write_csv_all_string", """select cast(event_id as varchar) as event_id, cast(user_id as varchar) as user_id,
  event_type, props from events""")
def write_csv_all_string(spark, sf):
    path = scratch_path(spark, "strings")
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "props")
    writers.write_csv_all_string(rows, f"{path}/csv", f"{path}/parquet")
    back = spark.read.schema("event_id string, user_id string, event_type string, props string").option(
        "header", "true").option("escape", '"').csv(f"{path}/csv")
    return back.join(spark.read.parquet(f"{path}/parquet").select("event_id", "props"), ["event_id", "props"])


@query("write_report", f"""with {S.POSTS}, {S.tagged()} select cast(year(created_ts) as int) as year,
  cast(month(created_ts) as int) as month, count(*) as total_records,
  cast(sum(cast(has_fear as int)) as bigint) as total_fear from tagged group by 1, 2""")
def write_report(spark, sf):
    path = scratch_path(spark, "report")
    writers.write_report(reports.monthly_report(reports.file_counts(posts(spark, sf))), path)
    return spark.read.schema("year int, month int, total_records long, total_fear long").json(path)


@query("report_as_json", """select concat('{"l_returnflag":"', l_returnflag, '","n":', count(*), '}') as json
from lineitem group by l_returnflag""")
def report_as_json(spark, sf):
    return writers.as_json(table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")))


@query("load_or_run", f"with {S.ORDER_POSTS} select id, visa_stage from order_posts where visa_stage <> 'O'")
def load_or_run(spark, sf):
    """The first call runs the stage; the second is not selected and reads what the first saved."""
    store = StageStore(spark, scratch_path(spark, "stages"))
    store.load_or_run("kept", lambda: order_posts(spark, sf).filter("visa_stage <> 'O'"), selected=True)
    return store.load_or_run("kept", lambda: order_posts(spark, sf), selected=False).select("id", "visa_stage")
