"""What the optimizer makes of the operators."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from threadscope.catalog import QUERIES, fixtures
from threadscope.operators import cleaning, ranking, sampling, temporal
from threadscope.plans import reports
from threadscope.sources import files, readers, writers

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def moved(df):
    """What each exchange of rows takes in; broadcasts aside."""
    found, lines = [], plan(df).splitlines()
    for i, line in enumerate(lines):
        if line.endswith(" Exchange"):
            found.append(lines[i + 1])
    return found


def stored(spark, tmp_path):
    rows = fixtures.posts(spark, SF).withColumns({"month": F.month("created_ts"), "fear": (F.col("id") % 3 == 0).cast("int")})
    rows.repartition(4).write.parquet(str(tmp_path / "p"))
    return spark.read.parquet(str(tmp_path / "p"))


def test_samples_and_splits_move_no_text(spark, tmp_path):
    rows = stored(spark, tmp_path)
    for df in (sampling.stratified_sample(rows, ["subreddit", "month"], 0.3), sampling.sample_per_file_n(rows, 5),
               sampling.stratified_split(rows, "subreddit"), files.with_file_rows(rows)):
        assert "text" in df.columns and not moved(df) and df.count()
    saved = []
    original = ranking.scratch_path
    try:
        ranking.scratch_path = lambda *a: saved.append(original(*a)) or saved[-1]
        sampling.sample_per_file_n(rows, 5)
    finally:
        ranking.scratch_path = original
    assert [set(spark.read.parquet(p).columns) for p in saved] == [
        {"source_file", "_block", "_at", "_everything"}, {"source_file", "_cut", "_everything"}]


def test_duplicates_are_told_by_address(spark, tmp_path):
    rows = stored(spark, tmp_path)
    small = cleaning.dedupe_files(rows, ("text", "subreddit"), ("created_ts", "id"))
    assert not moved(small)
    whole = cleaning.dedupe(rows, ("text", "subreddit"), ("created_ts", "id"))
    assert sorted(map(str, small.collect())) == sorted(map(str, whole.collect()))


def test_partition_filters_and_pruned_columns(spark, tmp_path):
    rows = fixtures.posts(spark, SF).withColumns({"year": F.year("created_ts"), "month": F.month("created_ts")})
    writers.write_parquet(rows, str(tmp_path / "p"), ["year", "month"])
    text = plan(readers.read_posts(spark, str(tmp_path / "p"), [2024], [1]).select("id"))
    assert "PartitionFilters: [isnotnull(year" in text and "ReadSchema: struct<id:bigint>" in text


def test_report_is_one_scan_and_two_exchanges(spark, tmp_path):
    fixtures.posts(spark, SF).write.parquet(str(tmp_path / "p"))
    text = plan(reports.rollup_report(reports.file_counts(spark.read.parquet(str(tmp_path / "p")))))
    assert text.count("Scan parquet") == 2  # the tree and its details: one scan
    assert "ReadSchema: struct<text:string,created_ts:timestamp,source_file:string>" in text
    assert "Python" not in text and "NestedLoop" not in text


def test_event_windows_need_no_join_and_push_the_range(spark, tmp_path):
    fixtures.posts(spark, SF).write.parquet(str(tmp_path / "p"))
    text = plan(temporal.event_windows(spark.read.parquet(str(tmp_path / "p")), fixtures.TEST_EVENTS).select("id"))
    assert "Join" not in text and "Exchange" not in text and "GreaterThanOrEqual(created_ts" in text


def test_cleaning_runs_once_below_its_filter(spark):
    rows = cleaning.preprocess(fixtures.table(spark, SF, "documents"))
    uses = [df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
            for df in (rows, cleaning.drop_invalid(rows))]
    assert uses[0] == uses[1] > 0


def test_no_plan_has_a_product_or_python(spark):
    for name, run in QUERIES.items():
        if name in ("topic_terms", "assign_topics", "topic_distribution", "train_and_predict", "evaluate_classifier",
                    "lemmatize_by_table", "batch_topic_terms", "batch_topic_shares") or "stream" in name or name == "live_counts":
            continue  # they train, stream, or start from a Python list
        text = plan(run(spark, SF))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow"):
            # Quotes before a line are counted in the order of its file, which no DataFrame operator keeps without a shuffle.
            assert bad not in text or (name, bad) == ("read_csv_folder", "MapInArrow"), (name, bad)


def test_two_years_take_one_scan_with_a_pushed_range(spark, tmp_path):
    rows = spark.sql("select concat('fear ', id) as text, timestamp'2023-06-01' + make_dt_interval(cast(id as int)) as created_ts, 'f' as source_file from range(1000)")
    rows.write.parquet(str(tmp_path / "p"))
    tidy = reports.tidy_years(spark.read.parquet(str(tmp_path / "p")), (2024, 2025))
    plan = reports.insights(reports.pct_changes(reports.compare_years(tidy, 2024, 2025)))._jdf.queryExecution().optimizedPlan().toString()
    text = tidy._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 1 and "PushedFilters: [IsNotNull(created_ts), GreaterThanOrEqual(created_ts" in text
    assert plan.count("Relation [") <= 2
    got = {(r["year"], r["metric"]): r["value"] for r in tidy.collect()}
    assert got[2024, "total_records"] == 366 and got[2025, "total_records"] == 365


def test_curves_take_their_labels_from_the_data(spark):
    from threadscope.operators import evaluation

    rows = [(i, label, i % 2, (i * 7 % 10) / 10) for i in range(40) for label in ("no preset", "quality")] + [(1, None, 1, 0.5)]
    df = spark.createDataFrame(rows, "id long, label string, y_true int, score double")
    assert {r["label"] for r in evaluation.roc_auc(df).collect()} == {"no preset", "quality", "micro_average", "macro_average"}
    assert {r["label"] for r in evaluation.roc_points(df).collect()} == {"no preset", "quality"}
    assert {r["label"] for r in evaluation.pr_points(df, ["quality"]).collect()} == {"quality"}


def test_terms_are_counted_inside_the_row(spark):
    from threadscope.operators import words

    docs = spark.createDataFrame([(i, ["a", "b", "a", f"w{i % 7}"]) for i in range(60)], "id long, tokens array<string>")
    totals = words.term_totals(docs)
    assert "hashpartitioning(id" not in totals._jdf.queryExecution().executedPlan().toString()
    got = {r["term"]: (r["cf"], r["df"]) for r in totals.collect()}
    assert got["a"] == (120, 60) and got["a b"] == (60, 60) and got["w3"] == (9, 9)
    weights = words.tfidf(docs, words.vocabulary(totals, docs, 5, 1, 1.0))
    plan = weights._jdf.queryExecution().executedPlan().toString().split("Window", 1)[1]
    assert plan.count("hashpartitioning(id") == 1


def test_texts_stay_where_they_are_read_however_many_events(spark):
    """Beyond the size that Spark broadcasts by itself, only times move: no text is shuffled or sorted for the join."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("term_cloud", "seasonal_posts", "ngrams"):
            text = plan(QUERIES[name](spark, SF))
            assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_posts_of_fewer_events_than_documents(spark, tmp_path):
    """Every document then takes the first event, as in the SQL."""
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/events.parquet").filter("event_id < 20").write.parquet(str(tmp_path / "events.parquet"))
    first = spark.read.parquet(f"{SF}/events.parquet").filter("event_id = 0").first()
    for stay in (False, True):
        rows = fixtures.posts(spark, str(tmp_path), texts_stay=stay)
        assert rows.count() == 200 and {r.author for r in rows.select("author").collect()} == {f"a{first['user_id']}"}
