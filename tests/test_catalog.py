"""A cross-section of the queries against DuckDB, and the shape of the driver contract."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows_of
from threadscope.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ("rollup_report", "yearly_report", "insights", "assign_stage", "flag_rare", "stage_hit_counts", "clean_text_compat",
          "preprocess", "dedupe", "cleaning_summary", "top_words_by_stage", "tfidf", "sentiment_by_group", "group_profile",
          "time_distribution_by_group", "quality_report", "sampling_summary", "coverage_report", "annotation_sample",
          "stratified_split", "auto_label_low", "period_changes", "seasonal", "daily_anomalies_orders", "roc_points_lineitem",
          "skip_bad_files", "write_report")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = rows_of(df.columns, map(tuple, df.collect())), rows_of(columns, result.fetchall())
    assert got == want and got


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 120
    assert set(QUERIES) - set(ORACLES) == {
        "topic_terms", "assign_topics", "topic_distribution", "train_and_predict", "evaluate_classifier"}
    assert entry.entry(spark).filter("level = 'all'").count() == 1


def test_saved_posts_hold_no_texts(spark):
    """The stage that many queries share is written without texts that its tokens already hold."""
    from threadscope.catalog import fixtures

    rows = fixtures.saved_cleaned(spark, "/root/testdata/sf0.001")
    written = spark.read.parquet(fixtures._STAGES[spark.sparkContext.applicationId, "/root/testdata/sf0.001", "cleaned"] + "/rows")
    assert written.columns == ["id", "subreddit", "visa_stage", "tokens", "word_count"]
    whole = fixtures.cleaned(spark, "/root/testdata/sf0.001").select(*rows.columns)
    assert rows.exceptAll(whole).isEmpty() and whole.exceptAll(rows).isEmpty()
