"""Readers, writers, streams and the whole run."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from threadscope.catalog import fixtures
from threadscope.operators import cleaning
from threadscope.operators.tagging import tag_posts
from threadscope.plans import study
from threadscope.sources import files, readers, writers
from threadscope.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_csv_bad_lines_and_encodings(spark, tmp_path):
    good, latin = tmp_path / "a.csv", tmp_path / "b.csv"
    good.write_text('id,a,text\n1,x,"hello, ""w"" y"\n2,y,plain\n3,z\n4,q,"a",extra\n5,r,"multi\nline, here"\n'
                    '6,s,"a",\n8,,v\n', encoding="utf-8")
    latin.write_bytes("id,a,text\n9,x,café\n".encode("latin-1"))
    df = readers.read_csv_tolerant(spark, [str(good), str(latin)], ["id", "a", "text"])
    assert df.count() == 6
    assert {tuple(r) for r in df.collect()} == {
        ("1", "x", 'hello, "w" y'), ("2", "y", "plain"), ("3", "z", None), ("5", "r", "multi\nline, here"),
        ("8", None, "v"), ("9", "x", "café")}


def test_csv_folder_reads_one_file_in_many_tasks(spark, tmp_path):
    rng = random.Random(5)
    piece = lambda: rng.choice(["word", '"', "\n", ",", "\n\n", "é", " ", "x" * 30, '""'])
    rows = [(str(i), "".join(piece() for _ in range(rng.randrange(1, 12))) + ".") for i in range(3000)]
    rows[700] = ("700", "a\n" * 9000 + ".")  # longer than several splits
    quoted = [f'{i},"{t.replace(chr(34), chr(34) * 2)}"' for i, t in rows]
    quoted[10:10] = ['x,"too",many', "short", "", '"7\n7","with ""line"" breaks, in both\n"']
    folder = tmp_path / "csv" / "deep"
    folder.mkdir(parents=True)
    (folder / "big.csv").write_bytes(("id,text\n" + "\n".join(quoted) + "\n").encode())
    (folder / "latin.csv").write_bytes("id,text\r\n9000,café\r\n9001,\"b\r\nc\"\r\n".encode("latin-1"))
    (folder / "mark.csv").write_bytes('\ufeff"id\nof",text\n9002,last'.encode())
    (folder / "empty.csv").write_bytes(b"")
    (folder / "other.txt").write_bytes(b"no,table\n")
    want = sorted([*rows, ("short", None), ("7\n7", 'with "line" breaks, in both\n'), ("9000", "café"),
                   ("9001", "b\r\nc"), ("9002", "last")])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for bound in (readers.BLOCKS_BROADCAST, 0):
            df = readers.read_csv_folder(spark, str(tmp_path / "csv"), ["id", "text"], max_blocks=bound)
            assert sorted(map(tuple, df.collect())) == want
        assert spark.read.text(str(folder / "big.csv")).rdd.getNumPartitions() > 10
        listed = readers.read_csv_tolerant(spark, [str(folder / "big.csv")], ["id", "text"])
        assert listed.exceptAll(df).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert readers.read_csv_folder(spark, str(folder), ["id", "text"], glob="empty.csv").isEmpty()


def test_unreadable_file_is_reported(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "good"))
    (tmp_path / "good" / "broken.parquet").write_text("no parquet at all, just some words in a file")
    rows = files.with_lineage(readers.read_lenient_parquet(spark, str(tmp_path / "good"), "id long"))
    assert rows.count() == 10
    report = files.failure_report(files.discover_files(spark, str(tmp_path / "good")).filter("file_size > 0"), rows)
    assert [r.path.rsplit("/", 1)[1] for r in report.collect() if "broken" in r.path] == ["broken.parquet"]


def test_whole_file_without_rows_is_no_failure(spark, tmp_path):
    """A task without rows leaves a file with a footer only; cut short, or with other marks, it is reported."""
    good = tmp_path / "good"
    spark.range(10).write.parquet(str(good))
    spark.range(0).coalesce(1).write.mode("append").parquet(str(good))
    sizes = {p: len(spark.read.parquet(str(p)).collect()) for p in good.glob("*.parquet")}
    empty = next(p for p, n in sizes.items() if n == 0).read_bytes()
    for name, content in (("cut", empty[:-1]), ("short", empty[:20]), ("longer", empty[:4] + b"xx" + empty[4:])):
        (good / f"{name}.parquet").write_bytes(content)
    rows = files.with_lineage(readers.read_lenient_parquet(spark, str(good), "id long"))
    report = files.failure_report(files.discover_files(spark, str(good)), rows)
    assert sorted(r.path.rsplit("/", 1)[1] for r in report.collect()) == ["cut.parquet", "longer.parquet", "short.parquet"]
    none = files.failure_report(files.discover_files(spark, str(good)).filter("path like '%part-%'"), rows)
    assert none.isEmpty()


def test_files_grow_in_number_with_the_input(spark):
    from threadscope.catalog.sources import few_files

    assert [few_files(spark.range(0, 100, 1, n)).rdd.getNumPartitions() for n in (1, 3, 8, 9, 40)] == [1, 2, 2, 3, 10]


def test_first_files_and_paths(spark, tmp_path):
    for i in range(4):
        spark.range(i, i + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / f"d{i}"))
    found = files.discover_files(spark, str(tmp_path))
    assert len(files.paths_of(files.first_files(found, 2))) == 2
    assert len(files.paths_of(found)) == 4


def test_schema_check_and_column_search(spark):
    df = spark.createDataFrame([("a", None)], "Body string, subreddit string")
    assert readers.resolve_column(df) == "Body"
    assert readers.resolve_column(df, ("date", "time")) is None
    assert readers.missing_columns(df) == ["text", "created_utc"]
    got = {r.column: (r.present, r.violations) for r in readers.schema_violations(df).collect()}
    assert got == {"text": (False, 1), "subreddit": (True, 1), "created_utc": (False, 1)}


def test_all_string_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nnext', 0.5), (2, None, None)], "i int, t string, d double")
    writers.write_csv_all_string(df, str(tmp_path / "c"), str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert [t for _, t in back.dtypes] == ["string"] * 3
    assert {tuple(r) for r in back.collect()} == {("1", 'a "q", b\nnext', "0.5"), ("2", None, None)}
    csv = readers.read_csv_tolerant(spark, files.paths_of(files.discover_files(spark, str(tmp_path / "c"))), ["i", "t", "d"])
    assert {tuple(r) for r in csv.collect()} == {tuple(r) for r in back.collect()}


def test_stream_in_batches_equals_batch_and_resumes(spark, tmp_path):
    source, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    posts = fixtures.posts(spark, SF)
    posts.filter("id % 2 = 0").repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def go():
        jobs.ingest_stream(jobs.post_stream(spark, source, schema, files_per_batch=1), out, ck).awaitTermination()

    go()
    half = spark.read.parquet(out).count()
    posts.filter("id % 2 = 1").repartition(2).write.mode("append").parquet(source)
    go()
    assert half == posts.filter("id % 2 = 0").count()
    want = tag_posts(posts)
    got = spark.read.parquet(out).select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_batch_lost_between_write_and_entry(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    posts = fixtures.posts(spark, SF)
    posts.repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema
    enter, lost = jobs._enter, []

    def fail_once(session, target, number, rows):
        if number == 1 and not lost:
            lost.append(rows)
            raise RuntimeError("lost")
        enter(session, target, number, rows)

    def go():
        jobs.ingest_batches(jobs.post_stream(spark, source, schema, files_per_batch=1), out).awaitTermination()

    monkeypatch.setattr(jobs, "_enter", fail_once)
    with pytest.raises(StreamingQueryException):
        go()
    assert lost and (tmp_path / "out" / "rows" / "batch=1").exists()
    assert [r.batch for r in jobs.ledger(spark, out).collect()] == [0]
    assert jobs.committed(spark, out).count() == jobs.ledger(spark, out).first().rows < posts.count()
    go()
    go()
    want = tag_posts(posts)
    got = jobs.committed(spark, out).select(*want.columns)
    assert sorted(r.batch for r in jobs.ledger(spark, out).collect()) == [0, 1, 2]
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_first_by_time_whatever_the_order_of_arrival(spark, tmp_path):
    base, rng = datetime(2024, 3, 1), random.Random(4)
    schema = "id int, created_ts timestamp, text string, subreddit string"
    rows = [(i, base + timedelta(minutes=rng.randrange(600)), rng.choice("abcdefgh"), rng.choice(["s", None])) for i in range(200)]
    rows += [(200 + i, *rows[i][1:]) for i in range(20)]  # ties in time
    late = (900, base + timedelta(days=30), "end", "s")
    rng.shuffle(rows)
    source, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for part in (rows[:70], rows[70:150], rows[150:], [late], [(901, base, "a", "s")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        first = jobs.stream_first(jobs.post_stream(spark, source, schema))
        jobs.start(first, out, ck).awaitTermination()
    want = cleaning.dedupe(spark.createDataFrame(rows, schema), ("text", "subreddit"), ("created_ts", "id"))
    got = spark.read.parquet(out)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_live_counts_drop_late_rows(spark, tmp_path):
    source, base = str(tmp_path / "in"), datetime(2024, 3, 1, 12)
    batches = [[(base, "afraid?")], [(base + timedelta(days=3), "x")], [(base, "too late"), (base + timedelta(days=5), "y")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "created_ts timestamp, text string").coalesce(1).write.mode("append").parquet(source)
        counts = jobs.live_counts(jobs.post_stream(spark, source, "created_ts timestamp, text string"))
        jobs.start(counts, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.day: (r.total_records, r.total_fear, r.total_qa) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {date(2024, 3, 1): (1, 1, 1), date(2024, 3, 4): (1, 0, 0)}


def test_stream_dedupe_across_batches(spark, tmp_path):
    source, base = str(tmp_path / "in"), datetime(2024, 3, 1, 12)
    for rows in ([(base, "a", "s"), (base, "b", "s")], [(base + timedelta(minutes=5), "a", "s"), (base, "a", None)]):
        spark.createDataFrame(rows, "created_ts timestamp, text string, subreddit string").coalesce(1).write.mode(
            "append").parquet(source)
        stream = jobs.post_stream(spark, source, "created_ts timestamp, text string, subreddit string")
        jobs.start(jobs.stream_dedupe(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted((r.text, r.subreddit or "") for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", ""), ("a", "s"), ("b", "s")]


def test_whole_study(spark, tmp_path):
    posts = fixtures.posts(spark, SF).select(
        "id", "text", "subreddit", "author", F.unix_timestamp("created_ts").cast("string").alias("created_utc"), "source_file")
    settings = study.StudySettings(min_rows_per_file=1000, stratum_rate=1.0, topics=3, topic_iterations=3,
                                   events=fixtures.TEST_EVENTS)
    with pytest.raises(study.MissingStage):
        study.run_study(posts, str(tmp_path), ["descriptive"], settings)
    with pytest.raises(ValueError):
        study.run_study(posts, str(tmp_path), ["charts"], settings)
    written = study.run_study(posts, str(tmp_path), settings=settings)
    assert {w.split("/")[1] for w in written} == {"descriptive", "evaluation", "temporal"}
    empty = {n.rsplit("/", 1)[1] for n in written if spark.read.text(str(tmp_path / n)).isEmpty()}
    assert empty <= {"significant_changes", "error_counts"}
    again = study.run_study(posts, str(tmp_path), ["temporal"], settings)
    assert all(w.startswith("reports/temporal") for w in again)
    sampled = spark.read.parquet(str(tmp_path / "sampling"))
    rare = sampled.filter("draw is null and is_rare_event").count()
    assert sampled.filter("draw is not null").count() == 2 * rare
