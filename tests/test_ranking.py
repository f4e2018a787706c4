"""Samples and running totals against brute force, with one group that holds most rows."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadscope.operators import cleaning, describe, evaluation, lookup, ranking, sampling
from threadscope.sources import files


def rows(n=3000):
    """Two thirds of all rows in one group, some groups of a single row, some null keys."""
    return [(i, "hot" if i % 3 else (None if i % 99 == 0 else f"g{i % 60 if i % 2 else i}")) for i in range(n)]


def h(i, seed="42"):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def brute(data, quota):
    groups = {}
    for i, g in data:
        if g is not None:
            groups.setdefault(g, []).append(i)
    kept = set()
    for ids in groups.values():
        kept |= set(sorted(ids, key=h)[: quota(len(ids))])
    return kept


@pytest.mark.parametrize("parts, digits", [(1, 1), (4, 2), (16, 3)])
def test_stratified_sample_is_exact_for_any_layout(spark, parts, digits):
    data = rows()
    df = spark.createDataFrame(data, "id int, g string").repartition(parts)
    kept = ranking.keep_by_hash(df, ["g"], ["id"], lambda n: F.greatest(F.floor(n * F.lit(0.1)), F.lit(1)), digits=digits)
    assert {r.id for r in kept.collect()} == brute(data, lambda n: max(math.floor(n * 0.1), 1))


@pytest.mark.parametrize("few", [500_000, 3])
def test_cutoffs_beside_ranks(spark, monkeypatch, few):
    """Few groups: cutoffs; many: ranked rows. No group, a quota of none, one above the rows, and text ids with ties in the hash prefix."""
    monkeypatch.setattr(ranking, "CUTS_BROADCAST", few)
    data = rows()
    df = spark.createDataFrame([(str(i), g, "t" * (i % 9)) for i, g in data], "id string, g string, text string").repartition(5)
    for quota in (lambda n: n * 0, lambda n: F.lit(1), lambda n: F.floor(n / 2), lambda n: n + 5):
        got = {int(r.id) for r in ranking.keep_by_hash(df, ["g"], ["id"], quota, digits=1).collect()}
        assert got == brute(data, {0: lambda n: 0, 1: lambda n: 1}.get(spark.range(1).select(quota(F.lit(7))).first()[0], lambda n: n // 2 if len(got) < 2900 else n))
    split = sampling.stratified_split(df, "g", 0.25)
    assert split.columns == ["id", "g", "text", "split"]
    assert {int(r.id) for r in split.filter("split = 'validation'").collect()} == brute(data, lambda n: math.floor(n * 0.25 + 0.5))
    assert split.count() == sum(g is not None for _, g in data)
    everyone = [(i, "all") for i, _ in data]
    for n in (0, 7, 5000):
        assert {int(r.id) for r in ranking.keep_by_hash(df, [], ["id"], lambda _: F.lit(n)).collect()} == brute(everyone, lambda _: n)
    empty = df.filter("id is null")
    assert ranking.keep_by_hash(empty, ["g"], ["id"], lambda n: n).count() == 0


def test_ranks_cover_each_group(spark):
    df = spark.createDataFrame(rows(), "id int, g string")
    got = ranking.hash_ranked(df, ["g"], ["id"], digits=1).groupBy("g").agg(
        F.sort_array(F.collect_list("_rank")).alias("r"), F.max("_n").alias("n")).collect()
    assert all(r.r == list(range(1, r.n + 1)) for r in got)


def test_oversample_draws(spark):
    df = spark.createDataFrame([(i, i % 4 == 0) for i in range(400)], "id int, rare boolean")
    got = {r.draw: r.id for r in sampling.oversample(df, F.col("rare")).collect()}
    order = sorted(range(0, 400, 4), key=h)
    assert got == {i: order[int(h(i)[:8], 16) % 100] for i in range(200)}


def test_dedupe_keeps_first_of_many_copies(spark):
    data = [(i, "same" if i % 3 else f"t{i}", None if i % 2 else "s", 1000 - i) for i in range(2000)]
    df = spark.createDataFrame(data, "id int, text string, subreddit string, created_utc int")
    firsts = {}
    for i, t, s, c in data:
        if (t, s) not in firsts or (c, i) < firsts[t, s]:
            firsts[t, s] = (c, i)
    for parts in (1, 8):
        got = cleaning.dedupe(df.repartition(parts))
        assert got.columns == df.columns
        assert {r.id for r in got.collect()} == {i for _, i in firsts.values()}


@pytest.mark.parametrize("max_chunks", [90_000, 0])
def test_dedupe_files(spark, tmp_path, max_chunks):
    """A third of all rows share a key; null keys, a null order, ties, many chunks a file; rows beyond the bitmaps' bound."""
    data = [(i, None if i % 50 == 0 else "same" if i % 3 else f"t{i % 4000}", None if i % 2 else "s", None if i % 7 == 0 else 9000 - i % 600, "x" * (i % 11)) for i in range(12_000)]
    data += data[:40]
    df = spark.createDataFrame(data, "id int, text string, subreddit string, created_utc int, extra string")
    df.repartition(2, "id").write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    firsts = {}
    for i, t, s, c, _ in data:
        place = (c is None, c or 0, i)
        firsts[t, s] = min(firsts.get((t, s), place), place)
    got = cleaning.dedupe_files(stored, max_chunks=max_chunks)
    assert got.columns == df.columns
    kept = got.collect()
    assert len(kept) == len(firsts) and {r.id for r in kept} == {i for _, _, i in firsts.values()}
    narrow = cleaning.dedupe_files(stored.select("text", "id").filter("id >= 6000"), ("text",), ("id",), max_chunks=max_chunks)
    assert narrow.columns == ["text", "id"] and narrow.count() == len({t for i, t, *_ in data if i >= 6000})
    assert cleaning.dedupe_files(stored.filter("id < 0"), max_chunks=max_chunks).count() == 0


def test_file_rows_beyond_the_broadcast_limit(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b" if i % 2 else None) for i in range(90)], "id int, source_file string")
    few, many = (sorted(map(str, files.with_file_rows(df, rate=0.5, max_files=n).select("id", "source_file", "total_rows", "sample_rate").collect())) for n in (10, 1))
    assert few == many and len(few) == 90
    assert {(r.source_file, r.total_rows) for r in files.with_file_rows(df).collect()} == {("a", 60), ("b", 15), (None, None)}


def test_sketches_of_any_range_are_close(spark):
    """United sketches count what their months share once; nulls are no value."""
    rows = spark.range(120_000).selectExpr("2024 + id % 2 as year", "id % 12 + 1 as month", "if(id % 10 = 0, null, id % 40000) as v", "'same' as w")
    stored = describe.distinct_sketches(rows, ["v", "w"])
    assert stored.columns == ["year", "month", "column", "sketch"] and stored.selectExpr("max(octet_length(sketch))").first()[0] < 20_000
    for months in ("month <= 3", "month = 5", "year = 2024", "true"):
        got = {r["column"]: r.n for r in describe.distinct_from_sketches(stored.filter(months)).collect()}
        exact = rows.filter(months).selectExpr("count(distinct v)").first()[0]
        assert abs(got["v"] - exact) <= 0.03 * exact and got["w"] == 1
    yearly = {(r["year"], r["column"]) for r in describe.distinct_from_sketches(stored, ["year"]).collect()}
    assert len(yearly) == 4
    assert describe.distinct_from_sketches(stored.limit(0)).count() == 0


def test_correlations_against_numpy(spark):
    """Nulls pair by pair, a large mean with a small spread, constants, two blocks of pairs."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 10))
    x[:, 1] += x[:, 0]
    x[:, 2] = 1e9 + x[:, 0] / 100
    x[:, 3] = 0.1
    x[:, 4] = np.round(x[:, 4] * 5)
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(10)])
    frame.loc[rng.random(400) < 0.3, "c5"] = None
    frame.loc[rng.random(400) < 0.5, "c6"] = None
    frame["c7"] = np.nan
    frame.loc[frame.c6.notna() & frame.c5.notna(), "c8"] = None
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in frame.to_numpy()], ", ".join(f"c{i} double" for i in range(10)))
    want = frame.astype(float).drop(columns="c3").corr()
    got = {(r.a, r.b): r.r for r in describe.correlation_matrix(df.repartition(3)).collect()}
    assert len(got) == 100
    for (a, b), r in got.items():
        w = want[a][b] if "c3" not in (a, b) else float("nan")
        if pd.isna(w):
            assert r is None or frame[[a, b]].dropna().shape[0] < 3, (a, b, r)
        else:
            assert r == pytest.approx(w, abs=2e-6), (a, b)
    assert {r.r for r in describe.correlation_matrix(df.limit(0)).collect()} == {None}
    assert describe.correlation_matrix(df.select()).count() == 0


def eval_rows(n=1200):
    return [(i, "a" if i % 5 else "b", int((i * 7919) % 10 < 3), int(i % 3 == 0), ((i * 37) % 211) / 211) for i in range(n)]


def auc(pairs):
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def precision_sum(pairs):
    total, seen, tp, out = sum(y for y, _ in pairs), 0, 0, 0.0
    for s in sorted({s for _, s in pairs}, reverse=True):
        at = [y for y, t in pairs if t == s]
        seen, tp = seen + len(at), tp + sum(at)
        out += sum(at) / total * tp / seen
    return out


def test_auc_and_average_precision(spark):
    data = eval_rows()
    df = spark.createDataFrame(data, "id int, label string, y_true int, y_pred int, score double")
    got = {r.label: r.roc_auc for r in evaluation.roc_auc(df, ("a", "b")).collect()}
    ap = {r.label: r.average_precision for r in evaluation.average_precision(df, ("a", "b")).collect()}
    for label in "ab":
        pairs = [(y, s) for _, x, y, _, s in data if x == label]
        assert got[label] == pytest.approx(auc(pairs), abs=2e-6)
        assert ap[label] == pytest.approx(precision_sum(pairs), abs=2e-6)
    assert got["micro_average"] == pytest.approx(auc([(y, s) for *_, y, _, s in data]), abs=2e-6)
    assert got["macro_average"] == pytest.approx((got["a"] + got["b"]) / 2, abs=2e-6)
    flipped = {r.label: r.roc_auc for r in evaluation.roc_auc(df.withColumn("score", -F.col("score")), ("a", "b")).collect()}
    assert all(flipped[x] == pytest.approx(1 - got[x], abs=2e-6) for x in got)


@pytest.mark.parametrize("splits", [1, 4, 9, 50, 400])
def test_running_totals_do_not_depend_on_the_cuts(spark, splits):
    data = [(k, v * v % 1009, 1 + v % 3) for k in "ab" for v in range(300)]
    df = spark.createDataFrame(data, "k string, v int, n int").groupBy("k", "v").agg(F.sum("n").alias("n"))
    got = ranking.running_totals(df, "k", ["a", "b"], "v", ["n"], splits).collect()
    assert len(got) == df.count()
    for r in got:
        assert r.cum_n == sum(n for k, v, n in data if k == r.k and v >= r.v)


def test_counts_add_up_and_undefined_is_zero(spark):
    df = spark.createDataFrame(eval_rows(), "id int, label string, y_true int, y_pred int, score double")
    for r in evaluation.confusion(df).collect():
        total = r.true_negatives + r.false_positives + r.false_negatives + r.true_positives
        assert total == sum(1 for x in eval_rows() if x[1] == r.label)
    one_class = spark.createDataFrame([(1, "a", 0, 0, 0.5), (2, "a", 0, 1, 0.7)], df.schema)
    assert {r.roc_auc for r in evaluation.roc_auc(one_class, ("a",)).collect()} == {0.0}
    metrics = evaluation.label_metrics(one_class).first()
    assert (metrics.precision, metrics.recall, metrics.f1_score, metrics.support) == (0.0, 0.0, 0.0, 0)


def fold(words, polarity, negations, strengths):
    total, n, strength, negated = 0.0, 0, 1.0, -10**6
    for i, w in enumerate(words):
        if w in polarity:
            value = max(-1.0, min(1.0, polarity[w] * strength)) * (-0.5 if i - negated <= 3 else 1)
            negated = -10**6 if i - negated <= 3 else negated
            total, n, strength = total + value, n + 1, 1.0
        elif w in strengths:
            strength *= strengths[w]
        else:
            negated, strength = (i if w in negations else negated), 1.0
    return total / n if n else 0.0


def test_sentiment_in_context(spark):
    """Both ways, in the row and joined, against a plain loop; nothing is shuffled in the row."""
    polarity, negations, strengths = {"good": 0.7, "bad": -0.7, "best": 1.0, "not_bad": 0.3}, ("not", "no"), {"very": 1.3, "barely": 0.4, "good": 9.0}
    fixed = [["not", "good"], ["not", "very", "good"], ["very", "very", "best"], ["not", "a", "b", "c", "good"], ["no", "bad", "good"],
             ["very", "x", "good"], ["not"], [], ["barely", "bad", "best"], ["not", "not", "bad"], ["not_bad", "very"]]
    rng = np.random.default_rng(1)
    data = fixed + [list(rng.choice(["good", "bad", "best", "not", "no", "very", "barely", "x", "y"], rng.integers(0, 30))) for _ in range(200)]
    data = [[str(w) for w in words] for words in data]
    df = spark.createDataFrame(list(enumerate(data)) + [(-1, None)], "id int, tokens array<string>")
    table = spark.createDataFrame([*polarity.items(), (None, 1.0), ("x", None)], "token string, polarity double")
    for how in ({}, {"in_row": 2}, {"in_row": 2, "max_rows": 1}):
        got = lookup.score_sentiment(df, table, negations=negations, strengths=strengths, **how)
        assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == bool(how)
        found = {r.id: r.sentiment for r in got.collect()}
        assert found.pop(-1) is None
        assert found == {i: pytest.approx(fold(words, polarity, negations, strengths)) for i, words in enumerate(data)}
    many = {f"w{i}": i / 5000 for i in range(5000)}
    found = lookup.score_sentiment(df.limit(0).unionByName(spark.createDataFrame([(i, [f"w{i}", "w1"]) for i in range(2, 5000, 7)], "id int, tokens array<string>")), many)
    assert all(r.sentiment == pytest.approx((r.id + 1) / 10000) for r in found.collect())


def test_word_join_beyond_the_broadcast_limit(spark):
    posts = spark.createDataFrame(
        [(i, ["the"] * 5 + ([f"w{i}"] if i % 2 else [])) for i in range(200)], "id int, tokens array<string>")
    table = spark.createDataFrame([("the", "THE", 0.5)] + [(f"w{i}", f"W{i}", -0.25) for i in range(100)],
                                  "token string, lemma string, polarity double")
    small = lookup.lemmatize_by_table(posts, table)
    large = lookup.lemmatize_by_table(posts, table, max_rows=3)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert small.filter("id = 1").first().tokens == ["THE"] * 5 + ["W1"]
    a = {r.id: r.sentiment for r in lookup.score_sentiment(posts, table).collect()}
    b = {r.id: r.sentiment for r in lookup.score_sentiment(posts, table, max_rows=3, in_row=3).collect()}
    assert a == b and a[0] == 0.5 and a[1] == pytest.approx((5 * 0.5 - 0.25) / 6)


def test_plurals_by_endings_and_vocabulary(spark):
    known = ["visa", "box", "church", "dish", "policy", "wolf", "fireman", "glass", "bus", "buse", "news", "s", "quiz", "class"]
    plurals = {"visas": "visa", "boxes": "box", "churches": "church", "dishes": "dish", "wolves": "wolf", "firemen": "fireman",
               "glasses": "glass", "policies": "policy", "buses": "bus", "children": "child", "classes": "class"}
    same = ["glass", "news", "unknowns", "s", "ses", "running", "bus", ""]
    tokens = [*plurals, *same, "visas"]
    df = spark.createDataFrame([(1, tokens), (2, []), (3, None)], "id int, tokens array<string>")
    vocabulary = spark.createDataFrame([(w,) for w in [*known, "visa", None]], "token string")
    for bound in (lookup.BROADCAST_ROWS, 1):
        got = {r.id: r.tokens for r in lookup.lemmatize_nouns(df, vocabulary, max_rows=bound).collect()}
        assert got == {1: [*plurals.values(), *same, "visa"], 2: [], 3: None}
    table = lookup.noun_lemmas(spark.createDataFrame([("visas",), ("visas",), (None,)], "token string"), vocabulary)
    assert [tuple(r) for r in table.collect()] == [("visas", "visa")]
    assert lookup.noun_lemmas(df.limit(0).select(F.explode("tokens").alias("token")), vocabulary).isEmpty()


def test_vocabulary_of_a_corpus(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", "c"]), (3, ["b"])], "id int, tokens array<string>")
    assert sorted(r.token for r in lookup.corpus_words(df, 2).collect()) == ["a", "b"]
