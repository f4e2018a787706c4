"""Decontamination, top-k, sharding and licences against brute force and SQL."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import HARD, SF, hard_docs, rows_of

from threadscope.llm import decontaminate, licenses, sharding, topk
from threadscope.llm.catalog import ORACLES, QUERIES


def check_sql(spark, name):
    for t in ("documents", "embeddings"):
        duckdb.sql(f"create or replace view {t} as select * from '{SF}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF), duckdb.sql(ORACLES[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op3_licenses", "op9_shard_of_key", "op10_topk"])
def test_query_equals_sql(spark, name):
    check_sql(spark, name)


# --- decontamination ------------------------------------------------------------------------------------------------
def contained_by_hand(docs, items, least=0.8):
    word = re.compile("[a-z0-9\x80-\U0010ffff]+")

    def shingles(text):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i:i + 5]) for i in range(max(len(w) - 5, 0) + 1)} if w else set()

    out = set()
    for d, text in docs:
        have = shingles(text)
        for i, item in items:
            s = shingles(item)
            if s and len(s & have) >= least * len(s) - 1e-9:
                out.add((d, i, len(s), len(s & have)))
    return out


def test_items_in_documents(spark):
    docs, items = rows_of("documents", "doc_id, text"), rows_of("benchmark", "item_id, text")
    got = {tuple(r)[:4] for r in QUERIES["op1_decontaminate"](spark, SF).collect()}
    assert got == contained_by_hand(docs, items)


def test_partial_items_ties_and_hard_rows(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words)), (2, "one"), (3, None), (4, ""), (5, "..."), (6, "three short words"), (1, " ".join(words)), (None, "word " * 9)]
    docs = [*HARD, (30, "pre " + " ".join(words[:34]) + " post"), (31, "pre " + " ".join(words[:30]) + " post"), (32, "x " * 50 + " ".join(words[4:]).upper()),
            (33, "three, short WORDS!"), (34, "three short words and more")]
    frame = hard_docs(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc"], r["item"], r["n_shingles"], r["n_shared"]) for r in decontaminate.contaminated(frame, bench).collect()}
    assert got == contained_by_hand(docs, items)
    assert {(30, 1), (32, 1), (33, 6)} <= {g[:2] for g in got} and (31, 1) not in {g[:2] for g in got}
    sliced = decontaminate.contained(frame, bench, slice_bytes=10)
    assert {(r["doc"], r["item"], r["n_shingles"], r["n_shared"]) for r in sliced.collect()} == got
    kept = decontaminate.without_items(frame, bench)
    assert kept.schema == frame.schema
    dirty = {g[0] for g in got}
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(repr(d) for d, _ in docs if d not in dirty)
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    assert decontaminate.without_items(hard_docs(spark, []), bench).count() == 0


# --- top-k ----------------------------------------------------------------------------------------------------------
def top_by_hand(rows, k=5):
    rows = [(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in rows if i % 50 == 0}:
        x = min(v for i, v in rows if i == q)
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.3, 6))]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 420)]  # one very common vector
    rows += [(500, None), (501, [0.1, None]), (502, [float("nan")] * 6), (None, [1.0] * 6), (503, [float("inf")] * 6), (550, [1.0, -1.0]), (600, []), (1, [0.5] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int".replace(", label int", "")).repartition(3)
    vectors = topk.usable(df)
    got = topk.top_k(vectors, vectors.filter("id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == top_by_hand(rows)
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_broadcasts_no_vectors(spark, monkeypatch):
    """Queries that are repeated for every block go to its task, and no candidate is repeated with them."""
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "BATCH", 2)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.3, 4 + i % 3))]) for i in range(400)]
    vectors = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    got = topk.top_k(vectors, vectors.filter("id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == top_by_hand(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(4)
    x, q = rng.integers(-9, 9, (200, 5)), rng.integers(-9, 9, (3, 5)).astype(float)
    lists, last = topk.Lists(np.arange(200), x, 5), None
    for depth in (1, 50, 120, 200):
        low, high = topk.bounds(lists, q, depth)
        exact = q @ x.T
        assert (low <= exact).all() and (exact <= high).all()
        assert last is None or ((low >= last[0]).all() and (high <= last[1]).all())
        last = (low, high)
    assert (low == exact).all() and (high == exact).all()


def test_scores_beyond_double_precision_are_exact():
    big = np.array([[2**31, 1], [2**31, 2], [3, 4]], np.int64)
    lists = topk.Lists(np.array([1, 2, 3]), big, 2)
    found = topk.top_of_block(lists, np.array([9]), np.array([[2**31 - 1, 1]], np.int64), 2)
    assert found == [(9, 2, (2**31 - 1) * 2**31 + 2), (9, 1, (2**31 - 1) * 2**31 + 1)]


# --- shards ---------------------------------------------------------------------------------------------------------
def jump(key, n):
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("block", [20_000, 1])
def test_shards_of_hard_rows(spark, block):
    rows = [*HARD, *[(-(1 << 63), "low"), ((1 << 63) - 1, "high")], *[(77, "copy")] * 40]
    got = sharding.assign(hard_docs(spark, rows), block=block).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", jump(d or 0, 24), jump(d or 0, 25)) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(hard_docs(spark, [])).count() == 0


def test_copies_of_a_row_are_numbered_in_many_blocks(spark):
    docs = spark.range(3000).select((F.when(F.col("id") < 1000, 5).otherwise(F.col("id"))).alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.assign(docs, shards=2, block=50)
    # Tiny partitions would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written = got.filter("doc_id = 5").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in written) == 1000 and len(written) > 1
    for r in got.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect():
        assert (r["slots"], r["lo"], r["hi"]) == (r["n"], 0, r["n"] - 1)


def test_shard_column_needs_no_shuffle(spark):
    df = sharding.with_shard(hard_docs(spark, [(5, "x")]))
    assert df.columns[-1] == "_shard" and df.first()["_shard"] == jump(5, 24)


def test_sharding_of_documents(spark):
    texts = dict(rows_of("documents", "doc_id, text"))
    for r in QUERIES["op9_sharding"](spark, SF).collect():
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), jump(r["doc_id"], 24), jump(r["doc_id"], 25))


# --- licences -------------------------------------------------------------------------------------------------------
def test_licences_are_inherited_from_the_nearest_directory(spark):
    mit, apache, gpl = (licenses.TEMPLATES[i][1] for i in (1, 0, 2))
    rows = [
        (1, "r/LICENSE", mit), (2, "r/a/COPYING", "intro\n" + apache.upper()), (3, "r/a/b/code", "x\ny"), (4, "r/c/code", None), (5, "r/c/own", "text\n" + gpl),
        (6, "q/code", ""), (7, None, mit), (8, "code", "a licence of one's own"), (9, "r/a/b/code", "x\ny"), (10, "ra/code", "no licence"), (11, None, None),
    ]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string").drop("license").repartition(3)
    got = {r["doc_id"]: (r["license"], r["origin"], r["source_dir"], r["line"]) for r in licenses.scan(files).collect()}
    assert got == {
        1: ("MIT", "own", None, 0), 2: ("Apache-2.0", "own", None, 1), 3: ("Apache-2.0", "inherited", "r/a", None), 4: ("MIT", "inherited", "r", None),
        5: ("GPL-3.0", "own", None, 1), 6: (None, "none", None, None), 7: ("MIT", "own", None, 0), 8: (None, "none", None, None),
        9: ("Apache-2.0", "inherited", "r/a", None), 10: (None, "none", None, None), 11: (None, "none", None, None)}
    assert licenses.scan(files.limit(0)).count() == 0


def test_headers_whole_files_and_notices_in_long_lines(spark):
    text = {}
    for name, t in licenses.TEMPLATES:
        if len(t) > len(text.get(name, "")):
            text[name] = t
    filler = "und dann kam der Regen über das weite Land " * 30

    def wrapped(name, sign):
        w = text[name].split()
        return "\n".join(sign + " " + " ".join(w[i:i + 9]) for i in range(0, len(w), 9))

    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "Everyone is permitted to copy this document.\n\n" * 40
    rows = [
        ("Apache-2.0", "a/main.c", "# Copyright 2021 A. Person\n" + wrapped("Apache-2.0", "#") + "\n\nimport x\n" + filler, 0),
        ("GPL-3.0", "b/main.c", "\n \n" + wrapped("GPL-3.0", " *") + "\n\n" + filler, 0),
        ("GPL-2.0", "c/main.c", filler + "\n\n" + wrapped("GPL-2.0", "//"), None),
        ("MIT", "d/LICENSE", text["MIT"].replace(": ", ":\n\n").replace(". ", ".\n\n"), None),
        ("BSD-3-Clause", "e/COPYING.txt", text["BSD-3-Clause"].upper().replace(". ", ".\n\n"), 0),
        ("BSD-2-Clause", "f/license.md", text["BSD-2-Clause"].replace(". ", ".\n \n"), 0),
        ("ISC", "g/LICENSE", "ISC License\n\nCopyright (c) 2004 by someone\n\n" + text["ISC"].replace(". ", ".\n\n"), None),
        ("GPL-3.0", "h/COPYING", gpl, 0),
        ("MIT", "i/x", filler + ". Released under the MIT License. " + filler, 0),
        ("MPL-2.0", "j/x.py", "/* " + text["MPL-2.0"].replace("License, v. ", "License, v.\n * ") + " */\n\n" + filler, 0),
        (None, "k/x", "the software and the warranty of the author\n\n" + filler, None),
        (None, "l/LICENSE", filler + "\n\n" + filler, None),
    ]
    files = spark.createDataFrame([(i, p, t) for i, (_, p, t, _) in enumerate(rows)] + [(100 + i, f"z/{i}", filler) for i in range(60)], "doc_id long, path string, text string").repartition(3)
    got = {r["doc_id"]: r for r in licenses.scan(files).collect()}
    assert len(got) == 72
    for i, (name, path, _, line) in enumerate(rows):
        assert (got[i]["license"], got[i]["origin"]) == (name, "own" if name else "none"), (path, got[i])
        assert line is None or got[i]["line"] == line, (path, got[i])
