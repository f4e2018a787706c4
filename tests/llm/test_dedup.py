"""Line dedup, SimHash and byte-string dedup against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from tables import HARD, LINE, SF, hard_docs, rows_of

from threadscope.llm import line_dedup, simhash, suffix_dedup
from threadscope.llm.catalog import ORACLES, QUERIES
from threadscope.llm.common import Powers

LOW = -(1 << 63)


# --- lines ----------------------------------------------------------------------------------------------------------
def dedup_by_hand(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    owners = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                owners[key(line)].add(LOW if doc is None else doc)
    gone = {k: max(v) for k, v in owners.items() if len(v) >= 3}
    return [(doc, text, [x for x in (text or "").split("\n") if gone.get(key(x), doc if doc is not None else LOW) == (LOW if doc is None else doc)])
            for doc, text in rows]


def test_lines_of_hard_rows(spark):
    docs = hard_docs(spark)
    got = line_dedup.dedup_lines(docs)
    assert got.schema == docs.schema
    want = sorted(repr((d, None if t is None else "\n".join(kept))) for d, t, kept in dedup_by_hand(HARD))
    assert sorted(repr((r["doc_id"], r["text"])) for r in got.collect()) == want
    assert [r["text"] for r in got.filter("doc_id = 12").collect()] == ["Alpha beta\n" + LINE + "\ngamma"]


def test_lines_of_a_hot_run_over_many_partitions(spark):
    """One line in all documents: its run spans every partition, and its last document is in the first of them."""
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = [(i % 400, LINE + "\n" + f"a line of its own, number {i}\n" + LINE) for i in range(800)]
        got = line_dedup.dedup_lines(hard_docs(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((d, "\n".join(k)) for d, _, k in dedup_by_hand(rows))


def test_lines_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(hard_docs(spark, [])).count() == 0
    assert line_dedup.keep_bitmaps(hard_docs(spark, [])).count() == 0


def test_bitmap_round_trip():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([[0, 9, 3]])], ["doc", "tkey", "places"])
    keep = next(line_dedup._pack(iter([batch]))).column("keep")[0].as_py()
    assert line_dedup.kept_lines(list("abcdefghijklmnopqr"), keep) == list("bcefghiklmnopqr")


@pytest.mark.parametrize("name", ["op4_line_dedup"])
def test_query_equals_sql(spark, name):
    import duckdb

    for t in ("documents",):
        duckdb.sql(f"create or replace view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = duckdb.sql(ORACLES[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


# --- fingerprints ---------------------------------------------------------------------------------------------------
def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashed = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def components_by_hand(prints):
    """(doc, fingerprint) -> smallest id reachable over links of at most 3 bits."""
    values = sorted({f for _, f in prints})
    parent = {f: f for f in values}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if bin(a ^ b).count("1") <= 3:
                parent[root(a)] = root(b)
    least = {}
    for d, f in prints:
        least[root(f)] = min(least.get(root(f), d), d)
    return {f: least[root(f)] for f in values}


def test_fingerprints_and_components_of_hard_rows(spark):
    got = simhash.near_groups(hard_docs(spark)).collect()
    prints = [(LOW if d is None else d, fingerprint_by_hand(t)) for d, t in HARD]
    comp = components_by_hand(prints)
    assert sorted((r["doc"], r["fp"] % (1 << 64), r["component"]) for r in got) == sorted((d, f, comp[f]) for d, f in prints)


@pytest.mark.parametrize(("tile", "parts"), [(3, 4), (2000, 2)])
def test_links_of_clustered_fingerprints(spark, tile, parts):
    """Chains, dense balls and strangers; small tiles cut every bucket."""
    rng = np.random.default_rng(5)
    values = []
    for _ in range(6):
        f = int(rng.integers(0, 1 << 63))
        for _ in range(int(rng.integers(1, 20))):
            values.append(f)
            for b in rng.integers(0, 64, int(rng.integers(1, 5))):
                f ^= 1 << int(b)
    prints = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(values)]
    comp = components_by_hand([(i, f % (1 << 64)) for i, f in prints])
    first = {f: i for i, f in reversed(prints)}
    nodes = spark.createDataFrame([(f, i) for f, i in first.items()], "fp long, rep long").repartition(2)
    edges = simhash.checkpoint(simhash.links(nodes, simhash.make_plan(nodes, 3, (parts,)), 3, tile))
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= 3 for a, b in edges.collect())
    found = {r["node"]: r["label"] for r in simhash.least_labels(edges, nodes.toDF("node", "label")).collect()}
    assert {f: found.get(f, first[f]) for f in first} == {f: comp[f % (1 << 64)] for f in first}


def test_thresholds_sum_up_to_the_general_pigeonhole():
    for m in (2, 3, 4):
        _, picks = simhash.allocate(1000, [10 * i for i in range(m)], [64 // m] * m, 3)
        assert sum(picks) == 3 - m + 1


@pytest.mark.parametrize("values", [[], [5], [5, -1], [0, 1, 3]])
def test_small_tables_have_small_plans(spark, values):
    """No row or one: nothing to link. A few: at most 64 probes, whatever the estimates say."""
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    plan = simhash.make_plan(nodes, 3)
    assert bool(plan) == (len(values) > 1)
    assert sum(simhash.ball(len(g), t) for g, t in plan) <= 64
    assert {v for edge in simhash.links(nodes, plan, 3).collect() for v in edge} == ({0, 1, 3} if len(values) > 2 else set())
    for m in (2, 3, 4):
        _, picks = simhash.allocate(0, [0] * m, [64 // m] * m, 3)
        assert sum(simhash.ball(64 // m, t) for t in picks if t >= 0) <= 66  # two parts of 32 bits within one bit each


def test_one_document_of_each_group(spark):
    docs = hard_docs(spark)
    got = simhash.one_of_each(docs)
    assert got.schema == docs.schema
    prints = [(LOW if d is None else d, fingerprint_by_hand(t)) for d, t in HARD]
    comp = components_by_hand(prints)
    assert sorted(LOW if r["doc_id"] is None else r["doc_id"] for r in got.collect()) == sorted({comp[f] for _, f in prints})
    assert simhash.one_of_each(hard_docs(spark, [])).count() == 0


@pytest.mark.parametrize("low", [None, 7])
def test_linked_unlike_texts_under_one_id(spark, monkeypatch, low):
    """Two chains whose fingerprints repeat one id: no row is multiplied, no label jumps into the other chain."""
    far = 0x0F0F_F0F0_0F0F_F0F0
    prints = [(low, 0), (9, 1), (low, 3 << 8), (8, far), (low, far ^ 7), (low, far ^ 0x77), (3, far ^ 0x777), (5, 1 << 40), (low, 7 << 40), (low, 0x7F << 40)]
    rows = [(LOW if d is None else d, f) for d, f in prints]
    nodes = spark.createDataFrame(rows, "doc long, fp long").repartition(3)
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, size: docs)
    got = sorted((r["doc"], r["fp"], r["component"]) for r in simhash.near_groups(nodes).collect())
    comp = components_by_hand(rows)
    assert got == sorted((d, f, comp[f]) for d, f in rows)


# --- byte strings ---------------------------------------------------------------------------------------------------
def strings_by_hand(rows):
    first = {}
    texts = [(LOW if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - 49):
            w = b[i:i + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i:i + 50]] < d:
                gone[i:i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 200])
def test_strings_of_hard_rows(spark, slice_bytes):
    passage = "a passage that several documents share, long enough to be found " * 3
    rows = HARD[:6] + HARD[8:] + [(20, "before " + passage), (21, passage + " after"), (22, "x" + passage[3:-9] + "y"), (22, passage), (23, "ab" * 200), (24, "ba" * 90)]
    got = suffix_dedup.dedup_spans(hard_docs(spark, rows), slice_bytes)
    assert sorted(map(tuple, got.collect())) == strings_by_hand(rows)


def test_strings_of_documents(spark):
    got = QUERIES["op7_suffix_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got)) == strings_by_hand(rows_of("documents", "doc_id, text"))


def test_strings_of_an_empty_table(spark):
    assert suffix_dedup.dedup_spans(hard_docs(spark, [])).count() == 0


def test_equal_hashes_of_unlike_strings_are_told_apart(monkeypatch):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (40, suffix_dedup.SEGMENT)).astype(np.uint8)
    rows[20:] = rows[:20]
    doc, sides = np.arange(40), np.full(40, suffix_dedup.REACH)
    want = suffix_dedup.repeated(rows, doc, sides, sides)
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: x & np.uint64(1))
    assert (suffix_dedup.repeated(rows, doc, sides, sides) == want).all()
    assert (want[20:] == suffix_dedup.FULL).all() and not want[:20].any()


def test_every_string_has_its_anchor():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 100, 700).astype(np.uint8)
    at, _ = suffix_dedup.anchors(raw, Powers())
    part, _ = suffix_dedup.anchors(raw[200:400], Powers())
    for s in range(len(raw) - 49):
        assert ((at >= s) & (at <= s + 34)).any()
    inner = {p for p in at - 200 if 34 <= p <= 200 - 50}
    assert inner <= set(part.tolist())


def test_ranges_of_anchors_are_even():
    """Anchors are minima of hashes, so they are small; the parts they are dealt to are of one size nevertheless."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 3000).astype(np.uint8)).decode() for _ in range(60)]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], ["doc", "text"])
    asked = [r for b in suffix_dedup._send_anchors(50, 1 << 20)(iter([batch])) for r in b.to_pylist()]
    sizes = [len(r["hashes"]) // 6 for r in asked if r["part"] >= 0]
    flags = np.unique(np.concatenate([suffix_dedup.anchors(np.frombuffer(t.encode(), np.uint8), Powers())[1] for t in texts]) >> np.uint64(16)).tobytes()
    rows = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array([suffix_dedup._tight(t.encode()) for t in texts]), pa.array([flags] * 60)], ["doc", "packed", "hashes"])
    sent = [r for b in suffix_dedup._send_segments(50, 1 << 20)(iter([rows])) for r in b.to_pylist()]
    for n in (sizes, [len(suffix_dedup._loose(r["docs"])) // 8 for r in sent if r["part"] >= 0]):
        assert len(n) == 50 and max(n) < 1.5 * sum(n) / 50


def test_texts_together_are_as_texts_alone():
    rng = np.random.default_rng(4)
    raws = [rng.integers(0, 3, n).astype(np.uint8) for n in (0, 49, 50, 700, 10, 51, 300)]
    at, h, row = suffix_dedup.Texts(raws).anchors(Powers())
    begin = suffix_dedup.Texts(raws).begin
    for i, raw in enumerate(raws):
        alone = suffix_dedup.anchors(raw, Powers())
        assert (at[row == i] - begin[i]).tolist() == alone[0].tolist() and h[row == i].tolist() == alone[1].tolist()
