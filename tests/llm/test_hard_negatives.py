"""Hard negatives against brute force: hard rows, tiny blocks, hot vectors; bounds, curve and exact products."""

import duckdb
import numpy as np
import pytest
from tables import SF

from threadscope.llm import hard_negatives
from threadscope.llm.catalog import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, key string, rank int, block string, anchor string"


def by_hand(rows, n_pos=5, n_neg=10, low=30, high=90):
    used = []
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(v is not None and np.isfinite(np.float32(v)) for v in x):
            used.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * float(np.float32(v)))) for v in x)))
    anchors = {}
    for i, label, x in sorted(used):
        if i % 100 == 0:
            anchors.setdefault(i, (label, x))
    out = []
    for i, (label, x) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, other == label) for j, other, y in used if j != i)
        for p, j, _ in [s for s in scored if s[2]][:n_pos]:
            found = [s for s in scored if not s[2] and low * -p <= 100 * -s[0] <= high * -p][:n_neg]
            out += [(i, j, r + 1, s[1], -p, -s[0]) for r, s in enumerate(found)]
    return sorted(out)


def found(spark, rows, **limits):
    df = spark.createDataFrame([(i, x, label, "k", 1, "b", "a") for i, x, label in rows], SCHEMA).repartition(3)
    usable = hard_negatives.usable(df).selectExpr("id", "case when id % 7 = 0 then (label + 1) % 10 else label end as label", "x")
    return sorted(map(tuple, hard_negatives.hard_negatives(usable, usable.filter("id % 100 = 0"), **limits).collect()))


@pytest.mark.parametrize("block", [3, 512])
def test_hard_rows(spark, monkeypatch, block):
    """Nulls, odd numbers, unlike lengths, ties, repeated ids, equal rows, a vector on a third of the rows; few rows a block and a chunk."""
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ZONES", 7)
    monkeypatch.setattr(hard_negatives, "SLICE", 2)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(v) for v in rng.normal(size=6).round(1)], int(rng.integers(0, 3))) for i in range(-150, 320)]
    rows = [(i, [0.5, 0.5, 0.0, 0.0, 0.0, 0.25] if i % 3 == 0 and i > 0 else x, label) for i, x, label in rows]
    rows += [(None, [1.0] * 6, 1), (500, None, 1), (600, [1.0] * 6, None), (700, [1.0, None], 1), (800, [float("nan")] * 6, 1), (900, [float("inf")] * 6, 0)]
    rows += [(1000, [], 1), (1100, [1.0] * 6, 1), (1100, [0.5] * 6, 1), (1200, [1.0, 2.0], 2), (1300, [-3.0] * 8, 0), (77, [0.5] * 6, 1)] * 3
    want = by_hand(rows)
    assert found(spark, rows) == want and len(want) > 100


def test_other_limits_and_empty(spark):
    rng = np.random.default_rng(6)
    rows = [(i * 50, [float(v) for v in rng.normal(size=3)], i % 2) for i in range(40)]
    assert found(spark, rows, positives=2, negatives=3, low=0, high=120) == by_hand(rows, 2, 3, 0, 120)
    assert found(spark, []) == [] and found(spark, rows[:1]) == []


def test_curve_is_one_step_at_a_time():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        place = hard_negatives.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(8)
    for scale in (100, 1 << 29):
        rows, anchors = rng.integers(-scale, scale, (50, 9)), rng.integers(-scale, scale, (7, 9))
        scores = hard_negatives.products(anchors, rows)
        assert scores.tolist() == [[sum(int(x) * int(y) for x, y in zip(a, r)) for r in rows] for a in anchors]
        low, high = hard_negatives.bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
        assert (low <= scores.min(axis=1)[:, None]).all() and (high >= scores.max(axis=1)[:, None]).all()
    with pytest.raises(OverflowError):
        hard_negatives.products(np.full((1, 4), 1 << 61), np.full((1, 4), 1 << 61))
    for x in ([], [0], [-32768, 32767], [32768], [-(1 << 31)], [1 << 40, -5]):
        assert hard_negatives.decode([hard_negatives.encode(np.array(x, np.int64))]).tolist() == [x]


def test_unneeded_blocks_are_not_read(spark, monkeypatch):
    """Two far clusters of each label: the rows of the other one are bounded away."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 8)
    read = []
    original = hard_negatives.meet

    def meet(carriers, visitors, visit, schema):
        read.append((schema, visitors.count() if "block" not in schema else 0))
        return original(carriers, visitors, visit, schema)

    monkeypatch.setattr(hard_negatives, "meet", meet)
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.normal(0, 0.05, 8) + (1 if i % 2 else -1)], i % 4) for i in range(1, 400)]
    assert found(spark, rows) == by_hand(rows)
    pairs = [n for schema, n in read if "block" not in schema]
    assert sum(pairs[:2]) < 4 * 13 and all(pairs[:1])  # positives: of about 13 blocks of the own label for each of three anchors


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    df = QUERIES["op13_hard_negatives"](spark, SF)
    want = con.execute(ORACLES["op13_hard_negatives"])
    assert df.columns == [d[0] for d in want.description]
    rows = sorted(map(tuple, df.collect()))
    assert rows == sorted(want.fetchall()) and rows
