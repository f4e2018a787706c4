"""Collocations against brute force: hard rows, ties at the cut, rounds of the frontier, exact scores of large counts."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tables import HARD, SF

from threadscope.llm import collocations
from threadscope.llm.catalog import ORACLES, QUERIES

COLUMNS = "lang string, text string, phrase string, a long, score string"


def by_hand(rows, top, least):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    found = {}
    for (lang, *p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(10**6 * a * a // (f[lang, *p[:k]] * f[lang, *p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            found[lang, *p] = (s, a, f[lang, *p[:k]], f[lang, *p[k:]])
    out = []
    for lang in n:
        kept = []
        for (x, *p), (s, a, left, right) in found.items():
            longer = [b for (y, *q), (_, b, _, _) in found.items() if y == lang and len(q) > len(p) and tuple(p) in (tuple(q[:2]), tuple(q[1:]))]
            if x == lang and not any(100 * b >= 50 * a for b in longer):
                kept.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def found(spark, rows, **limits):
    docs = spark.createDataFrame([(lang, text, "x", 1, "y") for lang, text in rows], COLUMNS).repartition(3)
    return sorted(map(tuple, collocations.collocations(docs, **limits).collect()))


@pytest.mark.parametrize("top", [3, 2000])
def test_random_texts_take_several_rounds(spark, top):
    rng = np.random.default_rng(5)
    marks = [" ", " ", " ", " ", "\t ", ", ", ". ", "\n", "  "]
    rows = []
    for i in range(120):
        words = rng.zipf(1.6, 60) % 25
        rows.append((["en", "de", None, "und", ""][i % 5], "".join(f"W{w}é" + marks[rng.integers(len(marks))] for w in words)))
    rows += [("en", "New York City " * 12), ("en", "x new york")] + [("rare", "one two three")] * 12
    want = by_hand(rows, top, 4)
    assert found(spark, rows, top=top, least=4) == want and len(want) > 10


def test_hard_rows(spark):
    rows = [(["en", None, "und"][i % 3], t) for i, (_, t) in enumerate(HARD)] * 4
    assert found(spark, rows, top=2000, least=10) == by_hand(rows, 2000, 10)


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None), ("en", ""), ("en", "a b c"), ("en", "...")]) == []


def test_ties_at_the_cut(spark):
    """More phrases of the best score than asked for: the count, then the bytes of the phrase decide."""
    rows = [("en", f"é{i} z{i}") for i in range(8)] * 10 + [("en", f"a{i} b{i}") for i in range(3)] * 11
    want = by_hand(rows, 5, 10)
    assert found(spark, rows, top=5, least=10) == want and {w[-1] for w in want} == {10**6}


def test_words_of_a_slice():
    """Neither words nor pieces run on from one text into the next."""
    words = collocations.Words(pa.array(["skipped", "Ab cd", "", "cd", "e\u00e9.x y"]).slice(1))
    assert [words.names[c].as_py().decode() for c in words.code.tolist()] == ["ab", "cd", "cd", "eé", "x", "y"]
    assert words.runs(2).tolist() == [0, 4] and words.runs(3).tolist() == []
    assert collocations.Words(pa.array([], pa.string())).runs(1).tolist() == []


def test_large_counts_are_exact(spark):
    a, left, right = 3 * 10**14 + 1, 4 * 10**14 + 7, 10**15 + 3
    rows = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert rows.select(collocations.score("l", "r")).first()[0] == 10**6 * a * a // (left * right)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = QUERIES["op11_collocations"](spark, SF)
    want = con.execute(ORACLES["op11_collocations"])
    assert df.columns == [d[0] for d in want.description]
    rows = sorted(map(tuple, df.collect()))
    assert rows == sorted(want.fetchall()) and rows
