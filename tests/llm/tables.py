"""Small tables with the hard cases: nulls everywhere, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import duckdb

SF = "/root/testdata/sf0.001"

LINE = "the same line stands in many documents"
LONG = "word " * 30_000 + "end"
HARD = [
    (1, "Alpha beta\n" + LINE + "\ngamma"), (2, "  " + LINE.upper() + "\t\nother text here"), (3, LINE + "\n" + LINE + "\nlast"),
    (4, None), (5, ""), (6, "\n\n"), (7, LONG), (7, LONG), (8, "ünïcödé ☃ " * 40), (9, "one"), (10, "one"),
    (11, LINE), (12, "Alpha beta\n" + LINE + "\ngamma"), (None, LINE + "\nno id"), (None, None), (-3, "negative id " + LINE),
    (13, "x" * 5000), (14, "x" * 5000 + "y"), (15, "\x00\x1f\x85\xa0 odd blanks\x0b\x0c\r\n\r\n"),
]
#: The extra columns clash with names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, keep int, rank int, h1 long, shard string"


def hard_docs(spark, rows=None):
    rows = HARD if rows is None else rows
    return spark.createDataFrame([(d, t, None, "s", None, "x", 1, 2, 3, "z") for d, t in rows], SCHEMA).repartition(3)


def rows_of(name: str, columns: str = "*") -> list[tuple]:
    return duckdb.sql(f"select {columns} from '{SF}/{name}.parquet'").fetchall()
