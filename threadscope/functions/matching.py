"""Lexicon matching as boolean column expressions that stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = set(".^$*+?()[]{}|\\-")

# Word characters as Python's regular expressions see them, written so that other engines read the same class.
WORD_CLASS = r"\p{L}\p{N}_"


def quote(term: str) -> str:
    """Escape a literal for use inside a regular expression."""
    return "".join("\\" + ch if ch in _META else ch for ch in term)


def minimal_terms(terms: Iterable[str]) -> list[str]:
    """Drop terms that contain another term: a hit on them is already a hit on the shorter one."""
    kept: list[str] = []
    for term in sorted(set(terms), key=lambda t: (len(t), t)):
        if not any(short in term for short in kept):
            kept.append(term)
    return kept


def sql_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_any(column: str, terms: Iterable[str]) -> Column:
    """True where any term occurs as a substring of a lower-cased column; null text gives false.

    A chain of ``contains`` is a byte search per term and stops at the first hit; it is several times faster than one
    alternation in a backtracking regex engine.
    """
    hits = [f"contains(`{column}`, {sql_literal(term)})" for term in minimal_terms(terms)]
    return F.expr(f"coalesce({' or '.join(hits)}, false)")


def whole_word_pattern(words: Iterable[str]) -> str:
    body = "|".join(quote(w) for w in words)
    return f"(?:^|[^{WORD_CLASS}])(?:{body})(?:$|[^{WORD_CLASS}])"


def contains_word(column: str, words: Iterable[str]) -> Column:
    """True where any word occurs between word boundaries; the regex only runs on rows with a substring hit."""
    words = list(words)
    return contains_any(column, words) & F.coalesce(F.col(column).rlike(whole_word_pattern(words)), F.lit(False))


def count_hits(column: str, terms: Iterable[str]) -> Column:
    """Number of distinct terms that occur as a substring."""
    tests = [f"cast(contains(`{column}`, {sql_literal(t)}) as int)" for t in dict.fromkeys(terms)]
    return F.expr(f"coalesce({' + '.join(tests)}, 0)")
