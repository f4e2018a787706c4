"""Phrase collocations of two and three words by best-first branch-and-bound growth.

Phrases grow from their prefixes. A prefix ``x y`` bounds the score of every ``x y z``: with a <= f(x y) and f(y z) >= a,
the first cut scores at most f(x y) / f(x). So three passes over the texts do:

1. count words; words below ``least`` can be in no candidate;
2. count pairs of the others and score them; a pair is also a prefix with its bound;
3. in rounds, count the triples of the frontier: those whose prefix has a bound of at least u, or whose suffix scores
   at least u (it may drop that pair). Then all candidates scoring at least u and all that drop them are known. A language
   with ``top`` survivors at or above u is settled, ties included; the others lower u to four times as many pairs, and
   count what no earlier round has counted. At u = 0 nothing is left to count.

The frontier travels as a bitmap of fixed size (``BITS``): a pair that only shares a bit is counted too, and completely, as
the bit decides alike everywhere. u comes from a histogram of at most 10,001 cells a language.

Words of a chunk of text are encoded by a dictionary, so phrases are compared as themselves, not as hashes, and only a
chunk's distinct phrases leave a task. Scores are decimals of 38 digits: exact up to counts of 10^16.

A null text is empty; a null language is ``und``; rows that repeat count each; a text longer than a chunk is a chunk of its
own. An empty table gives an empty result, and so do texts without a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadscope.llm.common import checkpoint, mix, query, small_batches, table, text_bytes, utf8

LEAST, TOP = 10, 2000
CHUNK = 4 << 20  # bytes of text whose phrases are counted together in a task
BITS = 25  # log2 of the bits of a frontier's bitmap: 4 MB
STEP = 100  # width of a cell of the score histogram
COUNTS = "lang string, phrase string, a long"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK, END, LETTER = 0, 1, 2
KIND = np.full(256, LETTER, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = END


class Words:
    """Words of a column of texts: a dictionary, one code and one piece number a word."""

    def __init__(self, column: pa.Array) -> None:
        data, offsets = text_bytes(column)
        kind = KIND[data]
        inside = kind == LETTER
        edge = np.zeros(len(data) + 1, bool)  # neither a word nor a piece runs on from one text into the next
        edge[offsets] = True
        before, after = np.append(False, inside[:-1])[:len(data)], np.append(inside[1:], False)[:len(data)]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.piece = np.cumsum((kind == END) | edge[:-1], dtype=np.int32)[starts]
        spans = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
        letters = LOWER[data[inside]]
        held = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(spans), pa.py_buffer(letters)])
        found = held.dictionary_encode()
        self.code, self.names = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary

    def hashes(self, lang: str) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(lang.encode())
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.names.to_pylist()), np.uint64, len(self.names))

    def runs(self, size: int) -> np.ndarray:
        """Positions at which ``size`` words of one piece begin."""
        n = len(self.code) - size + 1
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1:]) if n > 0 else np.zeros(0, np.int64)

    def counted(self, at: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray]:
        """Distinct phrases of ``size`` words among those at ``at``, and how often each occurs."""
        key, parts = self.code[at], []
        for j in range(1, size):  # prefixes are numbered densely, so products stay far below 2^63
            known, key = np.unique(key, return_inverse=True)
            parts.append(known)
            key = key * len(self.names) + self.code[at + j]
        known, n = np.unique(key, return_counts=True)
        words = []
        for j in range(size - 1, 0, -1):
            words.append(known % max(len(self.names), 1))
            known = parts[j - 1][known // max(len(self.names), 1)]
        columns = [self.names.take(pa.array(w)) for w in (known, *reversed(words))]
        joined = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())) if size > 1 else columns[0]
        return joined.cast(pa.large_string()), n


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    """Of words, or of pairs of words."""
    seeds = {lang: xxhash.xxh64_intdigest(lang.encode()) for lang in set(langs)}
    words = [p.encode().split(b" ") for p in phrases]
    of = lambda j: np.fromiter((xxhash.xxh64_intdigest(w[j], seeds[x]) for w, x in zip(words, langs)), np.uint64, len(words))
    return pair_hash(of(0), of(1)) if words and len(words[0]) > 1 else of(0)


def has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - BITS)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def bitmap(phrases: DataFrame) -> np.ndarray:
    """The bits of all (lang, phrase): 2^BITS bits, however many there are; tasks send the words they have set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (BITS - 6), np.uint64)
        for batch in batches:
            bit = phrase_hashes(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()) >> np.uint64(64 - BITS)
            np.bitwise_or.at(bits, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], ["at", "bits"])

    rows = phrases.select("lang", "phrase").mapInArrow(run, "at long, bits long")
    found = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2^(BITS - 6) rows at most
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


# --- what a pass counts -------------------------------------------------------------------------------------------
def all_words(words: Words, lang: str) -> np.ndarray:
    return words.runs(1)


def pairs_of(kept, words: Words, lang: str) -> np.ndarray:
    """Pairs of words that are both frequent."""
    good, at = has(kept.value, words.hashes(lang))[words.code], words.runs(2)
    return at[good[at] & good[at + 1]]


def triples_of(now, before, words: Words, lang: str) -> np.ndarray:
    """Triples of the frontier ``now`` (prefixes, suffixes) that no frontier ``before`` has counted."""
    hashed, at = words.hashes(lang)[words.code], words.runs(3)
    pair = pair_hash(hashed[:-1], hashed[1:]) if len(hashed) else hashed
    met = lambda maps: has(maps.value[0], pair[at]) | has(maps.value[1], pair[at + 1])
    at = at[met(now)]
    for maps in before:
        at = at[~met(maps)]
    return at


def counts(docs: DataFrame, size: int, chosen) -> DataFrame:
    """(lang, phrase, a) of the phrases of ``size`` words at the positions that ``chosen(words, lang)`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", CHUNK):
            langs = batch.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                words = Words(batch.column("text").filter(pc.equal(langs.indices, k)))
                phrases, n = words.counted(chosen(words, lang), size)
                out = [pa.repeat(pa.scalar(lang), len(n)), phrases.cast(pa.string()), pa.array(n.astype(np.int64))]
                whole = pa.RecordBatch.from_arrays(out, ["lang", "phrase", "a"])
                for i in range(0, len(n), 50_000):
                    yield whole.slice(i, 50_000)

    return docs.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def word(i: int):
    """The words of a phrase hold no blank."""
    return F.element_at(F.split("phrase", " "), i)


def score(left: str, right: str):
    exact = lambda c: f"cast({c} as decimal(16,0))"
    return F.expr(f"cast(1000000 * {exact('a')} * {exact('a')} as decimal(38,0)) div cast({exact(left)} * {exact(right)} as decimal(38,0))")


def by_lang(rows: DataFrame, per_lang: DataFrame) -> DataFrame:
    """Join to a table of one row a language; languages are few, which is checked before they are broadcast."""
    return rows.join(F.broadcast(per_lang) if per_lang.count() <= 100_000 else per_lang, "lang")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` best surviving phrases of every language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), utf8(docs["text"]).alias("text"))
    words = checkpoint(counts(rows, 1, all_words))
    totals = checkpoint(words.groupBy("lang").agg(F.sum("a").alias("n")))
    words = words.filter(F.col("a") >= least)
    frequent = spark.sparkContext.broadcast(bitmap(words))
    pairs = checkpoint(counts(rows, 2, partial(pairs_of, frequent)).filter(F.col("a") >= least))

    def with_count(left: DataFrame, key, known: DataFrame, name: str) -> DataFrame:
        return left.withColumn("key", key).join(known.select("lang", F.col("phrase").alias("key"), F.col("a").alias(name)), ["lang", "key"]).drop("key")

    scored = with_count(with_count(pairs, word(1), words, "l"), word(2), words, "r")
    scored = checkpoint(scored.withColumns({"score": score("l", "r"), "bound": F.expr("cast(1000000 * cast(a as decimal(16,0)) as decimal(38,0)) div l")}))
    cells = checkpoint(scored.groupBy("lang", F.expr(f"score div {STEP} * {STEP}").alias("u")).agg(F.count("*").alias("n")))
    cells = cells.withColumn("above", F.sum("n").over(Window.partitionBy("lang").orderBy(F.col("u").desc())))

    triples = spark.createDataFrame([], f"{COUNTS}, l long, r long, score long")
    settled, reach, before = spark.createDataFrame([], "lang string, u long"), 2 * top, []
    while True:
        # The frontier of the languages that are not settled.
        low = cells.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("above") >= reach, F.col("u"))), F.lit(0).cast("long")).alias("u"))
        bounds = checkpoint(low.join(settled.select("lang"), "lang", "left_anti"))
        edge = by_lang(scored, bounds)
        now = spark.sparkContext.broadcast((bitmap(edge.filter("bound >= u")), bitmap(edge.filter("score >= u"))))
        grown = checkpoint(counts(rows, 3, partial(triples_of, now, tuple(before))).filter(F.col("a") >= least))
        before.append(now)
        # Both cuts; the lower score counts, at a tie the first.
        both = with_count(with_count(grown, word(1), words, "f1"), F.substring_index("phrase", " ", -2), pairs, "f23")
        both = with_count(with_count(both, F.substring_index("phrase", " ", 2), pairs, "f12"), word(3), words, "f3")
        both = both.withColumns({"s1": score("f1", "f23"), "s2": score("f12", "f3")})
        pick = lambda a, b: F.when(F.col("s1") <= F.col("s2"), F.col(a)).otherwise(F.col(b))
        best = both.select("lang", "phrase", "a", pick("f1", "f12").alias("l"), pick("f23", "f3").alias("r"), pick("s1", "s2").alias("score"))
        triples = checkpoint(triples.unionByName(best))
        # Survivors at or above each language's u.
        bounds = bounds.unionByName(settled)
        inner = F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)))
        cover = triples.select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
        shown = by_lang(scored, bounds).filter("score >= u").join(cover, ["lang", "phrase"], "left").filter("cover is null or 100 * cover < 50 * a")
        columns = ["lang", "phrase", "a", "l", "r", "score"]
        found = checkpoint(shown.select(columns).unionByName(by_lang(triples, bounds).filter("score >= u").select(columns)))
        enough = bounds.join(found.groupBy("lang").agg(F.count("*").alias("c")), "lang", "left").filter(f"u = 0 or c >= {top}")
        settled = checkpoint(enough.select("lang", "u"))
        if settled.count() == bounds.count():
            break
        reach *= 4
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return by_lang(ranked, totals).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = """
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents where text is not null),
listed as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') as w from pieces),
f1 as (select lang, x as phrase, count(*) as a from (select lang, unnest(w) as x from listed) group by all),
f2 as (select lang, x as phrase, count(*) as a
       from (select lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as x from listed) group by all having count(*) >= 10),
f3 as (select lang, x as phrase, count(*) as a
       from (select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as x from listed) group by all having count(*) >= 10),
parts as (select *, string_split(phrase, ' ') as p from (from f2 union all from f3)),
cuts as (
  select p.lang, p.phrase, p.a, k, array_to_string(p[:k], ' ') as x, array_to_string(p[k + 1:], ' ') as y
  from parts p, (values (1), (2)) t(k) where k < len(p)),
known as (from f1 union all from f2),
scored as (
  select c.lang, c.phrase, c.a, c.k, l.a as l, r.a as r, cast((1000000::hugeint * c.a * c.a) // (l.a::hugeint * r.a) as bigint) as score
  from cuts c join known l on l.lang = c.lang and l.phrase = c.x join known r on r.lang = c.lang and r.phrase = c.y),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select lang, array_to_string(p[1:2], ' ') as phrase, a from parts where len(p) = 3 union all select lang, array_to_string(p[2:3], ' '), a from parts where len(p) = 3),
cover as (select lang, phrase, max(a) as most from inside group by all),
kept as (select s.* from lowest s left join cover c using (lang, phrase) where c.most is null or 100 * c.most < 50 * s.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept),
totals as (select lang, cast(sum(a) as bigint) as n from f1 group by lang)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


@query("op11_collocations", SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
