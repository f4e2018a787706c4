"""Lines that many documents share stay in one document only.

Every line long enough becomes a 128-bit hash. The hashes are range-partitioned together with document and position, so
a line that a third of all documents hold is spread over as many partitions as its rows need, and each partition is
sorted and streamed. What a run of one hash has in the partitions before and after (its number of documents, capped at
the threshold, and its first document) is a few numbers per partition; these are the only rows the driver sees. The
result is one compressed keep bitmap per changed document; texts are touched once, when the bitmaps are applied.

Null or empty texts are one empty line. A null ``doc_id`` counts as the smallest id; rows that repeat a ``doc_id`` are
the same document. Ties cannot arise: the order is hash, document, position. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.llm.common import checkpoint, fresh, query, shuffle_partitions, small_batches, table, utf8

BLANKS = " \t\n\x0b\x0c\r"
LOWEST = -(1 << 63)
KEYS = ["h1", "h2", "doc", "tkey", "pos"]


def line_key(line: str) -> bytes:
    return line.strip(BLANKS).encode().lower()  # bytes.lower() changes A-Z only


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            digests, docs, tkeys, places = [], [], [], []
            for doc, tkey, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "tkey", "text"))):
                for pos, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars and len(bare := line.strip(BLANKS)) >= min_chars:
                        digests.append(hashlib.blake2b(bare.encode().lower(), digest_size=16).digest())
                        docs.append(doc)
                        tkeys.append(tkey)
                        places.append(pos)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs, pa.int64()), pa.array(tkeys, pa.int64()),
                 pa.array(places, pa.int32())], KEYS)

    return run


@dataclass
class Run:
    """A run of one hash as far as it is known: distinct documents, its first (kept) and its last one."""

    key: tuple[int, int]
    docs: int
    keeper: int
    last: int


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in KEYS]


def _runs(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of runs, run of each row, distinct documents of each run."""
    h1, h2, doc = cols[:3]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    run = np.cumsum(new) - 1
    fresh_doc = new.copy()
    fresh_doc[1:] |= doc[1:] != doc[:-1]
    return np.flatnonzero(new), run, np.bincount(run[fresh_doc])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last run of a partition."""
    from pyspark import TaskContext

    first: Run | None = None
    last: Run | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = _columns(batch)
        starts, _, docs = _runs(cols)
        ends = np.append(starts[1:], len(cols[0])) - 1
        for i in {0, len(starts) - 1}:
            at = Run((int(cols[0][starts[i]]), int(cols[1][starts[i]])), int(docs[i]), int(cols[2][starts[i]]), int(cols[2][ends[i]]))
            if i == 0 and last is not None and last.key == at.key:
                last.docs += at.docs - (last.last == at.keeper)
                last.last = at.last
            else:
                last = at
            if first is None:
                first = last
    if first is not None:
        rows = [(TaskContext.get().partitionId(), i, *r.key, r.docs, r.keeper, r.last) for i, r in ((0, first), (1, last))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["part", "side", *KEYS[:2], "docs", "keeper", "final"])


def _joined(edges: list, least: int) -> dict[int, tuple[Run | None, int]]:
    """Per partition: the run that earlier partitions began with its first hash, and how many documents follow its last hash."""
    parts: dict[int, list] = {}
    for e in sorted(edges):
        parts.setdefault(e[0], []).append(Run((e[2], e[3]), e[4], e[5], e[6]))
    known, open_run = {}, None
    for part, (first, last) in parts.items():
        before = open_run if open_run is not None and open_run.key == first.key else None
        known[part] = [Run(before.key, min(before.docs, least), before.keeper, before.last) if before else None, 0]
        if first.key == last.key and before:
            open_run = Run(last.key, before.docs + last.docs - (before.last == last.keeper), before.keeper, last.last)
        else:
            open_run = last
    following, order = None, list(parts)
    for part in reversed(order):
        first, last = parts[part]
        if following is not None and following.key == last.key:
            known[part][1] = min(least, following.docs - (following.keeper == last.last))
        if first.key == last.key and following is not None and following.key == last.key:
            following = Run(first.key, first.docs + following.docs - (following.keeper == last.last), first.keeper, last.last)
        else:
            following = first
    return {p: (a, b) for p, (a, b) in known.items()}


def _dropped(known: dict[int, tuple[Run | None, int]], least: int):
    """Lines that go: all of a run of at least ``least`` documents, except those of its first document."""

    def judge(cols, state: Run | None, after: int, final: bool):
        starts, run, docs = _runs(cols)
        keeper = cols[2][starts].copy()
        docs = docs.copy()
        if state is not None and (int(cols[0][0]), int(cols[1][0])) == state.key:
            docs[0] += state.docs - (state.last == int(cols[2][0]))
            keeper[0] = state.keeper
        else:
            state = None
        carry, cut = None, len(cols[0])
        if final:
            docs[-1] += after
        elif docs[-1] < least:  # later rows of this run may still raise its count
            cut = int(starts[-1])
            carry = [c[cut:] for c in cols]
            state = state if len(starts) == 1 else None
        else:
            state = Run((int(cols[0][-1]), int(cols[1][-1])), least, int(keeper[-1]), int(cols[2][-1]))
        gone = (docs[run] >= least) & (cols[2] != keeper[run])
        gone[cut:] = False
        out = pa.RecordBatch.from_arrays([pa.array(c[gone]) for c in cols[2:]], KEYS[2:])
        return out, carry, state

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state, after = known.get(TaskContext.get().partitionId(), (None, 0))
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = _columns(batch)
            if carry is not None:
                cols = [np.concatenate(pair) for pair in zip(carry, cols)]
            out, carry, state = judge(cols, state, after, False)
            yield out
        if carry is not None:
            yield judge(carry, state, after, True)[0]

    return go


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for places in batch.column("places").to_pylist():
            keep = np.ones(max(places) // 8 * 8 + 8, np.uint8)
            keep[places] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("tkey"), pa.array(maps, pa.binary())], ["doc", "tkey", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, tkey, keep) of every document that loses lines.

    ``keep`` is a zlib-compressed bit string, most significant bit first, one bit per line (1: it stays); lines
    beyond its end stay. ``doc`` is the id, ``tkey`` the xxhash64 of the text, which tells repeated ids apart.
    """
    n = shuffle_partitions(docs.sparkSession)
    lines = _keyed(docs).mapInArrow(_line_hashes(min_chars), "h1 long, h2 long, doc long, tkey long, pos int")
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("tkey"), F.col("pos")]
    ordered = checkpoint(lines.repartitionByRange(n, *order).sortWithinPartitions(*order))
    edges = ordered.mapInArrow(_edges, "part long, side long, h1 long, h2 long, docs long, keeper long, final long").collect()
    known = _joined([tuple(e) for e in edges], min_docs)
    gone = ordered.mapInArrow(_dropped(known, min_docs), "doc long, tkey long, pos int")
    places = gone.groupBy("doc", "tkey").agg(F.collect_set("pos").alias("places"))
    return places.mapInArrow(_pack, "doc long, tkey long, keep binary")


def _keyed(docs: DataFrame) -> DataFrame:
    text = utf8(docs["text"])
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LOWEST)).alias("doc"), F.xxhash64(text).alias("tkey"), text.alias("text"))


def kept_lines(lines: list[str], keep: bytes | None) -> list[str]:
    """Apply one bitmap."""
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:len(lines)]
    return [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, str]:
    """The documents with their bitmap (null: all lines stay) in a column of a new name."""
    doc, tkey, keep = fresh(docs, "doc", "tkey", "keep")
    right = bitmaps.select(F.col("doc").alias(doc), F.col("tkey").alias(tkey), F.col("keep").alias(keep))
    left = docs.withColumns({doc: F.coalesce(docs["doc_id"].cast("long"), F.lit(LOWEST)), tkey: F.xxhash64(utf8(docs["text"]))})
    return left.join(right.hint("shuffle_hash"), [doc, tkey], "left").drop(doc, tkey), keep


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The documents, all columns, with shared lines taken out of ``text``; other texts stay as they are, nulls too."""
    joined, keep = with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if k is None else "\n".join(kept_lines(t.split("\n"), k))
                     for t, k in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names[:-1])

    return joined.select(*docs.columns, keep).mapInArrow(cut, docs.schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        total, dropped, digest = [], [], []
        for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist()):
            lines = text.split("\n")
            kept = kept_lines(lines, keep)
            total.append(len(lines))
            dropped.append(len(lines) - len(kept))
            digest.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digest)],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
shared as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
judged as (
  select k.doc_id, k.pos, k.line, s.key is not null and k.doc_id <> s.keeper as gone
  from keyed k left join shared s on k.key = s.key)
select doc_id, count(*) as n_lines, cast(sum(cast(gone as int)) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""


@query("op4_line_dedup", SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined, keep = with_bitmaps(docs, keep_bitmaps(docs))
    rows = joined.select("doc_id", utf8(F.col("text")).alias("text"), F.col(keep).alias("keep"))
    return rows.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
