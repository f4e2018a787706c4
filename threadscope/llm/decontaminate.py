"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles n (sizes that double). The sketch of an item is its shingles with the
smallest hashes: a document with at least t * n of the n shingles misses at most n - ceil(t * n) of them, so one more
hash than that is enough for the sketch and the document to have one in common. A partition's sketches have the length
its largest item needs. Every text is searched whole, however long, for sketch hashes (a bit table first, then a sorted
lookup); a hit names the item, and the item counts only if the document holds at least t of its shingles word by word.

The item table is read in slices of at most ``slice_bytes`` of text, one scan of the documents each, so what a task holds
is bounded whatever the benchmark's size. A text or item of fewer words than a shingle is one shingle of all its
words, so a short item is found in texts of just these words. Items
or texts without words (null, empty, punctuation) match nothing. Items with equal ids stay rows of their own and are
reported once, at their best containment; rows that repeat a document are reported once each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.llm.common import Powers, query, shingle_hashes, small_batches, table, text_bytes, utf8, words_of

WORDS, LEAST = 5, 0.8
FILTER_BITS = 22
SLICE = 1 << 20


@dataclass
class Sketches:
    """Sorted sketch hashes with the item each stands for, and the items' shingles."""

    hashes: np.ndarray
    items: np.ndarray
    ids: list
    shingles: list[set[bytes]]


def word_shingles(text: str | None, size: int = WORDS) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i:i + size]) for i in range(max(len(words) - size, 0) + 1)} if words else set()


def needed(n: int, least: float) -> int:
    """Shingles that make up a share of ``least`` of n."""
    return max(1, int(np.ceil(least * n - 1e-9)))


def size_class(n: int) -> int:
    return int(n).bit_length()


def sketch(items: list[tuple], size: int = WORDS, least: float = LEAST) -> Sketches:
    """Of (id, text) rows."""
    hashes, owner, ids, sets = [], [], [], []
    powers = Powers()
    per_item = []
    for item_id, text in items:
        shingles = word_shingles(text, size)
        if shingles:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            _, h = shingle_hashes(raw, np.array([0, len(raw)]), size, powers)
            per_item.append((len(ids), np.unique(h)))
            ids.append(item_id)
            sets.append(shingles)
    largest: dict[int, int] = {}
    for _, h in per_item:
        largest[size_class(len(h))] = max(largest.get(size_class(len(h)), 0), len(h))
    for k, h in per_item:
        n = largest[size_class(len(h))]
        # np.unique sorted the hashes, which are random: the first ones are the minima
        probes = h[:n - needed(n, least) + 1]
        hashes.append(probes)
        owner.append(np.full(len(probes), k))
    if not ids:
        return Sketches(np.zeros(0, np.uint64), np.zeros(0, np.int64), [], [])
    flat, own = np.concatenate(hashes), np.concatenate(owner)
    order = np.argsort(flat, kind="stable")
    return Sketches(flat[order], own[order], ids, sets)


def candidates(data: np.ndarray, offsets: np.ndarray, found: Sketches, table: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """Distinct (row, item) with a sketch hash in common, as row * items + item, sorted."""
    rows, hashes = shingle_hashes(data, offsets, size, powers)
    slot = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    some = table[slot]
    rows, hashes = rows[some], hashes[some]
    low, high = np.searchsorted(found.hashes, hashes, "left"), np.searchsorted(found.hashes, hashes, "right")
    count = high - low
    at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.unique(np.repeat(rows, count) * len(found.ids) + found.items[at])


def slices(items: DataFrame, slice_bytes: int) -> Iterator[list[tuple]]:
    """All (item_id, text) rows, a bounded number of bytes at a time."""
    rows, held = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        rows.append((row[0], row[1]))
        held += len(row[1] or "")
        if held >= slice_bytes:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def contained(docs: DataFrame, items: DataFrame, least: float = LEAST, size: int = WORDS, slice_bytes: int = SLICE,
              key: str = "doc_id") -> DataFrame:
    """(doc, item, n_shingles, n_shared, containment) of every document and item at ``least`` containment or more."""
    rows = docs.select(docs[key].alias("doc"), utf8(docs["text"]).alias("text"))
    doc, item = docs.schema[key].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc {doc}, item {item}, n_shingles int, n_shared int, containment double"
    item_type = pa.int64() if item == "bigint" else pa.int32() if item == "int" else pa.string()
    found = [rows.mapInArrow(_search(sketch(part, size, least), least, size, item_type), schema) for part in slices(items, slice_bytes)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _search(found: Sketches, least: float, size: int, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[(found.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        for batch in small_batches(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            at, items, total, shared = [], [], [], []
            last, have = -1, set()
            for pair in candidates(data, offsets, found, bits, size, powers).tolist():
                row, item = divmod(pair, len(found.ids))
                if row != last:
                    last, have = row, word_shingles(batch.column("text")[row].as_py(), size)
                n, common = len(found.shingles[item]), len(found.shingles[item] & have)
                if common >= needed(n, least):
                    at.append(row)
                    items.append(found.ids[item])
                    total.append(n)
                    shared.append(common)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(at, pa.int64())), pa.array(items, item_type), pa.array(total, pa.int32()),
                 pa.array(shared, pa.int32()), pa.array([s / n for s, n in zip(shared, total)], pa.float64())],
                ["doc", "item", "n_shingles", "n_shared", "containment"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST, key: str = "doc_id") -> DataFrame:
    """One row per document and item."""
    return contained(docs, items, least, key=key).groupBy("doc", "item").agg(
        F.max(F.struct("containment", "n_shingles", "n_shared")).alias("best")).select("doc", "item", "best.*")


def without_items(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents, all columns, that hold no item."""
    at = docs.columns.index("text")
    kept = docs
    for part in slices(items, SLICE):
        kept = kept.mapInArrow(_filter(sketch(part, WORDS, least), least, at), docs.schema)
    return kept


def _filter(found: Sketches, least: float, at: int):
    ids = Sketches(found.hashes, found.items, list(range(len(found.ids))), found.shingles)
    search = _search(ids, least, WORDS, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at).fill_null("")
            own = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), text], ["doc", "text"])
            hit = np.zeros(batch.num_rows, bool)
            for out in search(iter([own])):
                hit[out.column("doc").to_numpy()] = True
            yield batch.filter(pa.array(~hit))

    return run


@query("op1_decontaminate")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_shared", F.round("containment", 6).alias("containment"))
