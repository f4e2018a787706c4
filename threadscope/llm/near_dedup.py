"""Near-duplicates at a similarity of 0.8 of five-word shingles; every link is verified exactly.

SimHash alone does not reach 0.8: such pairs differ in about ten of 64 bits, with a wide spread. So candidates come from
two generators: fingerprints that link at 3 bits, as in ``simhash``, and MinHash bands (20 of 5 minima), where a pair of
similarity 0.8 shares a band with a probability of 0.9996. Equal texts are one node.

1. Every bucket (band value, or linked fingerprints) proposes its smallest member against all others; texts of proposed
   pairs are compared by their sets of shingle hashes.
2. Buckets of three and more that still hold two groups are compared inside: all pairs of members that are not yet
   linked. Of buckets with the same members one is compared. Large ones are cut into chunks, and each pair of chunks is a
   task of its own.
3. Components of the verified links. One row of each stays: the smallest id, then the smallest text hash.

Words are parted by the six ASCII blanks, A-Z in lower case; texts of fewer than five words have one shingle of all. Null
texts and texts without words are alike. A null id counts as the smallest. Rows that repeat an id with unlike texts are
rows of their own; of rows with equal id and text one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadscope.llm import simhash
from threadscope.llm.common import Powers, checkpoint, combine, fresh, join_sized, mix, prefix_hash, release, shuffle_partitions, small_batches, text_bytes, utf8
from threadscope.llm.simhash import LOWEST

SIZE, LEAST = 5, 0.8
BANDS, ROWS = 20, 5
TILE = 4 << 20  # bytes of text in a chunk of a large bucket
#: A-Z in lower case; blanks part words; the byte zero is a letter.
BYTES = np.arange(256, dtype=np.uint8)
BYTES[0] = 1
BYTES[65:91] += 32
BYTES[[9, 10, 11, 12, 13, 32]] = 0
_seeds = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
TIMES, PLUS = _seeds[::2] | np.uint64(1), _seeds[1::2]


def text_shingles(column: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the shingles of all texts, by row."""
    data, offsets = text_bytes(column)
    norm = BYTES[data]
    inside = np.concatenate([[False], norm > 0, [False]])
    edge = np.zeros(len(norm) + 1, bool)  # a word may not run on from one text into the next
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    prefix = prefix_hash(norm, powers)
    word = mix((prefix[ends] - prefix[starts]) * powers.get(len(norm) + 1)[1][starts])
    return combine(word, np.searchsorted(starts, offsets), SIZE)


def shingle_sets(column: pa.Array, powers: Powers) -> list[np.ndarray]:
    rows, hashes = text_shingles(column, powers)
    at = np.searchsorted(rows, np.arange(len(column) + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:])]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets is ``LEAST`` or more; sets without shingles are equal."""
    if min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= LEAST * (len(a) + len(b) - both) - 1e-9


def band_values(column: pa.Array, powers: Powers) -> np.ndarray:
    """One row of ``BANDS`` values a text."""
    rows, hashes = text_shingles(column, powers)
    out = np.zeros((len(column), BANDS), np.uint64)
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    if len(starts):
        for band in range(BANDS):
            value = np.full(len(starts), band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                value = mix(value ^ np.minimum.reduceat(hashes * TIMES[k] + PLUS[k], starts)) + np.uint64(1)
            out[rows[starts], band] = value
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in small_batches(batches, "text"):
        bands = band_values(batch.column("text"), powers).view(np.int64)
        prints = [simhash.fingerprint(t) for t in batch.column("text").to_pylist()]
        arrays = [batch.column("node"), batch.column("doc"), pa.array(prints, pa.int64()), pa.array(bands.tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["node", "doc", "fp", "bands"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        for one in small_batches(small_batches(iter([batch]), "text_a"), "text_b"):
            pairs = zip(*(shingle_sets(one.column(c), powers) for c in ("text_a", "text_b")))
            near = pa.array([similar(a, b) for a, b in pairs], pa.bool_())
            yield one.filter(near).select(["a", "b"])


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows of one tile, which follow one another; a tile may go on in the next batch."""
    powers, held, key = Powers(), [], None

    def links() -> pa.RecordBatch:
        parent, out = {}, []

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        held.sort(key=lambda r: len(r[3]))
        for i, (node, label, side, own) in enumerate(held):
            for other, label_b, side_b, theirs in held[i + 1:]:
                if len(own) < LEAST * len(theirs):
                    break  # by length: all after it are longer still
                if side >= 0 and side == side_b:
                    continue  # met in the tile of their own chunk
                x, y = root(label), root(label_b)
                if x != y and similar(own, theirs):
                    parent[x] = y
                    out.append((node, other))
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.binary()) for i in (0, 1)], ["a", "b"])

    for batch in small_batches(batches, "text"):
        sets = shingle_sets(batch.column("text"), powers)
        for row, own in zip(batch.drop_columns(["text"]).to_pylist(), sets):
            if key is not None and (row["bucket"], row["tile"]) != key:
                yield links()
                held.clear()
            key = (row["bucket"], row["tile"])
            held.append((row["node"], row["label"], row["side"], own))
    if held:
        yield links()


def rows_of(docs: DataFrame) -> tuple[Column, Column]:
    """Id and text hash of each row."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LOWEST)), F.unhex(F.md5(utf8(docs["text"])))


def _labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, rep, label): the smallest (rep, node) of each node's component."""
    own = nodes.select("node", "rep", F.struct("rep", "node").alias("own"))
    found = simhash.least_labels(edges, own.select("node", F.col("own").alias("label")))
    return own.join(found, "node", "left").select("node", "rep", F.coalesce("label", "own").alias("label"))


def survivors(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """(doc, node): id and text hash of the row of each group that stays."""
    doc, node = rows_of(docs)
    rows = docs.select(doc.alias("doc"), node.alias("node"), utf8(docs["text"]).alias("text"))
    sketches = rows.select("node", "doc", "text").mapInArrow(_sketch, "node binary, doc long, fp long, bands array<long>")
    nodes = checkpoint(sketches.groupBy("node").agg(F.min("doc").alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))

    # Candidates of both generators: each bucket's smallest member against all others.
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("center")).filter("n > 1")
    banded = checkpoint(join_sized(members, checkpoint(sizes.withColumn("size", F.col("n"))), "bucket", "n"))
    prints = checkpoint(nodes.groupBy("fp").agg(F.count("*").alias("n"), F.min("node").alias("center")))
    fps = prints.select("fp", "center")
    linked = simhash.links(prints.select("fp"), simhash.make_plan(prints, 3), 3)
    between = linked.join(fps.toDF("a", "x"), "a").join(fps.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    equal = join_sized(nodes.select("fp", "node"), prints, "fp", "n").select(F.col("center").alias("a"), F.col("node").alias("b"))
    pairs = banded.select(F.col("center").alias("a"), F.col("node").alias("b")).union(equal).union(between)
    pairs = checkpoint(pairs.filter("a <> b").distinct())
    release(docs.sparkSession)

    # Texts of nodes in buckets, by id and hash: copies of one text are spread over their ids.
    touched = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep"), "node")
    texts = rows.join(touched.select("node", F.col("rep").alias("doc")), ["doc", "node"], "left_semi").dropDuplicates(["doc", "node"])
    texts = checkpoint(texts.select("node", "text"))

    def side(left: DataFrame, name: str) -> DataFrame:
        counts = pairs.groupBy(name).agg(F.count("*").alias("n"))
        known = counts.join(texts.toDF(name, f"text_{name}"), name)
        return join_sized(left, known, name, "n")

    first = checkpoint(side(side(pairs, "a"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a binary, b binary"))

    release(docs.sparkSession)

    # Buckets of three and more in which groups are left that did not meet.
    labels = checkpoint(_labels(nodes, first))
    group = F.unhex(F.md5(F.concat(F.col("label.rep").cast("string"), F.lit("/"), F.hex("label.node")))).alias("label")
    open_members = banded.filter("size > 2").join(labels.select("node", group), "node")
    left = open_members.groupBy("bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor"))
    left = checkpoint(left.filter("low <> high").dropDuplicates(["n", "sum", "xor"]).select("bucket", "n"))
    inner = checkpoint(join_sized(open_members.select("node", "label", "bucket"), left, "bucket", "n").join(texts, "node"))
    weight = inner.groupBy("bucket").agg(F.count("*").alias("n"), F.ceil(F.sum(F.octet_length("text")) / tile).cast("int").alias("k"))
    chunked = join_sized(inner, checkpoint(weight.withColumn("k", F.greatest("k", F.lit(1)))), "bucket", "n")
    chunked = chunked.withColumn("c", F.pmod(F.xxhash64("node"), "k").cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    tiles = chunked.select("node", "label", "text", "bucket", (F.least("c", "d").cast("long") * F.lit(1 << 24) + F.greatest("c", "d")).alias("tile"),
                           F.when(F.col("c") == F.col("d"), F.lit(-1)).otherwise((F.col("c") > F.col("d")).cast("int")).alias("side"))
    dealt = tiles.repartition(shuffle_partitions(docs.sparkSession), "bucket", "tile").sortWithinPartitions("bucket", "tile")
    second = checkpoint(dealt.mapInArrow(_inside, "a binary, b binary"))
    release(docs.sparkSession)
    return _labels(nodes, first.union(second)).groupBy("label").count().select(F.col("label.rep").alias("doc"), F.col("label.node").alias("node"))


def one_of_each(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """One row of each group, all columns."""
    doc, node = fresh(docs, "near_doc", "near_node")
    ids, hashes = rows_of(docs)
    kept = survivors(docs, tile).toDF(doc, node)
    return docs.withColumns({doc: ids, node: hashes}).join(kept, [doc, node], "left_semi").dropDuplicates([doc, node]).select(*docs.columns)
