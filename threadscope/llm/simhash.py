"""SimHash near-duplicates by the generalised pigeonhole principle.

Every text becomes a 64-bit fingerprint of its word shingles. Equal fingerprints are one node with the smallest id, so
copies cost one row per task. Bits that vary together are grouped into the same partition. If two fingerprints differ
in at most ``radius`` bits and the partitions' thresholds sum up to radius - parts + 1, then in at least one partition
they differ by no more than that partition's own threshold. Dynamic programming picks number of partitions and
thresholds with the fewest estimated candidates and probes; the estimates come from the value counts of all
fingerprints. Each fingerprint is indexed under its value in every partition in use and probes the values within the
threshold; candidates are verified on all 64 bits.

A bucket gives back a spanning forest of its links, never all pairs: components need no more. Buckets beyond ``tile``
fingerprints are cut into chunks, and each pair of chunks is a task of its own, so no link is lost and no group lands in
one task. Components follow from least-label rounds with pointer jumping; each round is a checkpoint.

Null or empty texts have fingerprint zero. A null id counts as the smallest and stays null. Rows that repeat an id are
rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.llm.common import checkpoint, fresh, join_counted, query, release, shuffle_partitions, table, utf8

LOWEST = -(1 << 63)


def shingles(text: str, size: int) -> list[bytes]:
    words = text.encode().lower().split()  # on bytes: A-Z only, and the six ASCII blanks
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    return [flat[starts[i]:ends[i + size - 1] - 1] for i in range(len(words) - size + 1)]


def fingerprint(text: str, size: int = 3) -> int:
    parts = shingles(text, size)
    if not parts:
        return 0
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in parts), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashed), 4096):
        bits = np.unpackbits(hashed[i:i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashed), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc, fp) of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(fps, pa.int64())], ["doc", "fp"])

    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LOWEST)).alias("doc"), utf8(docs["text"]).alias("text"))
    return rows.mapInArrow(run, "doc long, fp long")


# --- plan: partitions of bits and their thresholds ------------------------------------------------------------------
def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits how many have both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            both += (bits.T @ bits).astype(np.int64)
            n += len(fps)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(both.ravel(), n))], ["cell", "n"])

    cells = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097, np.int64)  # 4,097 cells, whatever the input
    for c in cells:
        flat[c["cell"]] = c["n"]
    return int(flat[-1]), flat[:-1].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal width; each takes next the bit most correlated with those it has."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    linked = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(linked, 0)
    left, groups = list(range(64)), []
    for i in range(parts):
        width = 64 // parts + (i < 64 % parts)
        pick = max(left, key=lambda b: (linked[b, left].sum(), -b))
        group = [pick]
        left.remove(pick)
        while len(group) < width:
            pick = max(left, key=lambda b: (linked[b, group].sum(), -b))
            group.append(pick)
            left.remove(pick)
        groups.append(sorted(group))
    return groups


def ball(width: int, radius: int) -> int:
    total, term = 0, 1
    for k in range(radius + 1):
        total += term
        term = term * (width - k) // (k + 1)
    return total


def masks(group: list[int], radius: int) -> list[int]:
    """All sets of at most ``radius`` bits of the group."""
    return [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(group, k)]


def allocate(n: int, same: list[int], widths: list[int], radius: int, probe: float = 1.0) -> tuple[float, list[int]]:
    """Thresholds (-1: partition unused) that sum up to radius - parts + 1 at the least estimated cost.

    ``same`` counts the pairs that agree in a partition; within threshold t about ``ball(width, t)`` times as many meet.
    Of plans that cost the same the one with the fewest probes wins, so that a table without pairs gets a small plan.
    """
    budget = radius - len(widths) + 1
    best: dict[int, tuple[float, int, list[int]]] = {0: (0.0, 0, [])}
    for pairs, width in zip(same, widths):
        step: dict[int, tuple[float, int, list[int]]] = {}
        for used, (cost, probes, picks) in best.items():
            for t in range(-1, radius + 1):
                values = 0 if t < 0 else ball(width, t)
                now = (cost + values * (pairs + probe * n), probes + values, [*picks, t])
                if used + t not in step or now[:2] < step[used + t][:2]:
                    step[used + t] = now
        best = step
    cost, _, picks = best[budget]
    return cost, picks


def part_value(fp, group: list[int]):
    """The bits of one partition, in place; equal values agree in the partition."""
    mask = sum(1 << b for b in group)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def make_plan(nodes: DataFrame, radius: int, parts_options=(2, 3, 4)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions in use; none where there are no two fingerprints to link."""
    n, both = bit_counts(nodes)
    if n < 2:
        return []
    plans = {m: group_bits(n, both, m) for m in parts_options if m <= radius + 1}
    values = F.explode(F.array(*[F.struct(F.lit(m * 8 + i).alias("k"), part_value(F.col("fp"), g).alias("v")) for m, gs in plans.items() for i, g in enumerate(gs)]))
    counted = nodes.select(values.alias("x")).groupBy("x.k", "x.v").agg(F.count("*").alias("c"))
    same = {r["k"]: int(r["pairs"] or 0) for r in counted.groupBy("k").agg(F.sum((F.col("c") * (F.col("c") - 1) / 2).cast("long")).alias("pairs")).collect()}
    costs = []
    for m, groups in plans.items():
        cost, picks = allocate(n, [same.get(m * 8 + i, 0) for i in range(m)], [len(g) for g in groups], radius)
        costs.append((cost, m, [(g, t) for g, t in zip(groups, picks) if t >= 0]))
    return min(costs, key=lambda c: c[:2])[2]


# --- probe and verify -----------------------------------------------------------------------------------------------
def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def forest(fps: np.ndarray, ids: np.ndarray, pairs_of, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``pairs_of()``, which yields candidate row pairs."""
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a_out, b_out = [], []
    for a, b in pairs_of():
        near = popcount(fps[a] ^ fps[b]) <= radius
        a, b = a[near], b[near]
        unlike = parent[a] != parent[b]
        for i, j in zip(a[unlike].tolist(), b[unlike].tolist()):
            ri, rj = root(i), root(j)
            if ri != rj:
                parent[max(ri, rj)] = min(ri, rj)
                a_out.append(i)
                b_out.append(j)
    return fps[np.array(a_out, int)], fps[np.array(b_out, int)]


def bucket_pairs(starts: np.ndarray, ends: np.ndarray, side: np.ndarray):
    """Row pairs of a batch of buckets, by distance d within the bucket. ``side``: -1 indexed, 0 or 1 chunk of a tile, 2 probe."""
    end_of = np.repeat(ends, ends - starts)
    at, d = np.arange(len(end_of)), 1
    while len(at):
        at = at[at + d < end_of[at]]
        a, b = side[at], side[at + d]
        # an indexed row meets all rows; a probe meets indexed rows only; chunks of a tile meet each other
        use = ((a == -1) | (b == -1)) | ((a != b) & (a < 2) & (b < 2))
        yield at[use], at[use] + d
        d += 1


def link_buckets(radius: int):
    """Links in rows sorted by bucket key; a bucket that may go on is carried into the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None

        def links(key, fp, side):
            new = np.ones(len(fp), bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            starts = np.flatnonzero(new)
            a, b = forest(fp, fp, lambda: bucket_pairs(starts, np.append(starts[1:], len(fp)), side), radius)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("part", "value", "tile", "fp", "side")]
            cols = [c.astype(np.int64) for c in cols] if carry is None else [np.concatenate([x, y.astype(np.int64)]) for x, y in zip(carry, cols)]
            key = np.array(cols[:3])
            cut = np.flatnonzero((key != key[:, -1:]).any(axis=0))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            carry = [c[cut:] for c in cols]
            if cut:
                yield links(key[:, :cut], cols[3][:cut], cols[4][:cut])
        if carry is not None:
            yield links(np.array(carry[:3]), carry[3], carry[4])

    return run


def links(nodes: DataFrame, plan: list[tuple[list[int], int]], radius: int, tile: int = 2000) -> DataFrame:
    """(a, b): spanning forests of all pairs of fingerprints within ``radius``."""
    if not plan:
        return nodes.sparkSession.createDataFrame([], "a long, b long")
    rows = []
    for i, (group, t) in enumerate(plan):
        for mask in masks(group, t):
            signed = mask - (1 << 64) if mask >> 63 else mask
            value = part_value(F.col("fp"), group).bitwiseXOR(F.lit(signed))
            rows.append(F.struct(F.lit(i).alias("part"), value.alias("value"), F.lit(2 if mask else -1).alias("side")))
    probes = nodes.select("fp", F.explode(F.array(*rows)).alias("x")).select("fp", "x.part", "x.value", "x.side")
    sizes = probes.groupBy("part", "value").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    sized = probes.join(sizes, ["part", "value"])  # buckets of one row go
    chunks = F.ceil(F.col("size") / tile).cast("int")
    small = sized.filter(F.col("size") <= tile).select("part", "value", F.lit(-1).cast("long").alias("tile"), "fp", "side")
    # Chunk c of k meets every chunk d: tile (min, max). Within a tile rows of either chunk are told apart by their side.
    large = sized.filter(F.col("size") > tile).withColumns({"k": chunks, "c": F.pmod(F.xxhash64("fp"), chunks).cast("int")})
    large = large.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    low, high = F.least("c", "d"), F.greatest("c", "d")
    # In a tile of a chunk with itself, and for indexed rows against probes, all rows meet as indexed rows do.
    large = large.select("part", "value", (low.cast("long") * F.lit(1 << 24) + high).alias("tile"), "fp",
                         F.when(F.col("c") == F.col("d"), F.lit(-1)).otherwise((F.col("c") > F.col("d")).cast("int")).alias("side"))
    keys = ["part", "value", "tile"]
    both = small.unionByName(large).repartition(shuffle_partitions(nodes.sparkSession), *keys).sortWithinPartitions(*keys)
    return both.mapInArrow(link_buckets(radius), "a long, b long").distinct()


def least_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the smallest label in each node's component. ``edges`` (a, b), ``labels`` (node, label), one row a node.

    No two nodes may have the same label: pointer jumping finds a node by its label.
    """
    spark = edges.sparkSession
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct().repartition(shuffle_partitions(spark), "b"))  # dealt once for all rounds
    first = labels.join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    now = checkpoint(first.withColumn("owner", F.col("label")))
    while True:
        around = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        hooked = now.join(around, "node").select("node", "owner", F.least("label", "seen").alias("label"), F.col("label").alias("old"))
        hooked = checkpoint(hooked)
        # Pointer jumping: a label is the first label of some node; that node may know a smaller one by now.
        jump = hooked.select(F.col("owner").alias("label"), F.col("label").alias("next"))
        then = checkpoint(hooked.join(jump, "label", "left").select("node", "owner", F.coalesce(F.least("label", "next"), "label").alias("label"), "old"))
        if not then.filter(F.col("label") < F.col("old")).limit(1).count():
            return then.select("node", "label")
        now = then.drop("old")
        del hooked, jump, around
        release(spark)


def components(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, component, rows) of every distinct fingerprint of ``prints`` (doc, fp).

    Labels are pairs of smallest id and fingerprint, as unlike texts may repeat an id; the id alone is given back.
    """
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("doc").alias("rep"), F.count("*").alias("rows")))
    edges = checkpoint(links(nodes, make_plan(nodes, radius), radius))
    labels = nodes.select(F.col("fp").alias("node"), F.struct("rep", "fp").alias("label"))
    found = least_labels(edges, labels)
    joined = nodes.join(found.select(F.col("node").alias("fp"), F.col("label.rep").alias("label")), "fp", "left")
    return joined.select("fp", F.coalesce("label", "rep").alias("component"), "rows")


def near_groups(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """(doc, fp, component) of every row of ``docs``."""
    prints = checkpoint(fingerprints(docs, size))
    found = checkpoint(components(prints, radius))
    return join_counted(prints, found, "fp", "rows")


def one_of_each(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """The documents, all columns, with the smallest id of their group; of rows that repeat it, one, even of unlike texts.

    Only for tables in which an id stands for one text; ``near_dedup`` keeps a row of every group whatever the ids.
    """
    doc, rank = fresh(docs, "doc", "rank")
    kept = near_groups(docs, radius, size).filter(F.col("doc") == F.col("component")).select(F.col("doc").alias(doc)).distinct()
    rows = docs.withColumn(doc, F.coalesce(docs["doc_id"].cast("long"), F.lit(LOWEST))).join(kept, doc, "left_semi")
    return rows.dropDuplicates([doc]).select(*docs.columns)


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return found.select(back("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), back("component").alias("component_id"))
