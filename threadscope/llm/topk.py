"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are packed into blocks where they are read. Every component of a block is a sorted list; a query reads it from
the end where its products are largest. All lists are read to the same depth, in rounds that halve what is unread. What a
list has shown so far gives each row a lower bound (unread products are at least the list's last) and an upper bound (at
most the one just read). A round ends with the k-th best lower bound of each query; rows whose upper bound is below it
can no longer qualify. When few rows are left, or all lists are read, the final scores of those rows are resolved.
Bounds of all queries of a batch are sums of products with 0/1 masks of what is read, so they are matrix products.

Query blocks are repeated for every candidate block and sent to its task, where they follow it; a task holds one block of
each at a time. No candidate is repeated, and only the numbers of the blocks are broadcast: Spark would judge repeated
queries by what they were before, and broadcast them. Each pair gives back at most k rows a query. Scores are integers and exact: above 2^53 Python's integers take over, and a
score beyond 64 bits is an error.

Vectors that are null, hold null or non-finite components, or have no id take no part. Vectors of unlike length are filled
up with zeros. Rows that repeat an id are candidates each; as a query an id counts once, with its smallest vector, and rows of its own id
are not its candidates. Ties go to
the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadscope.llm.common import checkpoint, query, table

BLOCK, BATCH = 8192, 256
ROUNDS = (1 / 2, 3 / 4, 7 / 8, 15 / 16, 31 / 32, 1.0)


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, x) of the vectors that take part; x are the components times 256, rounded down."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.col(key).isNotNull() & F.col(column).isNotNull() & finite)
    return rows.select(F.col(key).cast("long").alias("id"), F.transform(column, lambda x: F.floor(x.cast("double") * 256)).alias("x"))


def _packer(size: int):
    """Rows to blocks of at most ``size``: the partition and its pieces, ids, width and components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, rows = [], []

        def block():
            width = max((len(r) for r in rows), default=0)
            x = np.zeros((len(rows), width), np.int64)
            for i, r in enumerate(rows):
                x[i, :len(r)] = r
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([number], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                 pa.array([width], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "piece", "ids", "width", "x"])

        for batch in batches:
            for i, x in zip(batch.column("id").to_pylist(), batch.column("x")):
                ids.append(i)
                rows.append(x.values.to_numpy(zero_copy_only=False))
                if len(ids) == size:
                    yield block()
                    number, ids, rows = number + 1, [], []
        if ids:
            yield block()

    return run


SCHEMA = "block long, piece int, ids binary, width int, x binary"


def unpack(ids: bytes, width: int, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    got = np.frombuffer(ids, np.int64)
    return got, np.frombuffer(x, np.int64).reshape(len(got), width)


class Lists:
    """The sorted lists of one block of candidates."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, width: int) -> None:
        order = np.argsort(ids, kind="stable")  # ties to smaller ids
        self.ids, self.exact = ids[order], np.zeros((len(ids), width), np.int64)
        self.exact[:, :x.shape[1]] = x[order]
        self.x = self.exact.astype(np.float64)
        by_value = np.argsort(self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, by_value, axis=0)
        self.rank = np.empty_like(by_value)
        np.put_along_axis(self.rank, by_value, np.arange(len(ids))[:, None], axis=0)


def bounds(lists: Lists, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores after ``depth`` entries of each list."""
    n = len(lists.ids)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    low = np.zeros((len(q), n))
    high = np.zeros((len(q), n))
    for part, seen, edge, last in (
        (up, lists.rank >= n - depth, lists.sorted[n - depth], lists.sorted[0]),
        (down, lists.rank < depth, lists.sorted[depth - 1], lists.sorted[-1]),
    ):
        # A component that is read counts as it is; an unread one lies between the list's end and the entry just read.
        low += part @ np.where(seen, lists.x, last).T
        high += part @ np.where(seen, lists.x, edge).T
    return low, high


def top_of_block(lists: Lists, query_ids: np.ndarray, queries: np.ndarray, k: int, few: int = 64) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best rows of one block for every query."""
    n, out = len(lists.ids), []
    biggest = float(np.abs(lists.x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, lists.x.shape[1])
    open_rows = np.arange(len(query_ids))

    def resolve(row: int, rows: np.ndarray) -> None:
        rows = rows[lists.ids[rows] != query_ids[row]]
        if biggest < 2**53:
            scores = (lists.x[rows] @ queries[row].astype(np.float64)).astype(np.int64)
            best = np.lexsort((lists.ids[rows], -scores))[:k]
            out.extend(zip([int(query_ids[row])] * len(best), lists.ids[rows][best].tolist(), scores[best].tolist()))
        else:
            scores = [sum(a * b for a, b in zip(x, queries[row].tolist())) for x in lists.exact[rows].tolist()]
            best = sorted(range(len(rows)), key=lambda i: (-scores[i], lists.ids[rows[i]]))[:k]
            out.extend((int(query_ids[row]), int(lists.ids[rows[i]]), scores[i]) for i in best)

    if biggest >= 2**53 or n <= max(few, k + 1):
        for row in open_rows:
            resolve(row, np.arange(n))
        return out
    for share in ROUNDS:
        depth = max(1, int(np.ceil(n * share)))
        low, high = bounds(lists, queries[open_rows].astype(np.float64), depth)
        own = lists.ids[None, :] == query_ids[open_rows][:, None]
        low[own] = -np.inf
        least = np.partition(low, n - k, axis=1)[:, n - k]  # the k-th best lower bound
        still = (high >= least[:, None]) & ~own
        done = (still.sum(axis=1) <= few) | (depth == n)
        for i in np.flatnonzero(done):
            resolve(open_rows[i], np.flatnonzero(still[i]))
        open_rows = open_rows[~done]
        if not len(open_rows):
            break
    return out


def _search(k: int):
    """Rows are sorted: a block of candidates, then the queries asked of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = lists = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if not row["asks"]:
                    block, lists = row, None
                    continue
                width = max(block["width"], row["width"])
                if lists is None or lists.x.shape[1] != width:
                    lists = Lists(*unpack(block["ids"], block["width"], block["x"]), width)
                q_ids, q = unpack(row["ids"], row["width"], row["x"])
                wide = np.zeros((len(q_ids), width), np.int64)
                wide[:, :row["width"]] = q
                found = top_of_block(lists, q_ids, wide, k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], []))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every query; both sides as :func:`usable` gives them."""
    queries = queries.groupBy("id").agg(F.min("x").alias("x"))
    n = max(1, -(-vectors.count() // BLOCK))
    blocks = checkpoint(vectors.repartition(n).mapInArrow(_packer(BLOCK), SCHEMA))  # a block's number is its partition's
    asked = queries.repartition(max(1, -(-queries.count() // BATCH))).mapInArrow(_packer(BATCH), SCHEMA).drop("block", "piece")
    asked = asked.crossJoin(F.broadcast(blocks.select("block", "piece")))  # a row for each ``BLOCK`` vectors
    sent = blocks.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    found = sent.repartition(n, "block", "piece").sortWithinPartitions("block", "piece", "asks", "width").mapInArrow(
        _search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select vec_id as id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.id as query_id, c.id as vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.id <> c.id where q.id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 5
"""


@query("op10_topk", SQL)
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("id") % 50 == 0))
