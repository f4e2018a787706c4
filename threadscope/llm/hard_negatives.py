"""Hard negatives from Hilbert-ordered blocks with zone maps.

1. Rows are sorted by label and by their place on a Hilbert curve through the ``DIMS`` components that vary most, and cut
   into blocks of one label, written as Parquet. A zone map holds least and greatest value of every component of a block.
2. Interval arithmetic on a zone map bounds all inner products of an anchor with a block from below and above.
3. A search asks, for windows of scores of each anchor, for the best rows in them. First it reads the few blocks a window
   that promise most; the k-th best row found there is a floor. Then it reads every other block whose bounds meet the window
   and reach the floor (by score, then by the block's smallest id). What is not read cannot change the answer.
4. Positives are a search of one window over blocks of the anchor's own label, negatives one of a window a positive over
   all others.

Zone maps meet anchors, and blocks the anchors that must read them, in tasks that hold one block or one chunk of zone maps at
a time. Scores are integers and exact: beyond 2^52 Python's integers take over, and a score beyond 64 bits is an error.

Rows with a null id, label or vector, or a null or non-finite component take no part. Vectors of unlike length are filled
up with zeros. Equal rows are one row with a count, and each counts as a candidate. As an anchor an id counts once, with
its smallest label and vector, and rows of its own id are not its candidates. Negative positive scores have empty windows.
Ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadscope.llm.common import checkpoint, checkpoint_dir, query, shuffle_partitions, table

BLOCK = 512  # rows of a block
ZONES = 1024  # zone maps of a chunk
SLICE = 20_000  # anchors that meet a chunk in one task
SEEDS = 2  # blocks that a window reads first
DIMS, BITS = 16, 4  # of the curve: components, and bits of each
LOW, HIGH = -(1 << 63), (1 << 63) - 1
WINDOWS = "array<struct<w:int,lo:long,hi:long,score:long,id:long>>"
CARRIER = "key long, kind int, rows int, width int, ids binary, labels binary, low binary, high binary"
VISITOR = f"key long, kind int, anchor long, label int, x binary, seen array<long>, windows {WINDOWS}"
MEETING = f"{CARRIER}, anchor long, label int, x binary, seen array<long>, windows {WINDOWS}"


# --- vectors --------------------------------------------------------------------------------------------------------
def usable(vectors: DataFrame) -> DataFrame:
    """(id, label, x) of the rows that take part; x are the components times 256, rounded down."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    x = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), x.alias("x"))


def encode(x: np.ndarray) -> bytes:
    """Integers in as few bytes as the largest needs, after one byte that says how many."""
    top = int(max(x.max(), -int(x.min()) - 1)) if len(x) else 0
    size = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([size]) + x.astype(f"<i{size}").tobytes()


def decode(values: list[bytes], width: int = 0) -> np.ndarray:
    rows = [np.frombuffer(v[1:], f"<i{v[0]}") for v in values]
    out = np.zeros((len(rows), max([width, *map(len, rows)])), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, which are equally wide, as exact integers."""
    most = [max(int(m.max()), -int(m.min())) if m.size else 0 for m in (a, b)]
    if most[0] * most[1] * max(a.shape[1], 1) < 1 << 52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    out = a.astype(object) @ b.T.astype(object)
    if out.size and max(out.max(), -out.min()) > HIGH:
        raise OverflowError("a score beyond 64 bits")
    return out.astype(np.int64)


def widen(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1]))) if a.shape[1] < width else a


# --- order ----------------------------------------------------------------------------------------------------------
def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (columns times bits at most 63), by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for i in range(len(x)):
            up = (x[i] & step) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        step >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, step = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while step > 1:
        turn ^= np.where(x[-1] & step, step - 1, 0)
        step >>= 1
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for row in x:
            place = place << 1 | row >> bit & 1
    return place


def spreads(rows: DataFrame) -> list[tuple[int, float, float]]:
    """(component, mean, deviation) of the ``DIMS`` components that vary most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = decode(batch.column("x").to_pylist()).astype(np.float64)
            columns = [np.arange(x.shape[1]), np.full(x.shape[1], len(x)), x.sum(axis=0), (x * x).sum(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "n", "s", "q"])

    sums = rows.select("x").mapInArrow(run, "dim long, n long, s double, q double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    spread = sums.select("dim", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(1e-9))).alias("dev"))
    return [tuple(r) for r in spread.orderBy(F.col("dev").desc(), "dim").limit(DIMS).collect()]


def write_blocks(rows: DataFrame) -> DataFrame:
    """The written table of blocks: (key, label, rows, width, ids, x, low, high, least), x with one column of counts before."""
    spark = rows.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [encode(np.array(v, np.int64)) for v in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(x, pa.binary())], ["id", "label", "x"])

    packed = rows.mapInArrow(pack, "id long, label int, x binary").groupBy("id", "label", "x").agg(F.count("*").alias("n"))
    packed = checkpoint(packed)
    curve = spreads(packed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = decode(batch.column("x").to_pylist(), 1 + max((d for d, _, _ in curve), default=0))
            cells = np.stack([np.clip((x[:, d] - mean) / dev * (1 << BITS) / 5 + (1 << BITS) / 2, 0, (1 << BITS) - 1) for d, mean, dev in curve], axis=1) if curve else np.zeros((len(x), 1))
            # one bit less than a long has, whatever the number of components
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells[:, :63 // BITS], BITS))], [*batch.schema.names, "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key, held = TaskContext.get().partitionId() << 32, []

        def block() -> pa.RecordBatch:
            nonlocal key
            x = decode([r["x"] for r in held])
            ids, n = np.array([r["id"] for r in held], np.int64), np.array([r["n"] for r in held], np.int64)
            columns = [[key], [held[0]["label"]], [len(held)], [x.shape[1]], [ids.tobytes()], [n.tobytes()], [encode(x.ravel())], [encode(x.min(axis=0))], [encode(x.max(axis=0))], [int(ids.min())]]
            key += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], NAMES)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == BLOCK or held[0]["label"] != row["label"]):
                    yield block()
                held.append(row)
        if held:
            yield block()

    NAMES = ["key", "label", "rows", "width", "ids", "counts", "x", "low", "high", "least"]
    TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    order = ["label", "place", "id"]
    placed = packed.mapInArrow(place, "id long, label int, x binary, n long, place long")
    dealt = placed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    path = f"{checkpoint_dir(spark)}/blocks-{uuid.uuid4().hex}"
    schema = "key long, label int, rows int, width int, ids binary, counts binary, x binary, low binary, high binary, least long"
    dealt.mapInArrow(cut, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


# --- who meets whom -------------------------------------------------------------------------------------------------
class Carrier:
    """A block, or a chunk of zone maps: rows of ids, labels and one or two matrices."""

    def __init__(self, row: dict) -> None:
        self.rows, self.width, self.key = row["rows"], row["width"], row["key"]
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.low, self.high = (decode([row[c]]).reshape(self.rows, self.width) if row[c] else None for c in ("low", "high"))


def meet(carriers: DataFrame, visitors: DataFrame, visit: Callable, schema: str) -> DataFrame:
    """``visit(carrier, rows)`` for each carrier and up to 256 of its visitors at a time; both have ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carrier, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0 or len(held) == 256:
                    if held:
                        yield visit(carrier, held)
                    held = []
                if row["kind"] == 0:
                    carrier = Carrier(row)
                else:
                    held.append(row)
        if held:
            yield visit(carrier, held)

    both = carriers.withColumn("kind", F.lit(0)).unionByName(visitors.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    names = [f.split()[0] for f in MEETING.replace(WINDOWS, "w").split(", ")]
    dealt = both.select(*names).repartition(shuffle_partitions(both.sparkSession), "key").sortWithinPartitions("key", "kind")
    return dealt.mapInArrow(run, schema)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that a row of ``anchors`` can have inside the box of a row of ``low`` and ``high``."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def _promise(same: bool, first: bool):
    """Zone maps against anchors. First: the blocks that promise most, per window; then: all that are still needed."""

    def visit(zones: Carrier, rows: list[dict]) -> pa.RecordBatch:
        x = decode([r["x"] for r in rows], zones.width)
        least, most = bounds(x, widen(zones.low, x.shape[1]), widen(zones.high, x.shape[1]))
        # of the chunk: block keys in ids, and label and smallest id of each in labels
        labels, smallest = zones.labels[:zones.rows], zones.labels[zones.rows:]
        out = []
        for i, row in enumerate(rows):
            fits = (labels == row["label"]) == same
            need = np.zeros(zones.rows, bool)
            for w in row["windows"]:
                meets = fits & (least[i] <= w["hi"]) & (most[i] >= w["lo"])
                if first:
                    at = np.flatnonzero(meets)
                    # Scores around the middle of the bounds are likeliest; they should be near the top of the window.
                    middle = least[i, at] / 2.0 + most[i, at] / 2.0
                    far = np.abs(middle - float(w["hi"])) if w["hi"] < HIGH else -most[i, at].astype(np.float64)
                    for j in np.argsort(far, kind="stable")[:SEEDS]:
                        out.append((row["anchor"], w["w"], int(zones.ids[at[j]]), float(far[j])))
                    continue
                if w["score"] is not None:
                    meets &= (most[i] > w["score"]) | (most[i] == w["score"]) & (smallest < w["id"])
                need |= meets
            if not first:
                need &= ~np.isin(zones.ids, row["seen"])
                out += [(row["anchor"], 0, int(k), 0.0) for k in zones.ids[need]]
        columns = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["anchor", "w", "block", "far"])

    return visit


def _best(k: int):
    """The best rows of a block in each window of its visitors."""

    def visit(block: Carrier, rows: list[dict]) -> pa.RecordBatch:
        x = decode([r["x"] for r in rows], block.width)
        scores, out = products(x, widen(block.low, x.shape[1])), []
        for i, row in enumerate(rows):
            for w in row["windows"]:
                fits = (scores[i] >= w["lo"]) & (scores[i] <= w["hi"]) & (block.ids != row["anchor"])
                if w["score"] is not None:  # k rows are as good as the floor
                    fits &= (scores[i] > w["score"]) | (scores[i] == w["score"]) & (block.ids < w["id"])
                at = np.flatnonzero(fits)
                for j in at[np.lexsort((block.ids[at], -scores[i, at]))[:k]]:
                    out.append((row["anchor"], w["w"], int(block.ids[j]), int(scores[i, j]), int(block.labels[j])))
        columns = list(zip(*out)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["anchor", "w", "id", "score", "n"])

    return visit


def zone_chunks(blocks: DataFrame) -> DataFrame:
    """Carriers of ``ZONES`` zone maps each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 20

        def chunk(rows: list[dict]) -> pa.RecordBatch:
            width = max(r["width"] for r in rows)
            low, high = (decode([r[c] for r in rows], width) for c in ("low", "high"))
            ids, labels = np.array([r["key"] for r in rows], np.int64), np.array([r["label"] for r in rows] + [r["least"] for r in rows], np.int64)
            columns = [[key], [len(rows)], [width], [ids.tobytes()], [labels.tobytes()], [encode(low.ravel())], [encode(high.ravel())]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4))],
                                              ["key", "rows", "width", "ids", "labels", "low", "high"])

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == ZONES:
                    yield chunk(held)
                    held, key = [], key + 1
        if held:
            yield chunk(held)

    zones = blocks.select("key", "label", "width", "low", "high", "least").coalesce(max(1, blocks.count() // ZONES))
    return checkpoint(zones.mapInArrow(run, "key long, rows int, width int, ids binary, labels binary, low binary, high binary"))


def search(blocks: DataFrame, zones: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, w, id, score, rank): the k best rows in every window of ``anchors`` (anchor, label, x, windows)."""
    order = Window.partitionBy("anchor", "w").orderBy(F.col("score").desc(), "id").rowsBetween(Window.unboundedPreceding, 0)
    slices = max(1, -(-anchors.count() // SLICE))
    chunk_keys = zones.select("key", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"))  # zone chunks stay few: a chunk is 1,024 blocks
    spread = zones.join(chunk_keys, "key").withColumn("chunk", F.col("key") * slices + F.col("s")).drop("key", "s").withColumnRenamed("chunk", "key")
    keys = chunk_keys.select((F.col("key") * slices + F.col("s")).alias("key"), "s")

    def asked(rows: DataFrame, first: bool) -> DataFrame:
        visitors = rows.withColumn("s", F.pmod(F.xxhash64("anchor"), F.lit(slices)).cast("int")).join(keys, "s").drop("s")
        return meet(spread, visitors, _promise(same, first), "anchor long, w int, block long, far double")

    def read(pairs: DataFrame, rows: DataFrame) -> DataFrame:
        visitors = checkpoint(pairs.select("anchor", "block").distinct().join(rows, "anchor").withColumnRenamed("block", "key"))
        wanted = blocks.join(visitors.select("key").distinct(), "key", "left_semi")
        carriers = wanted.select("key", "rows", "width", "ids", F.col("counts").alias("labels"), F.col("x").alias("low"), F.lit(None).cast("binary").alias("high"))
        found = meet(carriers, visitors, _best(k), "anchor long, w int, id long, score long, n long")
        return checkpoint(kept(found))

    def kept(found: DataFrame) -> DataFrame:
        """The k best rows of each window, those of equal rows counted; ``upto`` is the place of a row's last copy."""
        return found.select("anchor", "w", "id", "score", "n").withColumn("upto", F.sum("n").over(order)).filter(F.col("upto") - F.col("n") < k)

    near = Window.partitionBy("anchor", "w").orderBy("far", "block")
    seeds = checkpoint(asked(anchors, True).withColumn("i", F.row_number().over(near)).filter(F.col("i") <= SEEDS))
    early = read(seeds, anchors)
    # The floor of a window: its k-th best row so far.
    floors = early.filter(F.col("upto") >= k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", F.struct("score", "id")))).alias("floor"))
    seen = seeds.groupBy("anchor").agg(F.collect_set("block").alias("seen"))  # SEEDS blocks a window at most
    raised = F.transform("windows", lambda w: F.struct(w["w"].alias("w"), w["lo"].alias("lo"), w["hi"].alias("hi"), F.try_element_at("floor", w["w"])["score"].alias("score"), F.try_element_at("floor", w["w"])["id"].alias("id")))
    again = anchors.drop("seen").join(floors, "anchor", "left").join(seen, "anchor", "left")
    again = checkpoint(again.select("anchor", "label", "x", F.coalesce("seen", F.array().cast("array<long>")).alias("seen"), raised.cast(WINDOWS).alias("windows")))
    late = read(asked(again, False), again)
    best = kept(early.unionByName(late))
    copies = F.sequence(F.col("upto") - F.col("n") + 1, F.least("upto", F.lit(k)))  # k at most
    return best.select("anchor", "w", "id", "score", F.explode(copies).alias("rank")).withColumn("rank", F.col("rank").cast("int"))


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); both sides (id, label, x).

    Negatives of a positive with score p have scores from low * p / 100 to high * p / 100, for 0 <= low <= high.
    """
    blocks = write_blocks(rows)
    zones = zone_chunks(blocks)
    one = anchors.groupBy(F.col("id").alias("anchor")).agg(F.min(F.struct("label", "x")).alias("own")).select("anchor", "own.*")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [encode(np.array(v, np.int64)) for v in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("label"), pa.array(x, pa.binary())], ["anchor", "label", "x"])

    def window(w, lo, hi):
        nothing = F.lit(None).cast("long")
        return F.struct(w.cast("int").alias("w"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), nothing.alias("score"), nothing.alias("id"))

    nobody = F.array().cast("array<long>").alias("seen")
    one = checkpoint(one.mapInArrow(pack, "anchor long, label int, x binary"))
    whole = F.array(window(F.lit(0), F.lit(LOW), F.lit(HIGH))).cast(WINDOWS).alias("windows")
    found = checkpoint(search(blocks, zones, one.select("*", nobody, whole), True, positives))
    found = found.filter("score >= 0").withColumns({"lo": F.expr(f"({low} * score + 99) div 100"), "hi": F.expr(f"{high} * score div 100")})
    windows = found.groupBy("anchor").agg(F.collect_list(window(F.col("rank"), F.col("lo"), F.col("hi"))).cast(WINDOWS).alias("windows"))
    asked = checkpoint(one.join(windows, "anchor").select("anchor", "label", "x", nobody, "windows"))
    hard = search(blocks, zones, asked, False, negatives)
    known = found.select("anchor", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(known, ["anchor", "w"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
with v as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.id as anchor_id, c.id, a.label = c.label as same, cast(list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v c on a.id <> c.id where a.id % 100 = 0),
positives as (select * from scored where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
found as (
  select p.anchor_id, p.id as positive_id, n.id as negative_id, p.score as positive_score, n.score as negative_score,
         row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id) as rank
  from positives p join scored n on n.anchor_id = p.anchor_id and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from found where rank <= 10
"""


@query("op13_hard_negatives", SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.expr("case when id % 7 = 0 then (label + 1) % 10 else label end"))
    return hard_negatives(rows, rows.filter(F.col("id") % 100 == 0))
