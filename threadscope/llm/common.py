"""What several operators share: tables, batches of bounded size, words and their hashes."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder; the session's own setting always wins, tests without one get a folder of their own."""
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions, read from the shared folder from here on."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what has been checkpointed; it does so when the driver collects garbage, which
    an idle driver may not do for a whole job of many rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(col) -> F.Column:
    """Null texts are empty."""
    return F.coalesce(col.cast("string"), F.lit(""))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of text (or one row); numpy needs about 100 bytes for each of them.
    Null texts count as empty."""
    for batch in batches:
        col = batch.column(column)
        ends = np.cumsum(pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and n + 1 offsets into them."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


# --- hashes of byte strings, all modulo 2^64 ------------------------------------------------------------------------
BASE = 0x9E3779B97F4A7C15 | 1
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64 (public domain): a bijection in which every bit of the input moves every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of ``BASE`` and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE, np.uint64)]))
            inverse = pow(BASE, -1, 1 << 64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, inverse, np.uint64)]))
        return self.up, self.down


def prefix_hash(data: np.ndarray, powers: Powers) -> np.ndarray:
    """n + 1 prefix sums; ``(h[e] - h[s]) * down[s]`` depends on the bytes s to e only."""
    up, _ = powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=out[1:])
    return out


#: Letters and digits of ASCII in lower case and all bytes of other characters are parts of words; the rest parts them.
WORD_BYTES = np.zeros(256, np.uint8)
WORD_BYTES[128:] = np.arange(128, 256)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    WORD_BYTES[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    WORD_BYTES[_c] = _c + 32


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, as :func:`shingle_hashes` sees them."""
    return WORD_BYTES[np.frombuffer((text or "").encode(), np.uint8)].tobytes().replace(b"\0", b" ").split()


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every ``size``-word shingle, in order; a row with fewer words has one shingle of all, without words none."""
    norm = WORD_BYTES[data]
    inside = norm > 0
    edge = np.zeros(len(norm) + 1, bool)  # a word may not run on from one text into the next
    edge[offsets[:-1]] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(norm) else inside
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(norm) else inside
    ends = np.flatnonzero(inside & ~after) + 1
    prefix = prefix_hash(norm, powers)
    word = mix((prefix[ends] - prefix[starts]) * powers.get(len(norm) + 1)[1][starts])
    first = np.searchsorted(starts, offsets)  # first word of each row
    return combine(word, first, size)


def combine(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` word hashes; row r has the words ``first[r]:first[r + 1]``."""
    count = np.diff(first)
    step = np.uint64(BASE)
    sums = np.zeros(len(word), np.uint64)
    for j in range(size):  # Horner's rule: earlier words get higher powers
        shifted = np.zeros(len(word), np.uint64)
        shifted[:max(len(word) - j, 0)] = word[j:]
        sums = sums * step + shifted
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(word)) - first[:-1][row]
    full = at + size <= count[row]
    short = np.flatnonzero((count > 0) & (count < size))
    rows, hashes = row[full], sums[full]
    if len(short):
        extra = np.array([_fold(word[first[r]:first[r + 1]]) for r in short], np.uint64)
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, extra])
        order = np.argsort(rows, kind="stable")
        rows, hashes = rows[order], hashes[order]
    return rows, mix(hashes)


def _fold(words: np.ndarray) -> int:
    value = 0
    for w in words.tolist():
        value = (value * BASE + w) & 0xFFFFFFFFFFFFFFFF
    return value


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not use yet, whatever its case rules."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def join_counted(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """``left`` joined to ``right``, which has each ``key`` once and in ``rows`` how many rows of ``left`` have it.

    Keys that hold more than one row in ``share`` are fewer than ``share``; they are broadcast, so that none of them
    becomes one task. All others go through a shuffle. With ``how="left"`` rows without a partner stay.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) * share > F.lit(total)
    few, many = F.broadcast(right.filter(hot).drop(rows)), right.filter(~hot).drop(rows)
    rest = left.join(few.select(key), key, "left_anti")
    return left.join(few, key).unionByName(rest.join(many, key, how))


def join_sized(left: DataFrame, right: DataFrame, key: str, rows: str, share: int = 1000) -> DataFrame:
    """Inner join of ``left`` to ``right``, which has each ``key`` once and in ``rows`` how many rows of ``left`` have it.

    As :func:`join_counted`, but the hot keys, fewer than ``share``, are named in a filter, so no row passes a join that
    does not match. ``right`` is best a checkpoint, as it is read three times.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = right.filter(F.col(rows) * share > F.lit(total))
    names = [r[0] for r in hot.select(key).collect()]  # bounded by ``share``
    if not names:
        return left.join(right.drop(rows), key)
    is_hot = F.col(key).isin(names)
    few, many = right.filter(is_hot).drop(rows), right.filter(~is_hot).drop(rows)
    return left.filter(is_hot).join(F.broadcast(few), key).unionByName(left.filter(~is_hot).join(many, key))
