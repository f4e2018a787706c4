"""Ranks and running totals that never put one group into one task.

A plain ranking window sorts a whole group in one task, which fails once a group holds a third of the rows. Here a
group is first cut into blocks whose order is known (hash prefixes, or cut points of the values). Counts per block are
tiny after partial aggregation, a running total over them gives every block its starting rank, and the window then
works inside one block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadscope.session import scratch_path

HASH_DIGITS = 3  # 16**3 = 4096 blocks per group


def draw_hash(ids: Sequence[str], seed: str) -> Column:
    """Reproducible pseudo-random order: the same for any partitioning and in any engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in ids]))


def hash_ranked(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: str = "42",
                quota: Callable[[Column], Column] | None = None, digits: int = HASH_DIGITS) -> DataFrame:
    """Add ``_rank`` (1-based hash order inside the group) and ``_n`` (rows of the group).

    With ``quota``, a function of the group size, only rows with ``_rank <= quota(_n)`` are kept, and blocks wholly
    beyond the quota are dropped before the rows are sorted. Rows with a null key belong to no group and are dropped.
    ``ids`` must be unique within a group. The input is read twice, once for the counts with only the key columns; give
    it a saved table where the keys are costly to compute.
    """
    keys = list(keys)
    on = keys or ["_all"]
    base = df.dropna(subset=keys) if keys else df.withColumn("_all", F.lit(1))
    base = base.withColumn("_hash", draw_hash(ids, seed))
    base = base.withColumn("_block", F.substring("_hash", 1, digits))

    group = Window.partitionBy(*on)
    earlier = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        base.groupBy(*on, "_block").agg(F.count(F.lit(1)).alias("_in_block"))
        .withColumn("_n", F.sum("_in_block").over(group))
        .withColumn("_before", F.coalesce(F.sum("_in_block").over(earlier), F.lit(0)).cast("long"))
        .drop("_in_block")
    )
    if quota is not None:
        blocks = blocks.withColumn("_quota", quota(F.col("_n")).cast("long")).filter("_before < _quota")
    inside = Window.partitionBy(*on, "_block").orderBy("_hash", *ids)
    out = base.join(blocks, [*on, "_block"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside))
    if quota is not None:
        out = out.filter("_rank <= _quota").drop("_quota")
    spare = ["_hash", "_block", "_before"] + ([] if keys else ["_all"])
    return out.drop(*spare)


CUTS_BROADCAST = 500_000


def hash_cutoffs(df: DataFrame, keys: Sequence[str], ids: Sequence[str], quota: Callable[[Column], Column],
                 seed: str = "42", digits: int = HASH_DIGITS) -> DataFrame | None:
    """Per group the last (hash, ids) among its ``quota(n)`` first rows in hash order: ``keys, _cut, _everything``.

    Only counts per (group, hash prefix) and, for the one prefix in which a group's quota ends, the keys and ids of its
    rows are shuffled. Groups with a quota of none have no row; ``_everything`` marks those with one of n or more. The
    result is a small saved table, or None beyond ``CUTS_BROADCAST`` groups.
    """
    keys, spark = list(keys), df.sparkSession
    base = df.dropna(subset=keys) if keys else df
    place = F.struct(F.col("_hash"), *[F.col(c) for c in ids]).alias("_place")
    base = base.select(*keys, draw_hash(ids, seed).alias("_hash"), *[c for c in ids if c not in keys])
    base = base.select(*keys, F.substring("_hash", 1, digits).alias("_block"), place)

    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        base.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_in_block"))
        .withColumn("_n", F.sum("_in_block").over(group))
        .withColumn("_before", F.coalesce(F.sum("_in_block").over(earlier), F.lit(0)).cast("long"))
        .withColumn("_quota", quota(F.col("_n")).cast("long"))
    )
    # The block that holds the last row of the quota; the last block where the quota takes everything.
    ends = (F.col("_before") < F.least("_quota", "_n")) & (F.col("_before") + F.col("_in_block") >= F.least("_quota", "_n"))
    path = scratch_path(spark, "cuts")
    blocks.filter(ends).select(
        *keys, "_block", (F.col("_quota") - F.col("_before")).alias("_at"), (F.col("_quota") >= F.col("_n")).alias("_everything")
    ).write.parquet(path)
    edges = spark.read.parquet(path)
    if edges.count() > CUTS_BROADCAST:
        return None
    inside = Window.partitionBy(*keys, "_block").orderBy("_place")
    open_edges = edges.filter(~F.col("_everything"))
    last = (
        base.join(F.broadcast(open_edges), [*keys, "_block"])
        .withColumn("_rank", F.row_number().over(inside)).filter("_rank = _at").select(*keys, F.col("_place").alias("_cut"))
    )
    cuts = scratch_path(spark, "cuts")
    everything = edges.filter("_everything").select(*keys, F.lit(True).alias("_everything"))
    last.withColumn("_everything", F.lit(False)).unionByName(everything, allowMissingColumns=True).write.parquet(cuts)
    return spark.read.parquet(cuts)


def within_cutoff(df: DataFrame, cuts: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: str, how: str) -> DataFrame:
    """``df`` beside its group's cutoff, with ``_inside``; no row is shuffled, as the cutoffs are few."""
    place = F.struct(draw_hash(ids, seed), *[F.col(c) for c in ids])
    if keys:
        joined = df.dropna(subset=list(keys)).join(F.broadcast(cuts), list(keys), how)
    else:  # one group: its cutoff is one row
        cut = cuts.agg(F.first("_cut").alias("_cut"), F.coalesce(F.first("_everything"), F.lit(False)).alias("_everything"))
        found = cut.collect()[0]
        if found["_everything"] or found["_cut"] is None:
            return df.withColumn("_inside", F.lit(bool(found["_everything"])))
        fields = [f.dataType for f in cuts.schema["_cut"].dataType.fields]
        last = F.struct(*[F.lit(v).cast(t) for v, t in zip(found["_cut"], fields)])
        return df.withColumn("_inside", place <= last)
    return joined.withColumn("_inside", F.coalesce(F.col("_everything") | (place <= F.col("_cut")), F.lit(False))).drop("_cut", "_everything")


def keep_by_hash(df: DataFrame, keys: Sequence[str], ids: Sequence[str], quota: Callable[[Column], Column],
                 seed: str = "42", digits: int = HASH_DIGITS) -> DataFrame:
    """Per group keep the ``quota(n)`` rows that come first in hash order.

    Each group's cutoff becomes a filter, so rows stay where they are read and those not chosen never move; the input is
    read three times, twice for keys and ids only. Beyond ``CUTS_BROADCAST`` groups rows are ranked, and shuffled once.
    """
    cuts = hash_cutoffs(df, keys, ids, quota, seed, digits)
    if cuts is None:
        return hash_ranked(df, keys, ids, seed, quota, digits).drop("_rank", "_n").select(*df.columns)
    return within_cutoff(df, cuts, keys, ids, seed, "inner").filter("_inside").select(*df.columns)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per group. The limit is pushed below the shuffle, so a task sends at most k rows per group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


KEYS_BROADCAST = 10_000


def running_totals(df: DataFrame, key: str, key_values: Sequence[str] | None, value: str, sums: Sequence[str],
                   splits: int = 256) -> DataFrame:
    """Descending running totals of ``sums`` per key: for each row, the total over rows with a value not below its own.

    ``df`` has one row per (key, value). The cut points of a key are ``splits`` of its values picked by smallest hash,
    so every evaluation cuts alike. Without ``key_values`` all keys count (null is none); with them, only those listed.
    Both small tables joined back have ``splits + 1`` rows a key. They are broadcast if there are at most
    ``KEYS_BROADCAST`` keys, which is looked up first; beyond that the joins shuffle.
    """
    step = math.isqrt(splits)
    if key_values is None:
        base = df.filter(F.col(key).isNotNull())
        few = len(base.select(key).distinct().take(KEYS_BROADCAST + 1)) <= KEYS_BROADCAST
    else:
        base, few = df.filter(F.col(key).isin(*key_values)), len(key_values) <= KEYS_BROADCAST
    small = F.broadcast if few else lambda t: t
    picked = Window.partitionBy(key).orderBy("_h", value)
    cuts = (
        base.select(key, value, F.xxhash64(key, value).alias("_h"))
        .withColumn("_r", F.row_number().over(picked)).filter(F.col("_r") <= splits)
        .groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("_cuts"))
        .withColumn("_coarse", F.transform(
            F.sequence(F.lit(1), F.size("_cuts"), F.lit(step)), lambda i: F.element_at("_cuts", i)))
    )
    # Two short searches, first among every step-th cut and then between two of those, instead of a pass over all cuts.
    not_above = lambda points: F.size(F.filter(points, lambda c: c <= F.col(value)))
    start = F.greatest(F.col("_c") - 1, F.lit(0)) * step
    blocked = (
        base.join(small(cuts), key).withColumn("_c", not_above(F.col("_coarse")))
        .withColumn("_block", F.when(F.col("_c") == 0, 0).otherwise(
            start + not_above(F.slice("_cuts", start + 1, F.lit(step)))))
        .drop("_cuts", "_coarse", "_c")
    )
    above = Window.partitionBy(key).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocked.groupBy(key, "_block").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    offsets = offsets.select(
        key, "_block", *[F.coalesce(F.sum(f"_t_{s}").over(above), F.lit(0)).alias(f"_o_{s}") for s in sums]
    )
    inside = Window.partitionBy(key, "_block").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.join(small(offsets), [key, "_block"])
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.sum(s).over(inside) + F.col(f"_o_{s}"))
    return out.drop("_block", *[f"_o_{s}" for s in sums])
