"""Stable shards by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

A key's jumps are a walk 0 = b0 < b1 < ... that depends on the key alone; with n shards the key lies in the last b below
n. There is no ring table, and one more shard takes only the rows whose walk has a b equal to n. The walk multiplies 64-bit
numbers modulo 2^64; as 64-bit integers may not overflow here, it is done on halves of 32 bits.

Places within a shard are gapless: rows are counted per shard and block of keys, the counts are summed up before each
block, and rows are numbered inside their block. Blocks follow the number of rows, so no shard has to fit into one task;
rows that are equal in key, size and checksum travel as one row with a count until the end.

The law is ``key``: id and number of shards decide. A null id counts as 0, a null text is empty. Equal rows take places
next to each other; ties go by id, size and checksum. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadscope.llm.common import fresh, query, table, utf8

#: Multiplier of the published algorithm's generator.
STEP = 2862933555777941757
LOW32 = (1 << 32) - 1


def _times_step(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) halves of key * STEP + 1 modulo 2^64; no product exceeds 49 bits."""
    s = [STEP >> 16 * i & 0xFFFF for i in range(4)]

    def lit(n: int) -> Column:
        return F.lit(n).cast("long")

    def cut(c: Column) -> Column:  # times 2^16, modulo 2^32
        return F.shiftleft(c.bitwiseAND(lit(0xFFFF)), 16)

    upper = low * lit(s[1])
    sum_low = low * lit(s[0]) + lit(1) + cut(upper)
    carry = F.shiftright(sum_low, 32) + F.shiftright(upper, 16)
    sum_high = carry + high * lit(s[0]) + cut(high * lit(s[1])) + low * lit(s[2]) + cut(low * lit(s[3]))
    return sum_high.bitwiseAND(lit(LOW32)), sum_low.bitwiseAND(lit(LOW32))


def jumps(key: Column, shards: int) -> Column:
    """Struct (shard, grown): the shard of a long key among ``shards`` and among one more."""

    def long(n: int) -> Column:
        return F.lit(n).cast("long")

    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(long(LOW32)).alias("low"), long(0).alias("j"),
        long(0).alias("shard"), long(0).alias("grown"))

    def step(state: Column, _: Column) -> Column:
        high, low = _times_step(state["high"], state["low"])
        j = state["j"]
        further = F.floor((j + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        return F.struct(
            high.alias("high"), low.alias("low"), F.when(j <= shards, further).otherwise(j).alias("j"),
            F.when(j < shards, j).otherwise(state["shard"]).alias("shard"),
            F.when(j <= shards, j).otherwise(state["grown"]).alias("grown"))

    # Every jump goes forward, so a walk has left the shards after shards + 1 steps; the last step records where it was.
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards + 1)), start, step, lambda s: F.struct(
        s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def assign(docs: DataFrame, shards: int = 24, key: str = "doc_id", block: int = 20_000) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row. Copies of a row travel as counts of at most
    ``block``, each dealt to a block of its own, so that no task numbers or writes all of them."""
    text = utf8(docs["text"])
    rows = docs.select(
        docs[key].cast("long").alias("key"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    equal = rows.groupBy("key", "size", "crc").agg(F.count("*").alias("n"))
    total = docs.select(F.lit(1)).count()
    blocks = max(1, -(-total // (block * shards)))
    placed = equal.withColumn("to", jumps(F.coalesce("key", F.lit(0)), shards)).select("key", "size", "crc", "n", "to.shard", "to.grown")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block).cast("long")))
    placed = placed.withColumn("part", parts).withColumn("n", F.least(F.col("n") - F.col("part") * block, F.lit(block).cast("long")))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key", "size", "crc", "part"), F.lit(blocks)))
    counts = placed.groupBy("shard", "block").agg(F.sum("n").alias("rows"))
    before = counts.select("shard", "block", (F.sum("rows").over(Window.partitionBy("shard").orderBy("block")) - F.col("rows")).alias("base"))
    inside = Window.partitionBy("shard", "block").orderBy("key", "size", "crc", "part")
    numbered = placed.join(before, ["shard", "block"]).withColumn("first", F.col("base") + F.sum("n").over(inside) - F.col("n"))
    slots = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))
    return numbered.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", slots.alias("slot"),
        F.col("grown").alias("grown_shard"))


def with_shard(docs: DataFrame, shards: int = 24, key: str = "doc_id") -> DataFrame:
    """The rows with all columns and their shard, for a partitioned write; no shuffle."""
    (name,) = fresh(docs, "shard")
    return docs.withColumn(name, jumps(F.coalesce(docs[key].cast("long"), F.lit(0).cast("long")), shards)["shard"])


#: The walk in SQL with 128-bit numbers; the checksum has no SQL function there.
WALK_SQL = f"""
with recursive walk as (
  select doc_id, case when coalesce(doc_id, 0) < 0 then cast(doc_id as hugeint) + 18446744073709551616 else cast(coalesce(doc_id, 0) as hugeint) end as k,
    cast(0 as bigint) as j, cast(-1 as bigint) as last
  from (select distinct doc_id from documents)
  union all
  select doc_id, (k * {STEP} + 1) % 18446744073709551616,
    cast(floor((j + 1) * (2147483648.0 / (cast(((k * {STEP} + 1) % 18446744073709551616) // 8589934592 as double) + 1))) as bigint), j
  from walk where j <= 24)
select doc_id, cast(max(last) filter (where last < 24) as int) as shard, cast(max(last) filter (where last <= 24) as int) as grown_shard
from walk group by doc_id
"""


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_shard_of_key", WALK_SQL)
def op9_shard_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk alone, for the check against SQL."""
    ids = table(spark, sf_dir, "documents").select("doc_id").distinct()
    return ids.select("doc_id", jumps(F.coalesce("doc_id", F.lit(0)), 24).alias("to")).select("doc_id", "to.shard", F.col("to.grown").alias("grown_shard"))
