"""Jump consistent hashing, on DataFrame functions alone.

A 48-bit linear congruential sequence, seeded with the document's id, says at which shard
counts the document would move; its shard is the last such count below the number of shards.
No table of the ring is kept, and one more shard takes 1/(n+1) of the rows, all into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Multiplier and increment of the 48-bit generator of POSIX drand48.
MULTIPLIER, INCREMENT = 25214903917, 11
BIN = 2048  # rows of a shard to a bin, about; within one, slots are counted in one task


def next_state(x: str) -> str:
    """x * MULTIPLIER + INCREMENT modulo 2**48 in two halves, so that nothing passes 63 bits."""
    return f"(({x} & 16777215) * {MULTIPLIER}L + shiftleft((shiftright({x}, 24) * {MULTIPLIER}L) & 16777215L, 24) + {INCREMENT}L) & 281474976710655L"


def jump_shards(key: str, shards: int) -> Column:
    """struct(now, grown): the shards of a long key among `shards` and among one more. A null key counts as 0."""
    seed = f"(shiftleft(coalesce({key}, 0L) & 4294967295L, 16) + 13070L) ^ (shiftright(coalesce({key}, 0L), 32) & 4294967295L)"
    x = next_state("s.x")
    j = f"cast(floor((s.j + 1) * 2147483648L / (shiftright({x}, 17) + 1)) as bigint)".replace("floor(", "(").replace(" / ", " div ")
    step = f"if(s.j > {shards}, s, named_struct('x', {x}, 'j', {j}, 'now', if(s.j < {shards}, s.j, s.now), 'grown', s.j))"
    return F.expr(f"aggregate(sequence(1, {shards + 1}), named_struct('x', {seed}, 'j', 0L, 'now', 0L, 'grown', 0L), (s, i) -> {step}, s -> named_struct('now', cast(s.now as int), 'grown', cast(s.grown as int)))")


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of `docs` (doc_id, text).

    Slots count a shard's rows without a gap, in bins of the hash of doc_id, size and CRC, so that neither far-apart nor
    repeated ids make a bin large; equal rows get slots side by side. A null text has size 1 and CRC 0, a null
    doc_id stays null and is dealt as 0. An empty table gives none; other columns are not read.
    """
    bins = max(1, docs.count() // (shards * BIN))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")).withColumn("at", jump_shards("doc_id", shards))
    rows = rows.select("doc_id", "size", "text_crc32", "copies", F.col("at.now").alias("shard"), F.col("at.grown").alias("grown_shard"), F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(bins)).alias("bin"))
    ordered = Window.partitionBy("shard", "bin").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("copies").over(ordered), F.lit(0)))
    sums = rows.groupBy("shard", "bin").agg(F.sum("copies").alias("n"))
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rows = rows.join(starts, ["shard", "bin"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("before") + F.col("copy")).cast("long").alias("slot"), "grown_shard")
