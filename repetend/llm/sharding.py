"""Sharding by jump consistent hashing.

The shard of a key follows from the key and the number of shards alone, with no table. A generator seeded with the key
draws where it jumps next; its last jump below the number of shards is the key's shard. With one more shard a key
either stays or jumps to the new one, so only the necessary fraction moves. The generator is the 64-bit linear
congruential one of the published algorithm; its products stay exact in 38 decimal digits, so everything is
DataFrame expressions. A row's slot in its shard is its rank within a salted part of the shard plus the parts before.

Defined results: the key is doc_id where that is a whole number, negative ones counted as unsigned, else the xxhash64 of
its string; a null doc_id takes key 0. Null text has size 8 and the checksum of no bytes. Equal rows go to one shard and
share a part of its slots. The parts follow from id and text together, so many texts of one id are dealt out too. Columns
besides doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARDS, SALTS = 24, 256
#: Fixed values of the algorithm.
MULTIPLIER, WORD, DRAW = 2862933555777941757, 1 << 64, 1 << 31


def jump(key: Column, shards: int) -> Column:
    """Shard of a long key among 0 to shards - 1."""
    wide = "decimal(38,0)"
    number = lambda x: F.lit(str(x)).cast(wide)
    seed = key.cast(wide)
    start = F.struct(F.when(seed < 0, (seed + number(WORD)).cast(wide)).otherwise(seed).alias("key"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def step(a: Column, _: Column) -> Column:
        key = (((a["key"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)")).cast(wide) + F.lit(1)).cast(wide) % number(WORD)).cast(wide)
        # key >> 33, plus one; the subtraction leaves a whole quotient
        draw = ((key - key % number(1 << 33)).cast(wide) / F.lit(str(1 << 33)).cast("decimal(10,0)")).cast("bigint") + 1
        moved = F.struct(key.alias("key"), a["j"].alias("b"), F.floor((a["j"] + 1).cast("double") * (F.lit(float(DRAW)) / draw.cast("double"))).cast("bigint").alias("j"))
        return F.when(a["j"] < shards, moved).otherwise(a)

    # every jump goes at least one shard up, so shards steps are enough
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step, lambda a: a["b"]).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, salts: int = SALTS) -> DataFrame:
    """Shard, slot and grown_shard of each row, with its size and checksum."""
    text, whole = F.coalesce("text", F.lit("")), isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    key = F.coalesce(F.col("doc_id").cast("bigint") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("string"))), F.lit(0).cast("bigint"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump(key, shards).alias("shard"),
        jump(key, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(salts)).cast("int").alias("salt"),
    )
    # a slot needs only its row's small columns, so texts are read once and never shuffled
    counts = rows.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = counts.select("shard", "salt", (F.sum("n").over(Window.partitionBy("shard").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "size", "text_crc32")))
    # at most shards * salts rows
    placed = ranked.join(F.broadcast(before), ["shard", "salt"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("rank") - 1).cast("bigint").alias("slot"), "grown_shard")
