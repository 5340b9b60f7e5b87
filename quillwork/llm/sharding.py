"""Sharding by weighted rendezvous hashing of stable record keys. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 1024


def equal_shards(n: int) -> dict[int, float]:
    return {s: 1.0 for s in range(n)}


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard that wins the weighted rendezvous for key: the least -ln(u) / weight, u a hash of key and shard in (0, 1).

    Every shard draws by itself, so one more shard takes keys only into itself, and a changed weight moves keys only from or
    to that shard. A null key is a key of its own.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    shards = F.array(*[F.struct(F.lit(int(s)).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(weights.items())])
    name = F.coalesce(key.cast("string"), F.lit("\0"))

    def draw(x: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(name, x["shard"]), 11).cast("double") + 0.5) / F.lit(float(2**53))
        return F.struct((-F.ln(u) / x["weight"]).alias("cost"), x["shard"].alias("shard"))

    return F.array_min(F.transform(shards, draw))["shard"]


def assign_shards(df: DataFrame, weights: Mapping[int, float], key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """df with a shard column: a function of key and weights alone, without a shuffle.

    Null keys share one shard, repeated keys too. All other columns pass through; a column already named `shard` is replaced.
    """
    return df.withColumn(shard, rendezvous(F.col(key), weights))


def with_slots(df: DataFrame, shard: str, order: list[str], slot: str = "slot", slices: int = SLICES) -> DataFrame:
    """df with a position in its shard, gapless from 0, in the order of a hash slice and then `order`.

    A shard's rows are numbered in `slices` independent slices, whose sizes (shards * slices rows at most) give the offsets; no
    task holds a whole shard. Rows equal in `order` get neighbouring slots in any order.
    """
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    before = Window.partitionBy(shard).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(shard, "_slice").count().select(shard, "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(shard, "_slice").orderBy(*order)
    numbered = cut.withColumn("_n", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), [shard, "_slice"]).withColumn(slot, F.col("_n") + F.col("_offset")).drop("_n", "_offset", "_slice")


def shard_table(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard more) of every row.

    A null text counts as empty (size 8, crc32 0); null and repeated doc_ids keep their rows. No row is dropped, an empty table
    gives none, and further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = rows.withColumn("shard", rendezvous(F.col("doc_id"), equal_shards(shards)))
    slotted = with_slots(placed, "shard", ["doc_id", "size", "text_crc32"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), rendezvous(F.col("doc_id"), equal_shards(shards + 1)).alias("grown_shard"))
