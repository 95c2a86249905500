"""Hashed bitmaps as tables of at most SLOTS / 64 rows: a bounded broadcast that tells which rows may match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 23


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def bitmap(df: DataFrame, key: Column) -> DataFrame:
    """The bitmap of all keys of ``df``; combined before the shuffle."""
    slot = _slot(key)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int"))
    return df.select(F.call_function("shiftright", slot, F.lit(6)).cast("int").alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def with_maybe(df: DataFrame, key: Column, bits: DataFrame, name: str = "maybe") -> DataFrame:
    """``df`` with a boolean column: false if the key is certainly not in the bitmap. One map-side join, no shuffle of ``df``."""
    slot = _slot(key)
    at = df.withColumn("_slot", slot).withColumn("_word", F.call_function("shiftright", F.col("_slot"), F.lit(6)).cast("int"))
    hit = F.getbit(F.coalesce("_bits", F.lit(0).cast("bigint")), F.pmod("_slot", F.lit(64)).cast("int")) == 1
    return at.join(F.broadcast(bits), "_word", "left").withColumn(name, hit).drop("_slot", "_word", "_bits")
