"""Top N items within every group, by histogram threshold and exact ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the hashed group count; 2**20 counts are 16 MB at most.
GROUP_SLOTS = 1 << 20
#: At most this many groups get a threshold; the rest are smaller than rows / MAX_THRESHOLDS.
MAX_THRESHOLDS = 1 << 16


def score_bin(score: Column, per_log: int) -> Column:
    """A bin number that never falls when the score rises: sign times log(1 + |score|), in steps."""
    return F.floor(F.signum(score) * F.log1p(F.abs(score)) * F.lit(float(per_log))).cast("int")


def top_n_per_group(
    df: DataFrame,
    group: str,
    score: str,
    tie: str,
    n: int,
    per_log: int = 64,
    slots: int = GROUP_SLOTS,
    max_thresholds: int = MAX_THRESHOLDS,
) -> DataFrame:
    """The ``n`` rows of highest ``score`` in every ``group``; equal scores by ``tie`` from low to high.

    Returns ``group``, ``tie``, ``score`` and ``rank`` (1 is best). ``tie`` identifies a row: rows that
    agree in ``group`` and ``tie`` are copies and count once (should their scores differ, the highest holds).
    Rows whose group, tie or score is null, and scores that are NaN or infinite, take no part; -0.0 counts as 0.0.
    An empty table gives an empty result. Other columns of ``df`` may have any name; they aren't read.

    1. Rows are counted by hash slot of their group. Only the ``max_thresholds`` fullest slots go on (a slot beyond
       them, and so each group in it, has at most ``rows / max_thresholds`` rows and needs no threshold).
    2. Rows of those slots are pre-aggregated to a histogram (group, score bin). Since copies may not count twice,
       a bin holds a 64-bit set of hashed ties: its bits never exceed the number of different rows. Walking the bins
       down from the top gives the highest bin with at least ``n`` rows in it or above.
    3. Rows under their group's threshold are dropped by a map-side join with the thresholds (of
       12 bytes, the ``max_thresholds`` largest groups; groups that share a hash take the lower one). Copies of the survivors
       are merged by a shuffle on group and tie, which spreads a hot group of tied scores evenly; then Spark cuts each map
       task's share to ``n`` rows a group before the shuffle on groups, in which the rows are ranked exactly.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    value = F.col(score).cast("double") + F.lit(0.0)
    rows = df.select(F.col(group).alias("g"), F.col(tie).alias("t"), value.alias("s")).where(
        F.col("g").isNotNull() & F.col("t").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s") & (F.abs("s") < F.lit(float("inf")))
    )
    hashed = rows.withColumn("h", F.xxhash64("g")).withColumn("slot", F.pmod("h", F.lit(slots)).cast("int"))
    counts = hashed.groupBy("slot").agg(F.count("*").alias("c")).where(F.col("c") >= 8 * n)
    large = counts.orderBy(F.desc("c"), "slot").limit(max_thresholds).select("slot")

    #: Sets of 64 hashed ties; more sets a bin when n is large, so that a set isn't full before n.
    sets = -(-n // 16)
    tie_hash = F.xxhash64("t")
    histogram = (
        hashed.join(F.broadcast(large), "slot")
        .select(
            "g",
            "h",
            score_bin(F.col("s"), per_log).alias("b"),
            F.pmod(F.shiftrightunsigned(tie_hash, 6), F.lit(sets)).alias("k"),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(tie_hash, F.lit(64)).cast("int")).alias("bit"),
        )
        .groupBy("g", "h", "b", "k")
        .agg(F.bit_or("bit").alias("bits"))
        .groupBy("g", "h", "b")
        .agg(F.sum(F.bit_count("bits")).alias("c"))
    )
    down = Window.partitionBy("g").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    thresholds = (
        histogram.withColumn("above", F.sum("c").over(down))
        .groupBy("g", "h")
        .agg(F.max(F.when(F.col("above") >= n, F.col("b"))).alias("b"), F.max("above").alias("size"))
        .where(F.col("b").isNotNull())
        .orderBy(F.desc("size"), "h")
        .limit(max_thresholds)
        .groupBy("h")
        .agg(F.min("b").alias("floor"))
    )
    best = Window.partitionBy("g").orderBy(F.desc("s"), F.asc("t"))
    return (
        hashed.join(F.broadcast(thresholds), "h", "left")
        .where(F.col("floor").isNull() | (score_bin(F.col("s"), per_log) >= F.col("floor")))
        .groupBy("g", "t")
        .agg(F.max("s").alias("s"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= n)
        .select(F.col("g").alias(group), F.col("t").alias(tie), F.col("s").alias(score), "rank")
    )
