"""Positions, slices, shards, batches and expansions: what depends on row order, by explicit keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from rollmill.plans.store import written


def positions(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """``df`` with dense positions from 0 in the order of ``order`` (a unique key), without gathering rows in one task.

    Range partitioning sorts; each partition numbers its own rows; the partition counts, one row each, give the offsets.
    Written once, because a second evaluation could place partition borders elsewhere. NULL keys come first.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_base")  # one row a partition
    return ranged.join(F.broadcast(before), "_part").withColumn(name, (F.col("_base") + F.col("_own") - 1).cast("bigint")).drop("_part", "_own", "_base")


#: Rows up to which a prefix is a top-k; longer ones are cut between range partitions.
TOP_K = 100_000
#: Accuracy of the quantiles between which a stretch of rows is looked for.
ACCURACY = 10_000


def between(df: DataFrame, start: int, stop: int, *order: str, total: int | None = None) -> DataFrame:
    """The rows at positions [start, stop) by ``order`` (a unique key), NULL keys first.

    For a single numeric key two approximate quantiles, one aggregate, enclose the stretch; the rows before it are counted exactly and only
    those inside are sorted and written. Where that isn't possible, or the quantiles miss, all rows are numbered. The result is the same.
    """
    start, stop = max(0, start), max(0, stop)
    if stop <= start:
        return df.limit(0)
    kind = df.schema[order[0]].dataType
    if len(order) == 1 and isinstance(kind, NumericType):
        key = F.col(order[0])
        total = df.count() if total is None else total
        share = [min(1.0, max(0.0, x / max(1, total))) for x in (start - 2 * total / ACCURACY - 1, stop + 2 * total / ACCURACY + 1)]
        low, high = df.agg(F.percentile_approx(key, share, ACCURACY).alias("q")).first().q or (None, None)
        if low is not None:
            low = None if share[0] == 0 else low
            high = None if share[1] == 1 else high
            before = F.lit(False) if low is None else key.isNull() | (key < F.lit(low))
            inside = ~before & (F.lit(True) if high is None else key.isNull() | (key <= F.lit(high)))
            counts = df.agg(F.count(F.when(before, 1)).alias("b"), F.count(F.when(inside, 1)).alias("i")).first()
            if counts.b <= start and (counts.b + counts.i >= min(stop, total)):
                placed = positions(df.where(inside), *order, name="_pos")
                return placed.where((F.col("_pos") >= start - counts.b) & (F.col("_pos") < stop - counts.b)).drop("_pos")
    placed = positions(df, *order, name="_pos")
    return placed.where((F.col("_pos") >= start) & (F.col("_pos") < stop)).drop("_pos")


def prefix(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by ``order``: a top-k, or for more than ``TOP_K`` rows the stretch from the beginning. Fewer rows give all, n <= 0 none."""
    return df.orderBy(*order).limit(max(0, n)) if n <= TOP_K else between(df, 0, n, *order)


def eval_split(df: DataFrame, *order: str, share: float = 0.03) -> DataFrame:
    """The first int(rows * share) rows by ``order``."""
    total = df.count()
    return between(df, 0, int(total * share), *order, total=total)


def iteration_slice(df: DataFrame, iteration: int, size: int, *order: str) -> DataFrame:
    """Rows at positions [iteration * size, (iteration + 1) * size)."""
    return between(df, iteration * size, (iteration + 1) * size, *order)


def split_or_whole(splits: dict[str, DataFrame], wanted: str, n: int | None, *order: str) -> DataFrame:
    """The wanted split, or the only table where that split is missing, cut to its first ``n`` rows. Without both it raises."""
    if wanted not in splits and len(splits) != 1:
        raise ValueError(f"no split {wanted!r} among {', '.join(sorted(splits))}")
    own = splits.get(wanted) if wanted in splits else next(iter(splits.values()))
    return own if n is None else prefix(own, n, *order)


def scattered(key: Column, seed: int) -> Column:
    """A seeded order key of plain arithmetic, the same in any engine: a multiplicative hash modulo 2**31 - 1."""
    return F.pmod((key + seed) * F.lit(48271), F.lit(2147483647))


def shuffled_batches(df: DataFrame, key: str, seed: int, size: int, drop_last: bool = True) -> DataFrame:
    """``df`` with ``batch``: rows in hashed order, cut into batches of ``size``; the last, partial batch is dropped on request."""
    placed = positions(df.withColumn("_h", scattered(F.col(key), seed)), "_h", key, name="_pos").drop("_h")
    out = placed.withColumn("batch", F.floor(F.col("_pos") / size).cast("bigint"))
    if drop_last:
        total = placed.agg(F.floor(F.count("*") / F.lit(size)).alias("_full"))
        out = out.crossJoin(F.broadcast(total)).where(F.col("batch") < F.col("_full")).drop("_full")
    return out.drop("_pos")


def sample_rows(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows, uniformly by hash of a unique key, without replacement: a top-k."""
    return df.orderBy(scattered(F.col(key), seed), key).limit(max(0, k))


def expand(df: DataFrame, n: int, name: str = "k") -> DataFrame:
    """Every row n times, numbered 0..n-1; none for n <= 0."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.withColumn(name, F.lit(0)).where(F.lit(False))


def expand_contrast(df: DataFrame, n: int, prompt: str, task: str, suffix: str = "<think>\n\n</think>\n") -> DataFrame:
    """n samples a prompt; for tasks that start with ifeval or complex the last quarter gets an empty-thinking prompt. n must divide by 4."""
    if n % 4:
        raise ValueError("n must be divisible by 4")
    tasked = F.coalesce(F.col(task).startswith("ifeval") | F.col(task).startswith("complex"), F.lit(False))
    bare = F.regexp_replace(F.col(prompt), r"<think>\n*$", "")
    out = expand(df, n)
    contrast = tasked & (F.col("k") >= n * 3 // 4)
    return out.withColumn("reasoning", ~contrast).withColumn(prompt, F.when(contrast, F.concat(bare, F.lit(suffix))).otherwise(F.col(prompt)))


def shard(df: DataFrame, position: str, replicas: int, total: Column | int, pad: bool = True, consumed: int = 0) -> DataFrame:
    """``rank`` and ``turn`` of every row: position modulo and divided by replicas. Padding repeats rows from the head until all ranks
    have equally many; without it the uneven tail is dropped. The first ``consumed // replicas`` turns of every rank are skipped."""
    total = F.lit(total) if isinstance(total, int) else total
    row = df.select("*", F.pmod(F.col(position), F.lit(replicas)).cast("int").alias("rank"), F.floor(F.col(position) / replicas).cast("bigint").alias("turn"), F.lit(False).alias("padded"))
    each = F.ceil(total / replicas) if pad else F.floor(total / replicas)
    skipped = consumed // replicas
    if not pad:
        return row.where((F.col("turn") < each) & (F.col("turn") >= skipped))
    missing = each * replicas - total
    at = total + F.col(position)
    head = df.where(F.col(position) < missing).select("*", F.pmod(at, F.lit(replicas)).cast("int").alias("rank"), F.floor(at / replicas).cast("bigint").alias("turn"), F.lit(True).alias("padded"))
    return row.unionByName(head).where(F.col("turn") >= skipped)


def contiguous(position: Column, total: Column | int, parts: int) -> Column:
    """The engine of a row when engines take contiguous slices of ceil(total / parts) rows."""
    total = F.lit(total) if isinstance(total, int) else total
    return F.floor(position / F.ceil(total / parts)).cast("int")


def even_parts(position: Column, total: Column | int, most: int = 256) -> Column:
    """The bucket of a row in an even split into at most ``most`` buckets; the first total % buckets have one row more."""
    total = F.lit(total).cast("bigint") if isinstance(total, int) else total
    parts = F.least(total, F.lit(most))
    small, extra = F.floor(total / parts), F.pmod(total, parts)
    border = extra * (small + 1)
    return F.when(position < border, F.floor(position / (small + 1))).otherwise(extra + F.floor((position - border) / small)).cast("int")
