"""Weighted interleaving of sources by a parallel, reproducible rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.operators.order import positions


def blend(sources: list[DataFrame], weights: list[float], order: str, stop: str = "first_exhausted", max_count: int = 5_000_000) -> DataFrame:
    """All sources in one table with ``source_no``, ``turn`` (its row in the source) and ``rank`` (a sort key of the interleaving).

    Row i of a source with weight p comes at time (i + 1/2) / p, so every stretch of the result holds the sources in proportion. With
    ``first_exhausted`` the result ends where the first source does; with ``all_exhausted`` shorter sources start over until the last
    one ends. Each source is cut to its first ``max_count`` rows by ``order`` (a unique key) beforehand. Deterministic, unlike seeded
    draws, whose proportions it shares. Weights must be positive and as many as sources; they are scaled to sum 1.
    """
    if len(sources) != len(weights) or not sources:
        raise ValueError("as many weights as sources are needed")
    if any(w <= 0 for w in weights) or stop not in ("first_exhausted", "all_exhausted"):
        raise ValueError("weights must be positive, stop one of first_exhausted and all_exhausted")
    shares = [w / sum(weights) for w in weights]
    every = reduce(DataFrame.unionByName, [s.withColumn("source_no", F.lit(no)) for no, s in enumerate(sources)])
    placed = positions(every, "source_no", order, name="_pos")  # one pass for all sources
    known = {r.source_no: (r.base, min(r.n, max_count)) for r in placed.groupBy("source_no").agg(F.min("_pos").alias("base"), F.count("*").alias("n")).collect()}  # one row a source
    base, counts = zip(*[known.get(no, (0, 0)) for no in range(len(sources))])
    ends = [n / p for n, p in zip(counts, shares)]
    until = min(ends) if stop == "first_exhausted" else max(ends)
    rounds = [1 if stop == "first_exhausted" or not n else max(1, int(-(-(until * p) // n))) for n, p in zip(counts, shares)]
    numbers = F.array(*[F.struct(F.lit(b).alias("base"), F.lit(n).alias("n"), F.lit(p).alias("p"), F.lit(r).alias("rounds")) for b, n, p, r in zip(base, counts, shares, rounds)])
    own = placed.withColumn("_s", F.get(numbers, F.col("source_no"))).withColumn("turn", F.col("_pos") - F.col("_s.base")).where(F.col("turn") < max_count)
    again = own.withColumn("_round", F.explode(F.sequence(F.lit(0), F.col("_s.rounds") - 1))).withColumn("_i", F.col("_round") * F.col("_s.n") + F.col("turn"))
    timed = again.withColumn("rank", (F.col("_i") + 0.5) / F.col("_s.p")).where(F.col("_i") + 0.5 < F.lit(until) * F.col("_s.p"))
    return timed.drop("_i", "_round", "_s", "_pos")
