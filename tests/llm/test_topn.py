"""Best rows of every group against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rollmill.llm.topn import top_n_per_group

SCHEMA = "g string, t bigint, s double, rank string, _word int"


def brute(rows, n):
    groups = {}
    for g, t, s in rows:
        if g is not None and t is not None and s is not None and math.isfinite(s):
            groups.setdefault(g, {})[t] = max(s + 0.0, groups.get(g, {}).get(t, -math.inf))
    return {(g, t, k) for g, r in groups.items() for k, (t, s) in enumerate(sorted(r.items(), key=lambda x: (-x[1], x[0]))[:n], 1)}


@pytest.mark.parametrize("n, per_log, slots, most", [(1, 64, 1 << 10, 100), (4, 64, 1 << 10, 100), (4, 2, 4, 1), (40, 64, 8, 3)])
def test_matches_brute_force(spark, n, per_log, slots, most):
    rng = random.Random(5)
    rows = [(rng.choice("abc") if i % 3 else "hot", rng.randrange(700), None) for i in range(3000)]
    score = {}
    rows = [(g, t, score.setdefault((g, t), rng.choice([0.0, -0.0, 1.0, 2.5, -7.0, 1e300, rng.random()]))) for g, t, _ in rows]
    rows += [(None, 1, 1.0), ("a", None, 1.0), ("a", 9001, None), ("a", 9002, float("nan")), ("a", 9003, float("inf")), ("A", 1, 1.0), ("a ", 2, 1.0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = {(r.g, r.t, r["rank"]) for r in top_n_per_group(df, "g", "s", "t", n, per_log, slots, most).collect()}
    assert got == brute(rows, n)


def test_empty_table_and_bad_n(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_n_per_group(df, "g", "s", "t", 3).count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, "g", "s", "t", 0)


def test_all_tied_in_one_huge_group(spark):
    df = spark.range(20000).select(F.lit("g").alias("g"), F.col("id").alias("t"), F.lit(1.0).alias("s"))
    assert sorted(r.t for r in top_n_per_group(df, "g", "s", "t", 4).collect()) == [0, 1, 2, 3]
