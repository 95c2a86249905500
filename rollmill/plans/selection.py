"""Queries over scored samples: selection per prompt and global reward statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.operators import postprocess
from rollmill.plans.tables import table


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "scored_samples").where(F.col("input").isNotNull() & F.col("output").isNotNull())


def rejection_sampling(spark: SparkSession, folder: str) -> DataFrame:
    return postprocess.best_of_n(_samples(spark, folder)).select("input", "output", "seq", "reward")


QUERIES = {"rejection_sampling": rejection_sampling}
SQL = {
    "rejection_sampling": """
        SELECT input, output, seq, reward FROM scored_samples
        WHERE input IS NOT NULL AND output IS NOT NULL AND reward IS NOT NULL AND NOT isnan(reward)
        QUALIFY row_number() OVER (PARTITION BY input ORDER BY reward DESC, seq) = 1
    """,
}
