"""Post-processors of scored samples: best of N, chosen and rejected, reward-conditioned rows, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def comparable(reward: str) -> Column:
    """The reward, with NaN as NULL: a comparison with NaN never holds, so such a sample is never best or worst."""
    return F.when(~F.isnan(reward), F.col(reward))


def best_of_n(df: DataFrame, key: str = "input", value: str = "output", reward: str = "reward", order: str = "seq") -> DataFrame:
    """Per key the row of highest reward, the first by ``order`` on ties.

    One aggregate, combined before its shuffle. Its state is a struct with text, so the engine sorts for it; nothing is ranked or gathered.

    Null keys form a group of their own; a group whose rewards are all NULL or NaN gives no row.
    """
    r = comparable(reward)
    rows = df.select(F.col(key), F.col(value), F.col(order), r.alias(reward)).where(F.col(reward).isNotNull())
    return rows.groupBy(key).agg(F.max_by(F.struct(value, reward, order), F.struct(F.col(reward), -F.col(order))).alias("best")).select(key, *[F.col(f"best.{c}").alias(c) for c in (value, reward, order)])


def chosen_rejected(df: DataFrame, key: str = "input", value: str = "output", reward: str = "reward", order: str = "seq") -> DataFrame:
    """Per key the best row as chosen and the worst as rejected (first wins both ties; a single row is both)."""
    r = comparable(reward)
    rows = df.select(F.col(key).alias("prompt"), F.col(value).alias("v"), F.col(order).alias("o"), r.alias("r")).where(F.col("r").isNotNull())
    pair = F.struct("v", "r")
    return (
        rows.groupBy("prompt")
        .agg(F.max_by(pair, F.struct(F.col("r"), -F.col("o"))).alias("c"), F.min_by(pair, F.struct(F.col("r"), F.col("o"))).alias("j"))
        .select("prompt", F.col("c.v").alias("chosen"), F.col("c.r").alias("chosen_reward"), F.col("j.v").alias("rejected"), F.col("j.r").alias("rejected_reward"))
    )


def normalised_reward(df: DataFrame, reward: str = "reward", out: str = "reward") -> DataFrame:
    """Global z-score with the sample deviation: one aggregate row, joined back by broadcast (no window over everything).

    NULL, NaN and infinite rewards give NULL and don't count; so does a deviation of zero or of a single row.
    """
    value = F.when(~F.isnan(reward) & (F.abs(F.col(reward)) < F.lit(float("inf"))), F.col(reward))
    stats = df.select(value.alias("_r")).agg(F.avg("_r").alias("_mean"), F.stddev_samp("_r").alias("_std"))
    return df.withColumn("_value", value).crossJoin(F.broadcast(stats)).withColumn(out, F.try_divide(F.col("_value") - F.col("_mean"), "_std")).drop("_value", "_mean", "_std")


def reward_report(df: DataFrame, reward: str = "reward") -> DataFrame:
    """Count, mean and sample deviation of the finite rewards, as one row."""
    value = F.when(~F.isnan(reward) & (F.abs(F.col(reward)) < F.lit(float("inf"))), F.col(reward))
    return df.select(value.alias("r")).agg(F.count("r").alias("n"), F.avg("r").alias("mean_reward"), F.stddev_samp("r").alias("std_reward"))


def two_decimals(value: Column) -> Column:
    """A number with two decimals, rounded as the exact binary value demands."""
    return F.replace(F.format_number(value, 2), F.lit(","), F.lit(""))


def reward_conditioned(df: DataFrame, template: str, input: str = "input", output: str = "output", reward: str = "reward") -> DataFrame:
    """Rows of (input, output): the template with ``{reward}`` and then ``{input}`` filled in. Both placeholders are required."""
    if "{input}" not in template or "{reward}" not in template:
        raise ValueError("the template needs {input} and {reward}")
    filled = F.replace(F.replace(F.lit(template), F.lit("{reward}"), two_decimals(F.col(reward))), F.lit("{input}"), F.col(input))
    return df.select(filled.alias("input"), F.col(output).alias("output"), *[c for c in df.columns if c not in (input, output, reward)])


#: Post-processors by name.
PROCESSORS = {
    "rs": lambda df, **kw: best_of_n(df, **kw),
    "iter_dpo": lambda df, **kw: chosen_rejected(df, **kw),
    "csft": lambda df, template="{input} {reward} ", **kw: reward_conditioned(normalised_reward(df), template, **kw),
}


def processor(name: str):
    """The post-processor of that name; unknown names raise."""
    if name not in PROCESSORS:
        raise ValueError(f"unknown processor {name!r}; known: {', '.join(sorted(PROCESSORS))}")
    return PROCESSORS[name]
