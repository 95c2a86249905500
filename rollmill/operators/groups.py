"""Group estimators over sampled answers: baselines, normalisation, contrast filter, status aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_of(position: Column, n: int, total: Column | int | None = None) -> Column:
    """The group of n consecutive rows that a position belongs to. With ``total``, a number of rows that n doesn't divide is an error."""
    group = F.floor(position / n).cast("bigint")
    if total is None:
        return group
    total = F.lit(total) if isinstance(total, int) else total
    return F.when(F.pmod(total, F.lit(n)) == 0, group).otherwise(F.raise_error(F.concat(F.lit(f"not divisible by {n}: "), total.cast("string"))).cast("bigint"))


def leave_one_out(reward: str, group: str) -> Column:
    """reward - mean of the other rewards of the group; NULL in a group of one."""
    w = Window.partitionBy(group)
    return F.col(reward) - F.try_divide(F.sum(reward).over(w) - F.col(reward), F.count(reward).over(w) - 1)


def centred(reward: str, group: str) -> Column:
    """reward - group mean."""
    return F.col(reward) - F.avg(reward).over(Window.partitionBy(group))


def group_normalised(reward: str, group: str, eps: float = 1e-9) -> Column:
    """(reward - group mean) / (sample deviation + eps); NULL in a group of one."""
    w = Window.partitionBy(group)
    return (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_samp(reward).over(w) + eps)


#: Advantage estimators by name.
ESTIMATORS = {"rloo": leave_one_out, "reinforce_baseline": centred, "group_norm": group_normalised, "reinforce": lambda reward, group: F.col(reward)}


NO_REASONING = "<think>\n\n</think>\n"


def prompt_key(prompt: Column) -> Column:
    """The prompt without its thinking suffix, whichever of the known ones it has."""
    bare = F.when(prompt.endswith(NO_REASONING), F.substring(prompt, F.lit(1), F.length(prompt) - len(NO_REASONING)))
    for suffix in ("<think>\n\n", "<think>\n", "<think>"):
        bare = F.coalesce(bare, F.when(prompt.endswith(suffix), F.substring(prompt, F.lit(1), F.length(prompt) - len(suffix))))
    return F.coalesce(bare, prompt)


def superior_filter(df: DataFrame, prompt: str = "prompt", reward: str = "reward", flag: str = "superior") -> DataFrame:
    """``df`` with ``kept``: the flag, switched off where reasoning doesn't pay.

    By prompt without suffix: if a key has samples with reasoning, its samples without get False; if it has both, the best reward with
    reasoning is below the worst without, and the rewards with reasoning aren't all equal, those get False too. Keys with only one kind
    keep their flags. NULL rewards don't count. One row a key is aggregated (combined before its shuffle) and joined back, so a key that holds
    a large part of the table is never gathered. NULL prompts share a key.
    """
    key = prompt_key(F.col(prompt))
    rows = df.withColumn("_key", key).withColumn("_plain", F.coalesce(F.col(prompt).endswith(NO_REASONING), F.lit(False)))
    with_, without = F.when(~F.col("_plain"), F.col(reward)), F.when(F.col("_plain"), F.col(reward))
    n_with = F.count(F.when(~F.col("_plain"), 1)).alias("_n_with")
    keys = rows.groupBy("_key").agg(n_with, F.max(with_).alias("_best"), F.min(with_).alias("_least"), F.min(without).alias("_bare"))
    fails = F.coalesce((F.col("_best") < F.col("_bare")) & (F.col("_least") != F.col("_best")), F.lit(False))
    keys = keys.select(F.col("_key").alias("_k"), (F.col("_n_with") > 0).alias("_reasoned"), fails.alias("_fails"))
    joined = rows.join(keys, F.col("_key").eqNullSafe(F.col("_k")))
    off = (F.col("_plain") & F.col("_reasoned")) | (~F.col("_plain") & F.col("_fails"))
    return joined.withColumn("kept", F.when(off, F.lit(False)).otherwise(F.col(flag))).drop("_key", "_k", "_plain", "_reasoned", "_fails")


def cyclic_pairs(df: DataFrame, batch: str, order: str, response: str, out: str) -> DataFrame:
    """``df`` with the response of the next row of its batch; the last row gets the first one's. Batches are small by construction."""
    w = Window.partitionBy(batch).orderBy(order)
    first = F.first(response).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.row_number().over(w) == F.count("*").over(Window.partitionBy(batch))
    return df.withColumn(out, F.when(last, first).otherwise(F.lead(response, 1).over(w)))
