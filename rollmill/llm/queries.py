"""The problem queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.llm import leak, mixing, neardup, packing, pairs, subjects, tokens, topn
from rollmill.plans.store import written
from rollmill.plans.tables import table

#: The budgets of the budgeted mixes lie halfway from exact targets to the most that any exponent allows.
REACH = 0.5
#: The other mixes may be so far, in proportion, from their targets.
TOLERANCE = 0.02
#: Problem 1 asks for the best four answers of each prompt.
BEST = 4


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """``seq`` of the best four answers of every prompt."""
    rows = table(spark, folder, "scored_samples").where(F.col("output").isNotNull())
    return topn.top_n_per_group(rows, "input", "reward", "seq", BEST).select("seq")


def p1_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The best four answers of every prompt with their rewards and ranks."""
    rows = table(spark, folder, "scored_samples").where(F.col("output").isNotNull())
    return topn.top_n_per_group(rows, "input", "reward", "seq", BEST)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of prompts of one near-duplicate group."""
    return neardup.near_duplicate_pairs(table(spark, folder, "box_prompts"), "seq", "input", 0.75)


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per prompt with its class, group and number of links."""
    return neardup.near_duplicates(table(spark, folder, "box_prompts"), "seq", "input", 0.75)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts with the evaluation items that they quote."""
    return leak.find_leaks(table(spark, folder, "box_prompts"), "seq", "input", table(spark, folder, "eval_items"), "item_id", "text")


def p3_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every evaluation item with the number of prompts that quote it."""
    items = table(spark, folder, "eval_items").select("item_id", "suite")
    return items.join(F.broadcast(p3_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("c"))), "item_id", "left").select("item_id", "suite", F.coalesce("c", F.lit(0).cast("bigint")).alias("n_prompts"))


def _flags(spark: SparkSession, folder: str) -> DataFrame:
    fields = pairs.pair_fields(table(spark, folder, "sft_pairs"), table(spark, folder, "preference_pairs"))
    return pairs.flag_pairs(fields, ["tab", "seq", "field"], "prompt", "answer")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective answers, each with the first rule that applied."""
    return _flags(spark, folder).where(F.col("place") == 1).select("tab", "seq", "field", "defect")


def p4_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Defective answers with every rule that applied."""
    return _flags(spark, folder)


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return written(tokens.token_sizes(table(spark, folder, "documents"), ["doc_id"], "text"), "tokens")


def p5_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document (or piece of one that exceeds the capacity) with its container, for every kind of container."""
    return packing.pack(_sizes(spark, folder), "doc_id", "n_tokens", table(spark, folder, "containers"))


def p5_fill(spark: SparkSession, folder: str) -> DataFrame:
    """By kind: containers of the first assignment, after the search, and needed at least; tokens placed and share of the space used."""
    kinds = table(spark, folder, "containers")
    placed = packing.pack_with_first(_sizes(spark, folder), "doc_id", "n_tokens", kinds)
    held = placed.groupBy("kind", "container").agg(F.sum("n_tokens").alias("n"))
    after = held.groupBy("kind").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
    first = placed.groupBy("kind", "first_container").agg(F.count("*")).groupBy("kind").agg(F.count("*").alias("n_first"))
    by_kind = after.join(first, "kind").join(kinds, "kind")
    least = F.ceil(F.col("n_tokens") / F.col("capacity")).alias("n_least")
    used = (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("used_share")
    return by_kind.select("kind", "capacity", "n_first", "n_containers", least, "n_tokens", "fullest", used)


def _mixes(spark: SparkSession, folder: str, reach: float = 0.0) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, folder, "mix_targets")
    listed = mixing.of_listed(table(spark, folder, "documents"), targets)  # others aren't even tokenised
    return mixing.mix_sources(tokens.token_sizes(listed, ["doc_id", "source"], "text"), "doc_id", targets, reach=reach, tolerance=TOLERANCE)


def p6_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Uses of documents in every mix, with shares within the tolerance of the targets."""
    return _mixes(spark, folder)[0]


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of every source of every mix, with the exponent."""
    return _mixes(spark, folder)[1]


def p6_budgeted(spark: SparkSession, folder: str) -> DataFrame:
    """Uses of documents in every mix, with budgets beyond those of the tolerance, so that shares give way to size."""
    return _mixes(spark, folder, REACH)[0]


def p6_budgeted_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of every source of every budgeted mix."""
    return _mixes(spark, folder, REACH)[1]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's subjects with the share of its sentences."""
    return subjects.subject_shares(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "subjects"), table(spark, folder, "subject_labels"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the subjects that at least a quarter of their sentences treat."""
    return p7_shares(spark, folder).where(F.col("n_sentences") * 4 >= F.col("of_sentences")).select("doc_id", "subject")


def p7_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and sentences by subject."""
    return p7_shares(spark, folder).groupBy("subject").agg(F.count(F.when(F.col("n_sentences") * 4 >= F.col("of_sentences"), 1)).alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_ranked": p1_ranked,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_items": p3_items,
    "p4_found": p4_found,
    "p4_flags": p4_flags,
    "p5_packed": p5_packed,
    "p5_fill": p5_fill,
    "p6_mixed": p6_mixed,
    "p6_shares": p6_shares,
    "p6_budgeted": p6_budgeted,
    "p6_budgeted_shares": p6_budgeted_shares,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p7_composition": p7_composition,
}

_P1 = """
WITH rows AS (
    SELECT seq, any_value(input) AS input, max(reward) AS reward FROM scored_samples
    WHERE seq IS NOT NULL AND input IS NOT NULL AND output IS NOT NULL AND reward IS NOT NULL AND isfinite(reward)
    GROUP BY seq
), ranked AS (
    SELECT input, seq, reward, row_number() OVER (PARTITION BY input ORDER BY reward DESC, seq) AS rank FROM rows
)
"""

SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT seq FROM ranked WHERE rank <= 4",
    "p1_ranked": _P1 + "SELECT input, seq, reward, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 4",
}
