"""Queries on order, shards, expansions and group estimators, over the events table (event_id is dense)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollmill.functions.rewards import combined
from rollmill.operators import groups, order, postprocess, shape
from rollmill.plans.tables import table

N = 8


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "user_id", F.col("value").alias("reward"), groups.group_of(F.col("event_id"), N).alias("gid"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct scored samples, as prompts."""
    return table(spark, folder, "box_prompts")


def rloo_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select("event_id", F.round(groups.leave_one_out("reward", "gid"), 6).alias("advantage"))


def reinforce_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select("event_id", F.round(groups.centred("reward", "gid"), 6).alias("advantage"))


def group_norm(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select("event_id", F.round(groups.group_normalised("reward", "gid"), 6).alias("advantage"))


def positional_groups(spark: SparkSession, folder: str) -> DataFrame:
    placed = order.positions(table(spark, folder, "sft_pairs").select("seq"), "seq")
    return placed.groupBy(groups.group_of(F.col("pos"), N).alias("gid")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def sample_expansion(spark: SparkSession, folder: str) -> DataFrame:
    return order.expand(table(spark, folder, "box_prompts").select("seq"), 4).select("seq", "k", (F.col("seq") * 4 + F.col("k")).alias("sample_id"))


def contrast_expansion(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "box_prompts").where(F.col("input").isNotNull()).select("seq", "task", F.concat("input", F.lit("<think>\n")).alias("prompt"))
    return order.expand_contrast(rows, 8, "prompt", "task").groupBy("seq", "reasoning").agg(F.count("*").alias("n"), F.max(F.length("prompt")).alias("longest"))


def best_of_n_expansion(spark: SparkSession, folder: str) -> DataFrame:
    rows = order.expand(table(spark, folder, "box_prompts").select("seq"), 3)
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum"))


def modulo_shard(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", "value")
    total = rows.agg(F.count("*").alias("total"))
    both = rows.crossJoin(F.broadcast(total))
    return order.shard(both, "event_id", 7, F.col("total")).groupBy("rank").agg(F.count("*").alias("n"), F.sum(F.col("padded").cast("bigint")).alias("n_padded"), F.max("turn").alias("last_turn"), F.sum("event_id").alias("id_sum"))


def engine_slices(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id")
    both = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))
    part, bucket = order.contiguous(F.col("event_id"), F.col("total"), 6), order.even_parts(F.col("event_id"), F.col("total"), 256)
    return both.groupBy(part.alias("engine"), bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def micro_batches(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).groupBy(F.floor(F.col("event_id") / 32).cast("bigint").alias("batch")).agg(F.count("*").alias("n"), F.round(F.sum("reward"), 4).alias("reward_sum"))


def shuffled_minibatches(spark: SparkSession, folder: str) -> DataFrame:
    rows = order.shuffled_batches(table(spark, folder, "sft_pairs").select("seq"), "seq", 42, 64)
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum"))


def buffer_sample(spark: SparkSession, folder: str) -> DataFrame:
    return order.sample_rows(table(spark, folder, "events").select("event_id"), "event_id", 100, 7)


def prefix_limit(spark: SparkSession, folder: str) -> DataFrame:
    return order.prefix(table(spark, folder, "sft_pairs").select("seq", "prompt_len"), 500, "seq")


def eval_split(spark: SparkSession, folder: str) -> DataFrame:
    return order.eval_split(table(spark, folder, "sft_pairs").select("seq", "prompt_len"), "seq")


def iter_slice(spark: SparkSession, folder: str) -> DataFrame:
    return order.iteration_slice(table(spark, folder, "sft_pairs").select("seq", "prompt_len"), 2, 100, "seq")


def superior_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("user "), F.col("user_id").cast("string"), F.when(F.pmod("event_id", F.lit(4)) == 3, F.lit(groups.NO_REASONING)).otherwise(F.lit("<think>\n"))).alias("prompt"),
        (F.col("value") - F.when(F.pmod("event_id", F.lit(4)) == 3, 0).otherwise(F.pmod("user_id", F.lit(50)))).alias("reward"), F.lit(True).alias("superior"),
    )
    return groups.superior_filter(rows).select("event_id", "kept")


def keep_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return superior_filter(spark, folder).groupBy((F.col("event_id") % 10).alias("step")).agg(F.round(F.avg(F.col("kept").cast("double")), 6).alias("keep_ratio"))


def status_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of step means; the KL of a step is weighted by response length."""
    rows = table(spark, folder, "events").select((F.col("event_id") % 16).alias("step"), F.col("value").alias("kl"), (1 + F.pmod("user_id", F.lit(20))).alias("length"))
    steps = rows.groupBy("step").agg(F.try_divide(F.sum(F.col("kl") * F.col("length")), F.sum("length")).alias("kl"), F.avg("kl").alias("plain"))
    return steps.agg(F.round(F.avg("kl"), 6).alias("kl_mean"), F.round(F.avg("plain"), 6).alias("plain_mean"), F.count("*").alias("n_steps"))


def kto_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sft_pairs").select("seq", F.floor(F.col("seq") / 16).alias("batch"), F.length("response").alias("len"))
    return groups.cyclic_pairs(rows, "batch", "seq", "len", "kl_len").select("seq", "batch", "len", "kl_len", F.lit(-1).alias("label"))


def sum_reward_models(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "preference_pairs").where(F.col("chosen").isNotNull() & F.col("rejected").isNotNull())
    models = [F.length("chosen").cast("double"), F.length("rejected").cast("double"), F.coalesce("margin", F.lit(0.0))]
    return rows.select("seq", F.round(combined(models, [1.0, 0.5, 1.0]), 6).alias("reward"))


def reward_zscore(spark: SparkSession, folder: str) -> DataFrame:
    return postprocess.normalised_reward(table(spark, folder, "scored_samples").select("seq", "reward")).select("seq", F.round("reward", 6).alias("reward"))


def reward_stats(spark: SparkSession, folder: str) -> DataFrame:
    r = postprocess.reward_report(table(spark, folder, "scored_samples"))
    return r.select("n", F.round("mean_reward", 6).alias("mean_reward"), F.round("std_reward", 6).alias("std_reward"))


def iterative_dpo(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "scored_samples").where(F.col("input").isNotNull() & F.col("output").isNotNull())
    return postprocess.chosen_rejected(rows)


def conditional_sft(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "scored_samples").where(F.col("input").isNotNull() & F.col("reward").isNotNull() & ~F.isnan("reward") & (F.abs("reward") < 1e9))
    return postprocess.reward_conditioned(rows.select("seq", "input", "output", "reward"), "{input} <score: {reward}>").distinct()


def csft_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sft_pairs").where(F.col("prompt").isNotNull()).select("seq", shape.inference_prompt(F.col("prompt"), " <score: 5.00>\n").alias("prompt"))


def reward_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Ten bins over [-10, 10], the last one closed; shares of the values inside."""
    value = table(spark, folder, "scored_samples").where((F.col("reward") >= -10) & (F.col("reward") <= 10) & ~F.isnan("reward")).select("reward")
    bins = value.groupBy(F.least(F.floor((F.col("reward") + 10) / 2), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return bins.crossJoin(F.broadcast(bins.agg(F.sum("n").alias("total")))).select("bin", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def rm_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy as the mean of batch means, loss likewise, and the deviation bounded from below."""
    rows = table(spark, folder, "preference_pairs").where(F.col("chosen").isNotNull() & F.col("rejected").isNotNull())
    r = rows.select(F.floor(F.col("seq") / 8).alias("batch"), (F.length("chosen") / 100.0).alias("c"), (F.length("rejected") / 100.0).alias("j"), F.coalesce("margin", F.lit(0.0)).alias("m"))
    x = F.col("c") - F.col("j") - F.col("m")
    loss = F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    steps = r.groupBy("batch").agg(F.avg((F.col("c") > F.col("j")).cast("double")).alias("acc"), F.avg(loss).alias("loss"), F.avg("c").alias("mean"))
    return steps.agg(F.round(F.avg("acc"), 6).alias("acc_mean"), F.round(F.avg("loss"), 6).alias("loss_mean"), F.round(F.avg("mean"), 6).alias("reward_mean"), F.round(F.greatest(F.stddev_samp("mean"), F.lit(1e-8)), 6).alias("reward_std"))


QUERIES = {
    f.__name__: f
    for f in (
        rloo_baseline, reinforce_baseline, group_norm, positional_groups, sample_expansion, contrast_expansion, best_of_n_expansion, modulo_shard, engine_slices, micro_batches,
        shuffled_minibatches, buffer_sample, prefix_limit, eval_split, iter_slice, superior_filter, keep_ratio, status_aggregate, kto_pairs, sum_reward_models, reward_zscore,
        reward_stats, iterative_dpo, conditional_sft, csft_suffix, reward_histogram, rm_evaluation,
    )
}

_EVENTS = "WITH e AS (SELECT event_id, value AS reward, event_id // 8 AS gid FROM events)"
_SUPERIOR = """
    WITH e AS (
        SELECT event_id, user_id AS key, event_id % 4 = 3 AS bare, value - CASE WHEN event_id % 4 = 3 THEN 0 ELSE user_id % 50 END AS reward FROM events
    ), k AS (
        SELECT key, max(reward) FILTER (NOT bare) AS most, min(reward) FILTER (NOT bare) AS least, min(reward) FILTER (bare) AS other, count(*) FILTER (NOT bare) AS n FROM e GROUP BY key
    ), f AS (
        SELECT event_id, CASE WHEN bare AND n > 0 THEN FALSE WHEN NOT bare AND coalesce(most < other AND least <> most, FALSE) THEN FALSE ELSE TRUE END AS kept FROM e JOIN k USING (key)
    )
"""
_FINITE = "CASE WHEN isfinite(reward) THEN reward END"
SQL = {
    "rloo_baseline": f"{_EVENTS} SELECT event_id, round(reward - (sum(reward) OVER (PARTITION BY gid) - reward) / nullif(count(reward) OVER (PARTITION BY gid) - 1, 0), 6) AS advantage FROM e",
    "reinforce_baseline": f"{_EVENTS} SELECT event_id, round(reward - avg(reward) OVER (PARTITION BY gid), 6) AS advantage FROM e",
    "group_norm": f"{_EVENTS} SELECT event_id, round((reward - (avg(reward) OVER w)) / ((stddev_samp(reward) OVER w) + 1e-9), 6) AS advantage FROM e WINDOW w AS (PARTITION BY gid)",
    "positional_groups": "WITH p AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS pos FROM sft_pairs) SELECT pos // 8 AS gid, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM p GROUP BY 1",
    "sample_expansion": "SELECT seq, CAST(k AS INTEGER) AS k, seq * 4 + k AS sample_id FROM box_prompts, range(4) r(k)",
    "contrast_expansion": """
        SELECT seq, NOT (coalesce(task LIKE 'ifeval%' OR task LIKE 'complex%', FALSE) AND k >= 6) AS reasoning, count(*) AS n,
               CAST(max(length(input) + CASE WHEN coalesce(task LIKE 'ifeval%' OR task LIKE 'complex%', FALSE) AND k >= 6 THEN 18 ELSE 8 END) AS INTEGER) AS longest
        FROM (SELECT seq, task, regexp_replace(input, '<think>\\n*$', '') AS bare, input FROM box_prompts WHERE input IS NOT NULL), range(8) r(k) GROUP BY 1, 2
    """,
    "best_of_n_expansion": "SELECT CAST(k AS INTEGER) AS k, count(*) AS n, sum(seq)::BIGINT AS seq_sum FROM box_prompts, range(3) r(k) GROUP BY 1",
    "modulo_shard": """
        WITH t AS (SELECT count(*) AS total, CAST(ceil(count(*) / 7.0) AS BIGINT) AS each FROM events),
        r AS (SELECT event_id, event_id AS spot, 0 AS padded FROM events UNION ALL SELECT event_id, event_id + total, 1 FROM events, t WHERE event_id < each * 7 - total)
        SELECT CAST(spot % 7 AS INTEGER) AS rank, count(*) AS n, sum(padded)::BIGINT AS n_padded, max(spot // 7) AS last_turn, sum(event_id)::BIGINT AS id_sum FROM r GROUP BY 1
    """,
    "engine_slices": """
        WITH t AS (SELECT count(*) AS total FROM events), p AS (SELECT total, least(total, 256) AS parts FROM t), b AS (SELECT total, parts, total // parts AS small, total % parts AS extra FROM p)
        SELECT CAST(event_id // CAST(ceil(total / 6.0) AS BIGINT) AS INTEGER) AS engine,
               CAST(CASE WHEN event_id < extra * (small + 1) THEN event_id // (small + 1) ELSE extra + (event_id - extra * (small + 1)) // small END AS INTEGER) AS bucket, count(*) AS n, min(event_id) AS first_id
        FROM events, b GROUP BY 1, 2
    """,
    "micro_batches": "SELECT event_id // 32 AS batch, count(*) AS n, round(sum(value), 4) AS reward_sum FROM events GROUP BY 1",
    "shuffled_minibatches": """
        WITH p AS (SELECT seq, row_number() OVER (ORDER BY ((seq + 42) * 48271) % 2147483647, seq) - 1 AS pos, count(*) OVER () AS total FROM sft_pairs)
        SELECT pos // 64 AS batch, count(*) AS n, sum(seq)::BIGINT AS seq_sum FROM p WHERE pos // 64 < total // 64 GROUP BY 1
    """,
    "buffer_sample": "SELECT event_id FROM events ORDER BY ((event_id + 7) * 48271) % 2147483647, event_id LIMIT 100",
    "prefix_limit": "SELECT seq, prompt_len FROM sft_pairs ORDER BY seq LIMIT 500",
    "eval_split": "SELECT seq, prompt_len FROM sft_pairs QUALIFY row_number() OVER (ORDER BY seq) <= CAST(floor((SELECT count(*) FROM sft_pairs) * 0.03) AS BIGINT)",
    "iter_slice": "SELECT seq, prompt_len FROM sft_pairs QUALIFY row_number() OVER (ORDER BY seq) BETWEEN 201 AND 300",
    "superior_filter": f"{_SUPERIOR} SELECT event_id, kept FROM f",
    "keep_ratio": f"{_SUPERIOR} SELECT event_id % 10 AS step, round(avg(CAST(kept AS DOUBLE)), 6) AS keep_ratio FROM f GROUP BY 1",
    "status_aggregate": """
        WITH s AS (SELECT event_id % 16 AS step, sum(value * (1 + user_id % 20)) / sum(1 + user_id % 20) AS kl, avg(value) AS plain FROM events GROUP BY 1)
        SELECT round(avg(kl), 6) AS kl_mean, round(avg(plain), 6) AS plain_mean, count(*) AS n_steps FROM s
    """,
    "kto_pairs": """
        WITH r AS (SELECT seq, seq // 16 AS batch, CAST(length(response) AS INTEGER) AS len FROM sft_pairs)
        SELECT seq, batch, len, CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY batch) THEN first_value(len) OVER w ELSE lead(len) OVER w END AS kl_len, -1 AS label FROM r WINDOW w AS (PARTITION BY batch ORDER BY seq)
    """,
    "sum_reward_models": "SELECT seq, round(length(chosen) + length(rejected) * 0.5::DOUBLE + coalesce(margin, 0), 6) AS reward FROM preference_pairs WHERE chosen IS NOT NULL AND rejected IS NOT NULL",
    "reward_zscore": f"WITH v AS (SELECT seq, {_FINITE} AS r FROM scored_samples), s AS (SELECT avg(r) AS m, stddev_samp(r) AS d FROM v) SELECT seq, round((r - m) / nullif(d, 0), 6) AS reward FROM v, s",
    "reward_stats": f"WITH v AS (SELECT {_FINITE} AS r FROM scored_samples) SELECT count(r) AS n, round(avg(r), 6) AS mean_reward, round(stddev_samp(r), 6) AS std_reward FROM v",
    "iterative_dpo": """
        SELECT input AS prompt, arg_max(output, (reward, -seq)) AS chosen, max(reward) AS chosen_reward, arg_min(output, (reward, seq)) AS rejected, min(reward) AS rejected_reward
        FROM scored_samples WHERE input IS NOT NULL AND output IS NOT NULL AND reward IS NOT NULL AND NOT isnan(reward) GROUP BY 1
    """,
    "conditional_sft": """
        SELECT DISTINCT replace(replace('{input} <score: {reward}>', '{reward}', printf('%.2f', reward)), '{input}', input) AS input, output, seq
        FROM scored_samples WHERE input IS NOT NULL AND reward IS NOT NULL AND NOT isnan(reward) AND abs(reward) < 1e9
    """,
    "csft_suffix": "SELECT seq, prompt || '<score: 5.00> ' AS prompt FROM sft_pairs WHERE prompt IS NOT NULL",
    "reward_histogram": """
        WITH b AS (SELECT CAST(least(floor((reward + 10) / 2), 9) AS INTEGER) AS bin, count(*) AS n FROM scored_samples WHERE reward BETWEEN -10 AND 10 AND NOT isnan(reward) GROUP BY 1)
        SELECT bin, n, round(n / (sum(n) OVER ())::DOUBLE, 6) AS share FROM b
    """,
    "rm_evaluation": """
        WITH r AS (SELECT seq // 8 AS batch, length(chosen) / 100.0::DOUBLE AS c, length(rejected) / 100.0::DOUBLE AS j, coalesce(margin, 0) AS m FROM preference_pairs WHERE chosen IS NOT NULL AND rejected IS NOT NULL),
        s AS (SELECT batch, avg(CAST(c > j AS DOUBLE)) AS acc, avg(greatest(-(c - j - m), 0) + ln(1 + exp(-abs(c - j - m)))) AS loss, avg(c) AS mean FROM r GROUP BY 1)
        SELECT round(avg(acc), 6) AS acc_mean, round(avg(loss), 6) AS loss_mean, round(avg(mean), 6) AS reward_mean, round(greatest(stddev_samp(mean), 1e-8), 6) AS reward_std FROM s
    """,
}
