"""Queries on benchmark records, token batches, losses by parts, and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.functions import answers as N
from rollmill.functions import arrays as A
from rollmill.functions import checkers as C
from rollmill.functions import losses as L
from rollmill.functions import steps
from rollmill.functions import text as X
from rollmill.operators import benchmarks, shape, tokenise
from rollmill.plans.tables import table
from rollmill.plans.tokens import _pairs, _r, _seqs
from rollmill.sources import io
from rollmill.streaming import state


def benchmark_truths(spark: SparkSession, folder: str) -> DataFrame:
    """Worked solutions that end in "#### number", read as one of the data sets."""
    answer = F.concat(F.lit("It is "), F.col("event_type"), F.lit(".\n#### "), F.format_number(F.col("event_id") * 7, 0))
    rows = table(spark, folder, "events").select("event_id", answer.alias("answer"))
    return benchmarks.with_truth(rows, "gsm8k").select("event_id", "gt_cot", N.number(F.col("gt")).alias("gt"))


def benchmark_questions(spark, folder):
    """Questions with a body and an answer of yes or no."""
    said = F.when(F.col("event_id") % 3 == 0, F.lit("yes")).when(F.col("event_id") % 3 == 1, F.lit("No")).otherwise(F.lit("7"))
    rows = table(spark, folder, "events").select("event_id", F.concat(F.lit(" About "), F.col("event_type")).alias("Body"), F.lit("What is it? ").alias("Question"), F.lit("x").alias("Equation"), said.alias("Answer"))
    return benchmarks.with_question(rows, "svamp").select("event_id", "built_question")


def few_shot_cot(spark, folder):
    """Evaluation items asked after three worked examples, the subjects' own descriptions."""
    names = table(spark, folder, "subjects").select(F.lit("gsm8k").alias("data_set"), F.col("subject").alias("place"), F.concat(F.lit("What is "), "subject").alias("question"), F.col("about").alias("answer"))
    rows = table(spark, folder, "eval_items").select("item_id", F.col("text").alias("question"))
    return benchmarks.few_shot_prompts(rows, names, "svamp", "cot", 3).select("item_id", "prompt")


def byte_tokens(spark, folder):
    """Answers as bytes, at most 64 of them."""
    rows = table(spark, folder, "sft_pairs").select("seq", "response")
    out = tokenise.tokenise(rows, "response", tokenise.byte_tokens, 64)
    return out.select("seq", "n_ids", F.size("ids").alias("kept"), F.get("ids", F.lit(0)).alias("first"))


def judge_token_inputs(spark, folder):
    """Evaluation items as bytes, at most 300, padded to the longest of their suite."""
    rows = table(spark, folder, "eval_items").where(F.col("text").isNotNull()).select("item_id", "suite", "text")
    out = tokenise.judge_inputs(rows, "text", tokenise.byte_tokens, 300, 0, batch="suite")
    return out.select("item_id", F.size("ids").alias("width"), A.total("mask").cast("int").alias("n_ids"), F.get("ids", F.lit(0)).alias("first"))


def collated_batches(spark, folder):
    rows = table(spark, folder, "sft_pairs").select("seq", F.floor(F.col("seq") / 16).cast("bigint").alias("batch"), "prompt_len")
    out = tokenise.collate(rows, "batch", "seq", ["seq", "prompt_len"])
    return out.select("batch", "n_rows", F.array_join("seq", ",").alias("seqs"), F.array_join("prompt_len", ",", "-").alias("lengths"))


def uncollated_rows(spark, folder):
    rows = table(spark, folder, "sft_pairs").select("seq", F.floor(F.col("seq") / 16).cast("bigint").alias("batch"), "prompt_len")
    return tokenise.uncollate(tokenise.collate(rows, "batch", "seq", ["seq", "prompt_len"]), "batch", ["seq", "prompt_len"])


def _generations(spark, folder):
    """Prompts of 1 + id % 5 tokens and outputs of 1 + id % 7, every third closed by the end token 2."""
    v = F.col("vec_id")
    prompt, output = F.sequence(F.lit(10), (F.lit(10) + v % 5).cast("int")), F.sequence(F.lit(30), (F.lit(30) + v % 7).cast("int"))
    closed = F.when(v % 3 == 0, F.concat(output, F.array(F.lit(2)))).otherwise(output)
    return table(spark, folder, "embeddings").select("vec_id", F.floor(v / 8).cast("bigint").alias("batch"), prompt.alias("p"), closed.alias("o"))


def rectangles(spark, folder):
    out = tokenise.rectangle(_generations(spark, folder), "batch", "p", "o", 2, 0)
    return out.select("vec_id", F.array_join("sequence", " ").alias("sequence"), A.total("attention").cast("int").alias("attended"), "n_actions")


def packed_generations(spark, folder):
    out = tokenise.packed_rows(_generations(spark, folder), "batch", "vec_id", "p", "o", 2)
    return out.select("batch", F.array_join("sequence", " ").alias("sequence"), F.array_join("lengths", " ").alias("lengths"), F.array_join("n_actions", " ").alias("n_actions"))


def closed_ids(spark, folder):
    """Outputs with the end token appended where it's missing, or in place of the last one."""
    rows = _generations(spark, folder)
    return rows.select("vec_id", F.array_join(tokenise.closed(F.col("o"), 2), " ").alias("closed"), F.array_join(tokenise.last_is(F.col("o"), 2), " ").alias("forced"))


def packed_logps(spark, folder):
    """Sums and means of log-probabilities after the prompt, by the parts of packed rows of four."""
    rows = _seqs(spark, folder).select(F.floor(F.col("vec_id") / 4).cast("bigint").alias("pack"), "vec_id", "logp")
    packed = tokenise.collate(rows, "pack", "vec_id", ["logp"]).select("pack", A.pack(F.col("logp")).alias("flat"), F.transform("logp", lambda x: F.size(x)).alias("lengths"))
    parts = packed.select("pack", F.posexplode(A.unpack(F.col("flat"), F.col("lengths"))).alias("part", "own"))
    return parts.select("pack", "part", _r(A.sequence_log_prob(F.col("own"), F.lit(5))).alias("logp_sum"), _r(A.sequence_log_prob(F.col("own"), F.lit(5), True)).alias("logp_mean"))


def shifted_lm_loss(spark, folder):
    """Cross-entropy of the next row's label by this row's logits, in shards of 32 rows; ignored labels don't count, a shard of none is 0."""
    rows = _seqs(spark, folder).select("vec_id", F.floor(F.col("vec_id") / 32).alias("shard"), "logp", "label")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.when(F.col("vec_id") % 5 != 4, F.col("label")).alias("next"), F.col("shard").alias("next_shard"))
    kept = rows.join(following, "vec_id").where(F.col("shard") == F.col("next_shard"))
    shards = kept.groupBy("shard").agg(F.coalesce(F.avg(F.when(F.col("next").isNotNull(), -A.label_log_prob(F.col("logp"), F.col("next")))), F.lit(0.0)).alias("loss"))
    return shards.agg(_r(F.avg("loss")).alias("loss"), F.count("*").alias("n_shards"))


def soft_prm_loss(spark, folder):
    """Cross-entropy of two-class logits against soft labels at placeholders, and how often the larger side is met."""
    two = F.slice("logp", 1, 2)
    p = (F.col("label") % 5) / 4.0
    soft = -(p * A.label_log_prob(two, F.lit(1)) + (1 - p) * A.label_log_prob(two, F.lit(0)))
    hit = ((F.get("logp", F.lit(1)) > F.get("logp", F.lit(0))) == (p > 0.5)).cast("double")
    rows = _seqs(spark, folder).where(F.col("vec_id") % 7 != 3).select(soft.alias("loss"), hit.alias("hit"))
    return rows.agg(_r(F.avg("loss")).alias("loss"), _r(F.avg("hit")).alias("acc"), F.count("*").alias("n"))


def prm_evaluation(spark, folder):
    """Mean over batches of 16 of process-reward loss and accuracy."""
    two, y = F.slice("logp", 1, 2), (F.col("label") % 2).cast("int")
    hit = ((F.get("logp", F.lit(1)) > F.get("logp", F.lit(0))).cast("int") == y).cast("double")
    rows = _seqs(spark, folder).select(F.floor(F.col("vec_id") / 16).alias("b"), (-A.label_log_prob(two, y)).alias("loss"), hit.alias("hit"))
    return rows.groupBy("b").agg(F.avg("loss").alias("loss"), F.avg("hit").alias("hit")).agg(_r(F.avg("loss")).alias("loss_mean"), _r(F.avg("hit")).alias("acc_mean"))


def kto_evaluation(spark, folder):
    """Mean over batches of 16 of the unpaired loss, its KL taken within the batch, and the rewards of good and bad answers."""
    d = _pairs(spark, folder).withColumn("b", F.floor(F.col("vec_id") / 16))
    kl = d.groupBy("b").agg(F.greatest(F.avg(F.col("j") - F.col("rj")), F.lit(0.0)).alias("kl"))
    ratio = F.col("c") - F.col("rc")
    rows = d.join(kl, "b").select("b", L.kto_term(ratio, F.col("kl"), F.col("good"), 0.1, 1.0, 1.0).alias("loss"), F.when(F.col("good"), 0.1 * ratio).alias("good"), F.when(~F.col("good"), 0.1 * ratio).alias("bad"))
    batches = rows.groupBy("b").agg(F.avg("loss").alias("loss"), F.avg("good").alias("good"), F.avg("bad").alias("bad"))
    return batches.agg(_r(F.avg("loss")).alias("loss_mean"), _r(F.avg("good")).alias("chosen_reward"), _r(F.avg("bad")).alias("rejected_reward"))


def mixed_losses(spark, folder):
    """Preference loss with a share of the chosen answer's likelihood, and policy loss with KL and pretraining terms."""
    d = _pairs(spark, folder)
    dpo = L.dpo(F.col("c"), F.col("j"), F.col("rc"), F.col("rj"), 0.1) + 0.2 * -F.col("c") / 32
    s = _seqs(spark, folder)
    policy = A.masked_mean(L.policy_token(F.col("logp"), F.col("base"), F.col("rewards"), 0.2, F.lit(True)), F.col("mask"))
    kl = A.masked_mean(A.approx_kl(F.col("logp"), F.col("base"), None, True), F.col("mask"))
    ppo = policy + 0.05 * kl + 0.1 * -A.label_log_prob(F.col("logp"), F.col("label"))
    return d.agg(_r(F.avg(dpo)).alias("dpo_nll")).crossJoin(s.agg(_r(F.avg(ppo)).alias("ppo_mixed")))  # one row each


def bonus_scores(spark, folder):
    """Step scores with a bonus for a right box on the last one."""
    tokens = F.transform(A.indexes(F.col("logp")), lambda i: F.pmod(i, F.lit(9)))
    bonus = F.when(F.col("label") % 2 == 0, F.lit(0.5)).otherwise(F.lit(-0.5))
    d = _seqs(spark, folder).select("vec_id", steps.with_bonus(A.step_scores(tokens, F.col("logp"), 8), bonus).alias("b"))
    return d.select("vec_id", F.size("b.steps").alias("n_steps"), _r(F.element_at("b.steps", -1)).alias("last"), _r(A.total("b.steps")).alias("total"), _r("b.sample").alias("sample"))


def rank_reduce(spark, folder):
    """Mean of rank sums divided before they are added, sum and maximum over eight ranks, and all rows of the ranks in one table's count."""
    rows = table(spark, folder, "events").select((F.col("event_id") % 8).alias("rank"), "value")
    ranks = rows.groupBy("rank").agg(F.sum("value").alias("s"), F.max("value").alias("m"), F.count("*").alias("n"))
    return ranks.agg(_r(F.sum(F.col("s") / 8)).alias("mean_of_sums"), _r(F.sum("s")).alias("sum"), F.max("m").alias("most"), F.sum("n").alias("gathered"))


def critic_status(spark, folder):
    """Unweighted mean over steps of the mean over ranks of a critic's figures."""
    rows = table(spark, folder, "events").select((F.col("event_id") % 16).alias("step"), (F.col("event_id") % 4).alias("rank"), "value")
    ranks = rows.groupBy("step", "rank").agg(F.avg("value").alias("v")).groupBy("step").agg(F.avg("v").alias("v"))
    return ranks.agg(_r(F.avg("v")).alias("critic_mean"), F.count("*").alias("n_steps"))


def moving_averages(spark, folder):
    rows = table(spark, folder, "events").select((F.col("event_id") % 10).alias("name"), F.floor(F.col("event_id") / 10).alias("step"), "value")
    return state.moving_average(rows, "name", "step", "value", 0.9).select("name", _r("average").alias("average"))


def resumed_order(spark, folder):
    return state.resume_from(table(spark, folder, "eval_items").select("item_id"), "item_id", 1000, 240).select("item_id", "epoch", F.col("order").cast("bigint").alias("order"))


def request_engines(spark, folder):
    """Users of the first five hundred as actors that send to seven engines."""
    rows = table(spark, folder, "events").select("event_id", F.col("user_id").alias("actor"))
    most = rows.agg(F.max("actor").alias("m")).first().m or 0
    return state.coalesced_requests(rows, "actor", int(most) + 1, 7).select("event_id", "engine", "ready")


def resumed_shard(spark, folder):
    from rollmill.operators.order import positions, shard

    placed = positions(table(spark, folder, "sft_pairs").select("seq"), "seq")
    total = placed.count()
    return shard(placed, "pos", 4, total, False, consumed=403).select("seq", "rank", "turn")


def instruction_conflicts(spark, folder):
    """Instructions that can't be given together."""
    return spark.createDataFrame(C.conflicts(), "a string, b string")


def template_pairs(spark, folder):
    """Preference pairs as conversations, the prompt cut off both answers, closed by the end mark."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.coalesce(c, F.lit("")).alias("content"))
    rows = table(spark, folder, "preference_pairs").where(F.col("chosen").isNotNull() & F.col("rejected").isNotNull())
    sides = {c: F.array(message("user", F.col("prompt")), message("assistant", F.col(c))) for c in ("chosen", "rejected")}
    talks = rows.select("seq", "margin", sides["chosen"].alias("c"), sides["rejected"].alias("j"))
    return shape.paired_rows(talks, "c", "j", margin="margin", messages=True, dpo=True, eos="</s>")


def token_ngrams(spark, folder):
    """Pairs of successive token ids, all and different ones."""
    ids = F.transform("embedding", lambda x: F.floor(x.cast("double") * 4).cast("int"))
    g = X.ngrams(ids, 2)
    return table(spark, folder, "embeddings").select("vec_id", F.size(g).alias("n"), F.size(F.array_distinct(g)).alias("n_distinct"))


def served_scores(spark, folder):
    """Answers without end and padding marks, scored in batches by a service, here the length of the text."""
    text = X.strip_marks(F.concat(F.lit("<pad>"), "response", F.lit("</s><pad>")), "</s>", "<pad>")
    rows = table(spark, folder, "sft_pairs").where(F.col("response").isNotNull()).select("seq", text.alias("text"))
    return io.score_rows(rows, lambda batch: batch["text"].str.len()).select("seq", "score")


QUERIES = {
    f.__name__: f
    for f in (
        benchmark_truths, benchmark_questions, few_shot_cot, byte_tokens, judge_token_inputs, collated_batches, uncollated_rows, rectangles, packed_generations, closed_ids, packed_logps, shifted_lm_loss,
        soft_prm_loss, prm_evaluation, kto_evaluation, mixed_losses, bonus_scores, rank_reduce, critic_status, moving_averages, resumed_order, request_engines, resumed_shard, instruction_conflicts, template_pairs, token_ngrams,
        served_scores,
    )
}

_GEN = """
WITH g AS (SELECT vec_id, vec_id // 8 AS batch, range(10, 11 + vec_id % 5) AS p, CASE WHEN vec_id % 3 = 0 THEN list_append(range(30, 31 + vec_id % 7), 2) ELSE range(30, 31 + vec_id % 7) END AS o FROM embeddings),
c AS (SELECT *, CASE WHEN o[-1] = 2 THEN o ELSE list_append(o, 2) END AS k FROM g)
"""
_TOK = """
WITH s AS (
    SELECT vec_id, label, x, list_reverse(x) AS b, list_transform(x, lambda v: v * 0.5) AS v, list_transform(x, lambda v: v * 0.1) AS r,
           list_transform(range(len(x)), lambda i: CASE WHEN i <= vec_id % len(x) THEN 1 ELSE 0 END) AS m, range(len(x)) AS ix
    FROM (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)
)
"""
_LSE_OF = lambda x: f"(list_max({x}) + ln(list_sum(list_transform({x}, lambda u: exp(u - list_max({x}))))))"
_PAIRED = _TOK + ", p AS (SELECT vec_id, list_sum(x[1:len(x)//2]) AS c, list_sum(x[len(x)//2 + 1:]) AS j, list_sum(v[1:len(x)//2]) AS rc, list_sum(r[len(x)//2 + 1:]) AS rj, label % 2 = 0 AS good FROM s)"
_SIG = lambda z: f"(1 / (1 + exp(-({z}))))"
_STEPS = ", t AS (SELECT vec_id, label, list_transform(list_filter(ix, lambda i: i % 9 = 8), lambda i: x[i + 1] - 0.5) AS z FROM s), b AS (SELECT vec_id, CASE WHEN label % 2 = 0 THEN 0.5 ELSE -0.5 END AS b, z, CASE WHEN len(z) < 2 THEN z ELSE list_concat(z[:len(z) - 2], z[len(z):]) END AS k FROM t)"
SQL = {
    "token_ngrams": """
        WITH i AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 4)::INTEGER) AS i FROM embeddings), g AS (SELECT vec_id, list_transform(range(greatest(len(i) - 1, 0)), lambda k: i[k + 1:k + 2]) AS g FROM i)
        SELECT vec_id, CAST(len(g) AS INTEGER) AS n, CAST(len(list_distinct(g)) AS INTEGER) AS n_distinct FROM g
    """,
    "served_scores": "SELECT seq, CAST(length(regexp_replace(regexp_replace('<pad>' || response || '</s><pad>', '^(</s>|<pad>)+', ''), '(</s>|<pad>)+$', '')) + 4 AS DOUBLE) AS score FROM sft_pairs WHERE response IS NOT NULL",
    "benchmark_truths": "SELECT event_id, 'It is ' || event_type || '.' AS gt_cot, event_id * 7.0::DOUBLE AS gt FROM events",
    "benchmark_questions": "SELECT event_id, 'About ' || event_type || '. What is it?' || CASE WHEN event_id % 3 < 2 THEN ' (Yes or No)' ELSE '' END AS built_question FROM events",
    "few_shot_cot": """
        WITH x AS (SELECT string_agg('Question: What is ' || subject || chr(10) || 'Answer: ' || about, repeat(chr(10), 3) ORDER BY subject) AS s FROM (SELECT * FROM subjects ORDER BY subject LIMIT 3))
        SELECT item_id, trim(s || repeat(chr(10), 3) || 'Question: ' || text || chr(10) || 'Answer: ', ' ') AS prompt FROM eval_items, x
    """,
    "byte_tokens": "SELECT seq, CAST(strlen(response) AS INTEGER) AS n_ids, CAST(least(64, strlen(response)) AS INTEGER) AS kept, CASE WHEN strlen(response) > 0 THEN ('0x' || hex(encode(response))[1:2])::INTEGER END AS first FROM sft_pairs",
    "judge_token_inputs": """
        SELECT item_id, CAST(max(least(300, strlen(text))) OVER (PARTITION BY suite) AS INTEGER) AS width, CAST(least(300, strlen(text)) AS INTEGER) AS n_ids, ('0x' || hex(encode(text))[1:2])::INTEGER AS first FROM eval_items WHERE text IS NOT NULL
    """,
    "collated_batches": "SELECT seq // 16 AS batch, count(*) AS n_rows, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS seqs, string_agg(coalesce(prompt_len::VARCHAR, '-'), ',' ORDER BY seq) AS lengths FROM sft_pairs GROUP BY 1",
    "uncollated_rows": "SELECT seq // 16 AS batch, CAST(row_number() OVER (PARTITION BY seq // 16 ORDER BY seq) - 1 AS INTEGER) AS place, seq, prompt_len FROM sft_pairs",
    "rectangles": _GEN + """, w AS (SELECT *, max(len(p)) OVER (PARTITION BY batch) AS wp, max(len(k)) OVER (PARTITION BY batch) AS wo FROM c)
        SELECT vec_id, array_to_string(list_concat(list_transform(range(wp - len(p)), lambda i: 0), p, k, list_transform(range(wo - len(k)), lambda i: 0)), ' ') AS sequence, CAST(len(p) + len(k) AS INTEGER) AS attended, CAST(wo AS INTEGER) AS n_actions FROM w""",
    "packed_generations": _GEN + "SELECT batch, string_agg(array_to_string(list_concat(p, k), ' '), ' ' ORDER BY vec_id) AS sequence, string_agg((len(p) + len(k))::VARCHAR, ' ' ORDER BY vec_id) AS lengths, string_agg(len(k)::VARCHAR, ' ' ORDER BY vec_id) AS n_actions FROM c GROUP BY 1",
    "closed_ids": _GEN + "SELECT vec_id, array_to_string(k, ' ') AS closed, array_to_string(list_append(o[:len(o) - 1], 2), ' ') AS forced FROM c",
    "packed_logps": _TOK + "SELECT vec_id // 4 AS pack, CAST(row_number() OVER (PARTITION BY vec_id // 4 ORDER BY vec_id) - 1 AS INTEGER) AS part, round(list_sum(x[6:]), 6) AS logp_sum, round(list_avg(x[6:]), 6) AS logp_mean FROM s",
    "shifted_lm_loss": _TOK + f""", n AS (SELECT a.vec_id // 32 AS shard, CASE WHEN b.vec_id % 5 <> 4 THEN {_LSE_OF('a.x')} - a.x[b.label + 1] END AS l FROM s a JOIN s b ON b.vec_id = a.vec_id + 1 AND b.vec_id // 32 = a.vec_id // 32)
        SELECT round(avg(l), 6) AS loss, count(*) AS n_shards FROM (SELECT shard, coalesce(avg(l), 0) AS l FROM n GROUP BY 1)""",
    "soft_prm_loss": _TOK + f""", q AS (SELECT label % 5 / 4.0::DOUBLE AS p, x[1:2] AS t, {_LSE_OF('x[1:2]')} AS z FROM s WHERE vec_id % 7 <> 3)
        SELECT round(avg(-(p * (t[2] - z) + (1 - p) * (t[1] - z))), 6) AS loss, round(avg(((t[2] > t[1]) = (p > 0.5))::INT), 6) AS acc, count(*) AS n FROM q""",
    "prm_evaluation": _TOK + f""", q AS (SELECT vec_id // 16 AS b, {_LSE_OF('x[1:2]')} - x[label % 2 + 1] AS l, ((x[2] > x[1])::INT = label % 2)::INT AS h FROM s)
        SELECT round(avg(l), 6) AS loss_mean, round(avg(h), 6) AS acc_mean FROM (SELECT b, avg(l) AS l, avg(h) AS h FROM q GROUP BY 1)""",
    "kto_evaluation": _PAIRED + f""", k AS (SELECT *, greatest(avg(j - rj) OVER (PARTITION BY vec_id // 16), 0) AS kl FROM p),
        e AS (SELECT vec_id // 16 AS b, avg(CASE WHEN good THEN 1 - {_SIG('0.1 * (c - rc - kl)')} ELSE 1 - {_SIG('0.1 * (kl - (c - rc))')} END) AS l, avg(CASE WHEN good THEN 0.1 * (c - rc) END) AS g, avg(CASE WHEN NOT good THEN 0.1 * (c - rc) END) AS d FROM k GROUP BY 1)
        SELECT round(avg(l), 6) AS loss_mean, round(avg(g), 6) AS chosen_reward, round(avg(d), 6) AS rejected_reward FROM e""",
    "mixed_losses": _PAIRED + f""", d AS (SELECT avg(greatest(-0.1 * z, 0) + ln(1 + exp(-abs(0.1 * z))) - 0.2 * c / 32) AS d FROM (SELECT *, (c - j) - (rc - rj) AS z FROM p)),
        o AS (SELECT list_sum(list_transform(ix, lambda i: m[i + 1] * -least(exp(x[i + 1] - b[i + 1]) * r[i + 1], least(greatest(exp(x[i + 1] - b[i + 1]), 0.8), 1.2) * r[i + 1]))) / list_sum(m) AS a,
            list_sum(list_transform(ix, lambda i: m[i + 1] * (exp(-(x[i + 1] - b[i + 1])) - 1 + x[i + 1] - b[i + 1]))) / list_sum(m) AS k, {_LSE_OF('x')} - x[label + 1] AS n FROM s)
        SELECT round(d, 6) AS dpo_nll, (SELECT round(avg(a + 0.05 * k + 0.1 * n), 6) FROM o) AS ppo_mixed FROM d""",
    "bonus_scores": _TOK + _STEPS + "SELECT vec_id, CAST(len(k) AS INTEGER) AS n_steps, round(k[-1] + b, 6) AS last, round(list_sum(k) + b, 6) AS total, round(list_min(z) + b, 6) AS sample FROM b",
    "rank_reduce": "SELECT round(sum(s / 8), 6) AS mean_of_sums, round(sum(s), 6) AS sum, max(m) AS most, sum(n)::BIGINT AS gathered FROM (SELECT event_id % 8 AS rank, sum(value) AS s, max(value) AS m, count(*) AS n FROM events GROUP BY 1)",
    "critic_status": "SELECT round(avg(v), 6) AS critic_mean, count(*) AS n_steps FROM (SELECT step, avg(v) AS v FROM (SELECT event_id % 16 AS step, event_id % 4 AS rank, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1)",
    "moving_averages": """
        WITH e AS (SELECT event_id % 10 AS name, event_id // 10 AS step, value FROM events), l AS (SELECT name, list(value ORDER BY step) AS v FROM e GROUP BY 1)
        SELECT name, round(list_reduce(v, lambda a, x: 0.9 * a + 0.1 * x), 6) AS average FROM l
    """,
    "resumed_order": "SELECT item_id, CAST(CASE WHEN item_id < 40 THEN 5 ELSE 4 END AS INTEGER) AS epoch, CASE WHEN item_id < 40 THEN item_id + 200 ELSE item_id - 40 END AS \"order\" FROM eval_items",
    "request_engines": """
        WITH n AS (SELECT max(user_id) + 1 AS n FROM events), s AS (SELECT user_id % 7 AS e, count(DISTINCT user_id) AS c FROM events GROUP BY 1)
        SELECT event_id, CAST(user_id % 7 AS INTEGER) AS engine, c = (SELECT count(*) FROM range(n) r(a) WHERE a % 7 = e) AS ready FROM events JOIN s ON user_id % 7 = e, n
    """,
    "resumed_shard": "WITH p AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS pos, count(*) OVER () AS n FROM sft_pairs) SELECT seq, CAST(pos % 4 AS INTEGER) AS rank, pos // 4 AS turn FROM p WHERE pos // 4 < n // 4 AND pos // 4 >= 100",
    "template_pairs": """
        SELECT seq, '<|im_start|>user' || chr(10) || coalesce(prompt, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt, chosen || '<|im_end|> </s>' AS chosen, rejected || '<|im_end|> </s>' AS rejected, coalesce(margin, 0) AS margin
        FROM preference_pairs WHERE chosen IS NOT NULL AND rejected IS NOT NULL
    """,
}
