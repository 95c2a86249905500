"""Queries over per-token arrays; the embeddings table stands for token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollmill.functions import arrays as A
from rollmill.functions import losses as L
from rollmill.plans.tables import table


def _seqs(spark: SparkSession, folder: str) -> DataFrame:
    """logp: the vector; base: its reverse; values: half of it; rewards: a tenth; mask: the first 1 + vec_id % size places."""
    e = F.col("embedding").cast("array<double>")
    rows = table(spark, folder, "embeddings").select("vec_id", "label", e.alias("logp"), F.reverse(e).alias("base"), F.transform(e, lambda x: x * 0.5).alias("values"), F.transform(e, lambda x: x * 0.1).alias("rewards"))
    return rows.withColumn("mask", F.transform("logp", lambda _, i: (i <= F.pmod(F.col("vec_id"), F.size("logp"))).cast("int")))


def _r(x):
    return F.round(x, 6)


def kl_k1(spark, folder):
    d = _seqs(spark, folder)
    return d.select("vec_id", _r(A.total(A.approx_kl(F.col("logp"), F.col("base"), F.col("mask")))).alias("kl"), _r(A.masked_mean(A.approx_kl(F.col("logp"), F.col("base")), F.col("mask"))).alias("kl_mean"))


def kl_k3(spark, folder):
    d = _seqs(spark, folder)
    return d.select("vec_id", _r(A.total(A.approx_kl(F.col("logp"), F.col("base"), F.col("mask"), True))).alias("kl"))


def token_reward(spark, folder):
    d = _seqs(spark, folder).withColumn("kl", A.approx_kl(F.col("logp"), F.col("base"), F.col("mask")))
    r = A.token_rewards(F.col("label").cast("double"), 0.05, F.col("kl"), F.col("mask"), -5.0, 5.0)
    return d.select("vec_id", F.posexplode(r).alias("pos", "reward")).select("vec_id", "pos", _r("reward").alias("reward"))


def step_reward(spark, folder):
    d = _seqs(spark, folder).withColumn("kl", A.approx_kl(F.col("logp"), F.col("base")))
    places = F.when(F.col("vec_id") % 3 == 0, F.array(F.lit(-1), F.lit(5))).when(F.col("vec_id") % 3 == 1, F.array(F.lit(3), F.lit(7))).otherwise(F.array(F.lit(3), F.lit(4000)))
    scores = F.array(F.get("logp", F.lit(0)) * 4, F.get("logp", F.lit(1)) * 4)
    r = A.step_rewards(F.col("label").cast("double"), 0.05, F.col("kl"), places, scores, -1.0, 1.0)
    return d.select("vec_id", _r(A.total(r)).alias("total"), _r(F.element_at(r, -1)).alias("last"), _r(F.element_at(r, 4)).alias("third"))


def gae(spark, folder):
    d = _seqs(spark, folder)
    adv = A.gae(F.col("values"), F.col("rewards"), F.col("mask"), 1.0, 0.95)
    return d.select("vec_id", adv.alias("a"), F.col("values").alias("v"), "mask").select("vec_id", _r(A.total("a")).alias("advantage"), _r(F.get("a", F.lit(0))).alias("first"), _r(A.total("a") + A.total(A.masked(F.col("v"), F.col("mask")))).alias("returns"))


def discounted_return(spark, folder):
    d = _seqs(spark, folder)
    r = A.discounted_returns(F.col("rewards"), F.col("mask"), 0.9)
    return d.select("vec_id", r.alias("r")).select("vec_id", _r(F.get("r", F.lit(0))).alias("first"), _r(A.total("r")).alias("total"))


def return_sum(spark, folder):
    return _seqs(spark, folder).select("vec_id", _r(A.total(A.masked(F.col("rewards"), F.col("mask")))).alias("return_sum"))


def masked_mean(spark, folder):
    return _seqs(spark, folder).select("vec_id", _r(A.masked_mean(F.col("logp"), F.col("mask"))).alias("mean"))


def masked_normalize(spark, folder):
    n = A.masked_normalise(F.col("logp"), F.col("mask"))
    return _seqs(spark, folder).select("vec_id", n.alias("n"), "mask").select("vec_id", _r(F.get("n", F.lit(0))).alias("first"), _r(F.element_at("n", -1)).alias("last"), _r(F.abs(A.total(A.masked(F.col("n"), F.col("mask"))))).alias("sum"))


def adv_normalize(spark, folder):
    """Advantages of all tokens normalised together: per-row sums, one global row, broadcast back."""
    d = _seqs(spark, folder).select("vec_id", A.masked(F.col("logp"), F.col("mask")).alias("a"), "mask")
    mean = d.select(A.total("a").alias("s"), A.total("mask").alias("n")).agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    both = d.crossJoin(F.broadcast(mean))
    var = both.select(A.total(A.masked(F.transform("a", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.col("mask"))).alias("q"), "n").agg((F.sum("q") / F.max("n")).alias("var"))
    out = F.transform("a", lambda x: (x - F.col("mean")) / F.sqrt(F.greatest("var", F.lit(1e-8))))
    return both.crossJoin(F.broadcast(var)).select("vec_id", _r(F.get(out, F.lit(0))).alias("first"), _r(A.total(out)).alias("sum"))


def estimator_dispatch(spark, folder):
    """Advantage by estimator: gae uses values, every other the return to go."""
    d = _seqs(spark, folder)
    g = A.gae(F.col("values"), F.col("rewards"), F.col("mask"), 1.0, 1.0)
    r = A.discounted_returns(F.col("rewards"), F.col("mask"), 1.0)
    name = F.when(F.col("vec_id") % 2 == 0, F.lit("gae")).otherwise(F.lit("reinforce"))
    return d.select("vec_id", name.alias("estimator"), _r(F.get(F.when(F.col("vec_id") % 2 == 0, g).otherwise(r), F.lit(0))).alias("advantage"))


def logsumexp_logprob(spark, folder):
    return _seqs(spark, folder).select("vec_id", _r(A.label_log_prob(F.col("logp"), F.col("label"))).alias("logp"))


def sequence_logprob(spark, folder):
    n = F.pmod(F.col("vec_id"), F.lit(40))
    return _seqs(spark, folder).select("vec_id", _r(A.sequence_log_prob(F.col("logp"), n)).alias("logp_sum"), _r(A.sequence_log_prob(F.col("logp"), n, True)).alias("logp_mean"))


def pad_sequences(spark, folder):
    """Left padding to the longest of a batch of 8."""
    d = _seqs(spark, folder).select("vec_id", F.floor(F.col("vec_id") / 8).alias("batch"), F.slice("logp", F.lit(1), (1 + F.pmod(F.col("vec_id"), F.lit(50))).cast("int")).alias("x"))
    w = F.max(F.size("x")).over(Window.partitionBy("batch"))
    p = d.withColumn("p", A.pad(F.col("x"), w, 0.0, "left"))
    return p.select("vec_id", F.size("p").alias("size"), _r(F.element_at("p", 1)).alias("first"), _r(F.element_at("p", -1)).alias("last"))


def strip_padding(spark, folder):
    n = F.pmod(F.col("vec_id"), F.lit(10))
    d = _seqs(spark, folder).select("vec_id", A.unpad(A.pad(A.pad(F.col("logp"), F.size("logp") + n, 0.0, "left"), F.size("logp") + 2 * n, 0.0, "right"), n, n).alias("u"), "logp")
    return d.select("vec_id", F.size("u").alias("size"), _r(A.total("u")).alias("total"), F.get("u", F.lit(0)).alias("first"))


def _packs(spark, folder):
    """Rows of eight sequences of 1 + vec_id % 7 ids each, in order."""
    ids = F.sequence((F.col("vec_id") * 10).cast("int"), (F.col("vec_id") * 10 + F.pmod("vec_id", F.lit(7))).cast("int"))
    rows = table(spark, folder, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("bigint").alias("pack_id"), F.struct("vec_id", ids.alias("ids")).alias("s"))
    return rows.groupBy("pack_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["ids"]).alias("parts"))


def sequence_packing(spark, folder):
    d = _packs(spark, folder)
    ids, seg = A.multiple(A.pack(F.col("parts")), 16, 0), A.multiple(A.segments(F.col("parts")), 16, 0)
    return d.select("pack_id", F.posexplode(F.arrays_zip(ids.alias("id"), seg.alias("segment"))).alias("pos", "x")).select("pack_id", "pos", "x.id", "x.segment")


def position_ids(spark, folder):
    seg = A.multiple(A.segments(F.col("parts")), 16, 0)
    return _packs(spark, folder).select("pack_id", seg.alias("seg")).select("pack_id", F.posexplode(A.position_ids(F.col("seg"))).alias("pos", "position"))


def range_position_ids(spark, folder):
    lengths = F.transform("parts", lambda p: F.size(p))
    return _packs(spark, folder).select("pack_id", F.posexplode(A.position_ids_of_range(lengths, F.lit(2), F.lit(9))).alias("pos", "position"))


def unpack_sequences(spark, folder):
    d = _packs(spark, folder).select("pack_id", A.pack(F.col("parts")).alias("flat"), F.transform("parts", lambda p: F.size(p)).alias("lengths"))
    u = d.select("pack_id", F.posexplode(A.unpack(F.col("flat"), F.col("lengths"))).alias("part", "ids"), A.cumulative_lengths(F.col("lengths")).alias("c"))
    return u.select("pack_id", "part", F.size("ids").alias("n"), A.total("ids").cast("bigint").alias("id_sum"), F.get("c", F.col("part")).alias("start"))


def packed_shards(spark, folder):
    d = _packs(spark, folder).select("pack_id", A.multiple(A.pack(F.col("parts")), 4, 0).alias("x"))
    e = d.select("pack_id", F.posexplode(F.array(*[A.shard_of(F.col("x"), F.lit(r), 4) for r in range(4)])).alias("rank", "s"))
    return e.select("pack_id", "rank", F.size("s").alias("n"), A.total("s").cast("bigint").alias("id_sum"))


def process_masks(spark, folder):
    """Prompt of 3 + vec_id % 4 ids, answer, one eos (2), padding (0) on the right."""
    n = (3 + F.pmod("vec_id", F.lit(4))).cast("int")
    tokens = F.concat(F.array_repeat(F.lit(0), F.pmod("vec_id", F.lit(3)).cast("int")), F.sequence(F.lit(10), (20 + F.pmod("vec_id", F.lit(5))).cast("int")), F.array(F.lit(2)), F.array_repeat(F.lit(0), F.pmod("vec_id", F.lit(6)).cast("int")))
    d = table(spark, folder, "embeddings").select("vec_id", tokens.alias("t"), n.alias("n"))
    return d.select("vec_id", A.total(A.attention_mask(F.col("t"), F.col("n"), 2, 0)).cast("int").alias("attended"), A.total(A.action_mask(F.col("t"), F.col("n"), 2, 0)).cast("int").alias("actions"), A.eos_index(F.col("t"), 2, 0).alias("eos"))


def label_masking(spark, folder):
    d = _seqs(spark, folder).select("vec_id", A.mask_labels(A.indexes(F.col("logp")), F.pmod("vec_id", F.lit(30))).alias("l"))
    return d.select("vec_id", F.size(F.filter("l", lambda x: x != -100)).alias("kept"), A.total("l").cast("bigint").alias("label_sum"))


def range_labels(spark, folder):
    """Words inside the earlier assistant turns of rendered conversations keep their labels."""
    rows = table(spark, folder, "sft_pairs").where(F.col("response_ranges").isNotNull())
    ids = F.sequence(F.lit(0), F.array_max(F.transform("response_ranges", lambda r: r["end_pos"])) + 5)
    m = rows.select("seq", A.mask_labels_by_ranges(ids, F.col("response_ranges")).alias("l"))
    return m.select("seq", F.size(F.filter("l", lambda x: x != -100)).alias("kept"), F.size("l").alias("n"))


def process_labels(spark, folder):
    ids = F.transform(F.sequence(F.lit(0), (10 + F.pmod("vec_id", F.lit(9))).cast("int")), lambda i: F.when(i % 4 == 3, F.lit(7)).otherwise(i + 100))
    d = table(spark, folder, "embeddings").select("vec_id", A.placeholder_labels(ids, 7, F.array(F.lit(1.0), F.lit(-1.0), F.lit(0.5))).alias("l"))
    return d.select("vec_id", F.posexplode("l").alias("pos", "label"))


def prm_step_scores(spark, folder):
    tokens = F.transform(A.indexes(F.col("logp")), lambda i: F.pmod(i, F.lit(9)))
    d = _seqs(spark, folder).select("vec_id", A.step_scores(tokens, F.col("logp"), 8).alias("s"))
    return d.select("vec_id", F.size("s").alias("n_steps"), _r(F.array_min("s")).alias("reward"), _r(A.total("s")).alias("total"))


def reward_head(spark, folder):
    return _seqs(spark, folder).select("vec_id", _r(A.value_head(F.col("logp"), F.col("mask"))).alias("value"), _r(A.value_head(F.col("logp"), F.col("mask"), 0.1, 2.0)).alias("normalised"))


def action_logprobs(spark, folder):
    s = A.action_slice(F.col("logp"), F.greatest(F.lit(1), F.pmod("vec_id", F.lit(20))))
    return _seqs(spark, folder).select("vec_id", F.size(s).alias("n"), _r(A.total(s)).alias("logp_sum"))


def sparse_to_dense(spark, folder):
    s = A.at_place(F.col("logp"), A.last_active(F.col("mask")), F.col("label").cast("double"))
    return _seqs(spark, folder).select("vec_id", F.posexplode(s).alias("pos", "reward"))


def policy_loss(spark, folder):
    w = F.col("vec_id") % 5 != 0
    t = L.policy_token(F.col("logp"), F.col("base"), F.col("rewards"), 0.2, w)
    rows = _seqs(spark, folder).select("vec_id", A.masked_mean(t, F.col("mask")).alias("loss"))
    return rows.agg(_r(F.avg("loss")).alias("loss"), F.count("*").alias("n"))


def value_loss(spark, folder):
    rows = _seqs(spark, folder).select(A.masked_mean(L.value_token(F.col("values"), F.col("base"), F.col("rewards"), 0.2), F.col("mask")).alias("loss"), A.total(A.masked(F.col("values"), F.col("mask"))).alias("s"), A.total("mask").alias("n"))
    return rows.agg(_r(F.avg("loss")).alias("critic_loss"), _r(F.sum("s") / F.sum("n")).alias("values"))


def lm_loss(spark, folder):
    """Cross-entropy of each row's label, ignoring every fifth; mean over kept rows."""
    rows = _seqs(spark, folder).where(F.col("vec_id") % 5 != 4).select((-A.label_log_prob(F.col("logp"), F.col("label"))).alias("nll"))
    return rows.agg(_r(F.avg("nll")).alias("loss"), F.count("*").alias("kept"))


def lm_evaluation(spark, folder):
    """Mean of batch means."""
    rows = _seqs(spark, folder).select(F.floor(F.col("vec_id") / 32).alias("b"), (-A.label_log_prob(F.col("logp"), F.col("label"))).alias("nll"))
    return rows.groupBy("b").agg(F.avg("nll").alias("m")).agg(_r(F.avg("m")).alias("loss_mean"), F.count("*").alias("n_batches"))


def kd_loss(spark, folder):
    rows = _seqs(spark, folder).select(L.kd(F.col("logp"), F.col("base")).alias("kd"), (-A.label_log_prob(F.col("logp"), F.col("label"))).alias("ce"))
    return rows.agg(_r(F.avg("kd")).alias("kd_loss"), _r(F.avg(0.6 * F.col("ce") + 0.4 * F.col("kd"))).alias("mixed_loss"))


def prm_loss(spark, folder):
    """Two-class cross-entropy at placeholders with hard labels, and its accuracy."""
    two = F.slice("logp", 1, 2)
    y = (F.col("label") % 2).cast("int")
    rows = _seqs(spark, folder).select((-A.label_log_prob(two, y)).alias("nll"), ((F.get("logp", F.lit(1)) > F.get("logp", F.lit(0))).cast("int") == y).cast("double").alias("hit"))
    return rows.agg(_r(F.avg("nll")).alias("loss"), _r(F.avg("hit")).alias("acc"))


def _pairs(spark, folder):
    """Summed log-probabilities of both answers, under policy and reference."""
    half = F.size("logp") / 2
    c, j = A.total(F.slice("logp", F.lit(1), half.cast("int"))), A.total(F.slice("logp", half.cast("int") + 1, half.cast("int")))
    b, k = A.total(F.slice("values", F.lit(1), half.cast("int"))), A.total(F.slice("rewards", half.cast("int") + 1, half.cast("int")))
    return _seqs(spark, folder).select("vec_id", c.alias("c"), j.alias("j"), b.alias("rc"), k.alias("rj"), (F.col("label") % 2 == 0).alias("good"))


def dpo_loss(spark, folder):
    d = _pairs(spark, folder)
    cols = [F.col(x) for x in ("c", "j", "rc", "rj")]
    return d.select(
        "vec_id", _r(L.dpo(*cols, 0.1)).alias("dpo"), _r(L.dpo(*cols, 0.1, 0.1)).alias("cdpo"), _r(L.dpo(*cols, 0.1, ipo=True)).alias("ipo"), _r(0.1 * (F.col("c") - F.col("rc"))).alias("chosen_reward"), _r(0.1 * (F.col("j") - F.col("rj"))).alias("rejected_reward")
    )


def dpo_evaluation(spark, folder):
    d = _pairs(spark, folder).withColumn("b", F.floor(F.col("vec_id") / 16))
    s = d.groupBy("b").agg(F.avg(L.dpo(F.col("c"), F.col("j"), F.col("rc"), F.col("rj"), 0.1)).alias("loss"), F.avg(((F.col("c") - F.col("rc")) > (F.col("j") - F.col("rj"))).cast("double")).alias("acc"))
    return s.agg(_r(F.avg("loss")).alias("loss_mean"), _r(F.avg("acc")).alias("acc_mean"))


def pairwise_loss(spark, folder):
    d = _pairs(spark, folder)
    return d.agg(_r(F.avg(L.pairwise(F.col("c"), F.col("j"), F.lit(0.1)))).alias("sigmoid_loss"), _r(F.avg(L.log_exp(F.col("c"), F.col("j")))).alias("log_exp_loss"), _r(F.avg((F.col("c") > F.col("j")).cast("double"))).alias("accuracy"))


def kto_loss(spark, folder):
    d = _pairs(spark, folder)
    kl = d.agg(F.greatest(F.avg(F.col("j") - F.col("rj")), F.lit(0.0)).alias("kl"))
    both = d.crossJoin(F.broadcast(kl))
    return both.agg(_r(F.avg(L.kto_term(F.col("c") - F.col("rc"), F.col("kl"), F.col("good"), 0.1, 1.0, 1.5))).alias("loss"), _r(F.max("kl")).alias("kl"))


def vanilla_kto_loss(spark, folder):
    d = _pairs(spark, folder)
    kls = d.agg(F.greatest(F.avg(F.col("c") - F.col("rc")), F.lit(0.0)).alias("ck"), F.greatest(F.avg(F.col("j") - F.col("rj")), F.lit(0.0)).alias("jk"))
    both = d.crossJoin(F.broadcast(kls))
    one, two = 1 - L.sigmoid(0.1 * (F.col("c") - F.col("rc") - F.col("jk"))), 1 - L.sigmoid(0.1 * (F.col("ck") - (F.col("j") - F.col("rj"))))
    return both.agg(_r((F.sum(one) + F.sum(two)) / (2 * F.count("*"))).alias("loss"))


QUERIES = {
    f.__name__: f
    for f in (
        kl_k1, kl_k3, token_reward, step_reward, gae, discounted_return, return_sum, masked_mean, masked_normalize, adv_normalize, estimator_dispatch, logsumexp_logprob, sequence_logprob, pad_sequences,
        strip_padding, sequence_packing, position_ids, range_position_ids, unpack_sequences, packed_shards, process_masks, label_masking, range_labels, process_labels, prm_step_scores, reward_head, action_logprobs,
        sparse_to_dense, policy_loss, value_loss, lm_loss, lm_evaluation, kd_loss, prm_loss, dpo_loss, dpo_evaluation, pairwise_loss, kto_loss, vanilla_kto_loss,
    )
}

_S = """
WITH s AS (
    SELECT vec_id, label, x, list_reverse(x) AS b, list_transform(x, lambda v: v * 0.5) AS v, list_transform(x, lambda v: v * 0.1) AS r,
           list_transform(range(len(x)), lambda i: CASE WHEN i <= vec_id % len(x) THEN 1 ELSE 0 END) AS m, range(len(x)) AS ix
    FROM (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)
)
"""
_KL = "list_transform(ix, lambda i: (x[i + 1] - b[i + 1]) * m[i + 1])"
_LSE = "(list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))))"
_NLL = f"({_LSE} - x[label + 1])"
_PAIR = _S + """
, p AS (SELECT vec_id, list_sum(x[1:len(x)//2]) AS c, list_sum(x[len(x)//2 + 1:]) AS j, list_sum(v[1:len(x)//2]) AS rc, list_sum(r[len(x)//2 + 1:]) AS rj, label % 2 = 0 AS good FROM s)
, q AS (SELECT *, (c - j) - (rc - rj) AS z FROM p)
"""
_SP = lambda x: f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
_PK = """
WITH i AS (SELECT vec_id // 8 AS pack_id, vec_id, range(vec_id * 10, vec_id * 10 + vec_id % 7 + 1) AS ids FROM embeddings),
p AS (SELECT pack_id, list(ids ORDER BY vec_id) AS parts, list(len(ids) ORDER BY vec_id) AS lengths FROM i GROUP BY 1),
f AS (SELECT pack_id, parts, lengths, flatten(parts) AS flat, flatten(list_transform(range(len(parts)), lambda k: list_transform(parts[k + 1], lambda t: k + 1))) AS seg,
             flatten(list_transform(parts, lambda q: range(len(q)))) AS posn FROM p)
"""
SQL = {
    "kl_k1": f"{_S} SELECT vec_id, round(list_sum({_KL}), 6) AS kl, round(list_sum({_KL}) / list_sum(m), 6) AS kl_mean FROM s",
    "kl_k3": f"{_S} SELECT vec_id, round(list_sum(list_transform({_KL}, lambda k: exp(-k) - 1 + k)), 6) AS kl FROM s",
    "token_reward": f"{_S}, t AS (SELECT vec_id, unnest(ix) AS pos, unnest({_KL}) AS k, vec_id % len(x) AS last, label FROM s) SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(-0.05 * k + CASE WHEN pos = last THEN least(greatest(label, -5), 5) ELSE 0 END, 6) AS reward FROM t",
    "step_reward": f"""{_S}, k AS (SELECT vec_id, label, len(x) AS n, list_transform(ix, lambda i: -0.05 * (x[i + 1] - b[i + 1])) AS kl, least(greatest(x[1] * 4, -1), 1) / 2 AS s1, least(greatest(x[2] * 4, -1), 1) / 2 AS s2,
            CASE vec_id % 3 WHEN 0 THEN len(x) - 1 ELSE 3 END AS p1, CASE vec_id % 3 WHEN 0 THEN 5 ELSE 7 END AS p2, vec_id % 3 <> 2 AS ok, least(greatest(label, -1), 1) AS sparse FROM s)
        SELECT vec_id, round(CASE WHEN ok THEN list_sum(kl) + s1 + s2 ELSE sparse END, 6) AS total,
               round(CASE WHEN ok THEN kl[n] + CASE WHEN p1 = n - 1 THEN s1 ELSE 0 END + CASE WHEN p2 = n - 1 THEN s2 ELSE 0 END ELSE sparse END, 6) AS last,
               round(CASE WHEN ok THEN kl[4] + CASE WHEN p1 = 3 THEN s1 ELSE 0 END ELSE 0 END, 6) AS third FROM k""",
    "gae": f"""{_S}, d AS (SELECT vec_id, ix, list_sum(list_transform(ix, lambda i: v[i + 1] * m[i + 1])) AS vs, list_transform(ix, lambda i: r[i + 1] * m[i + 1] + coalesce(v[i + 2] * m[i + 2], 0) - v[i + 1] * m[i + 1]) AS d FROM s),
        a AS (SELECT vec_id, vs, list_transform(ix, lambda t: list_sum(list_transform(range(t, len(ix)), lambda k: pow(0.95, k - t) * d[k + 1]))) AS a FROM d)
        SELECT vec_id, round(list_sum(a), 6) AS advantage, round(a[1], 6) AS first, round(list_sum(a) + vs, 6) AS returns FROM a""",
    "discounted_return": f"""{_S}, a AS (SELECT vec_id, list_transform(ix, lambda t: list_sum(list_transform(range(t, len(ix)), lambda k: pow(0.9, k - t) * r[k + 1] * m[k + 1]))) AS a FROM s)
        SELECT vec_id, round(a[1], 6) AS first, round(list_sum(a), 6) AS total FROM a""",
    "return_sum": f"{_S} SELECT vec_id, round(list_sum(list_transform(ix, lambda i: r[i + 1] * m[i + 1])), 6) AS return_sum FROM s",
    "masked_mean": f"{_S} SELECT vec_id, round(list_sum(list_transform(ix, lambda i: x[i + 1] * m[i + 1])) / list_sum(m), 6) AS mean FROM s",
    "masked_normalize": f"""{_S}, z AS (SELECT vec_id, m, ix, list_transform(ix, lambda i: x[i + 1] * m[i + 1]) AS z, list_sum(list_transform(ix, lambda i: x[i + 1] * m[i + 1])) / list_sum(m) AS mu FROM s),
        w AS (SELECT vec_id, m, ix, z, mu, list_sum(list_transform(ix, lambda i: (z[i + 1] - mu) * (z[i + 1] - mu) * m[i + 1])) / list_sum(m) AS var FROM z),
        n AS (SELECT vec_id, m, ix, list_transform(z, lambda q: (q - mu) / sqrt(greatest(var, 1e-8))) AS n FROM w)
        SELECT vec_id, round(n[1], 6) AS first, round(n[-1], 6) AS last, round(abs(list_sum(list_transform(ix, lambda i: n[i + 1] * m[i + 1]))), 6) AS sum FROM n""",
    "adv_normalize": f"""{_S}, a AS (SELECT vec_id, m, ix, list_transform(ix, lambda i: x[i + 1] * m[i + 1]) AS a FROM s),
        g AS (SELECT sum(list_sum(a)) / sum(list_sum(m)) AS mu, sum(list_sum(m)) AS n FROM a),
        q AS (SELECT sum(list_sum(list_transform(ix, lambda i: (a[i + 1] - mu) * (a[i + 1] - mu) * m[i + 1]))) / max(n) AS var FROM a, g)
        SELECT vec_id, round((a[1] - mu) / sqrt(greatest(var, 1e-8)), 6) AS first, round(list_sum(list_transform(a, lambda e: (e - mu) / sqrt(greatest(var, 1e-8)))), 6) AS sum FROM a, g, q""",
    "estimator_dispatch": f"""{_S} SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'gae' ELSE 'reinforce' END AS estimator,
        round(list_sum(list_transform(ix, lambda i: r[i + 1] * m[i + 1])) - CASE WHEN vec_id % 2 = 0 THEN v[1] ELSE 0 END, 6) AS advantage FROM s""",
    "logsumexp_logprob": f"{_S} SELECT vec_id, round(-{_NLL}, 6) AS logp FROM s",
    "sequence_logprob": f"{_S} SELECT vec_id, round(list_sum(x[vec_id % 40 + 1:]), 6) AS logp_sum, round(list_sum(x[vec_id % 40 + 1:]) / len(x[vec_id % 40 + 1:]), 6) AS logp_mean FROM s",
    "pad_sequences": f"""{_S}, t AS (SELECT vec_id, vec_id // 8 AS b, x[1:1 + vec_id % 50] AS t FROM s), w AS (SELECT vec_id, t, max(len(t)) OVER (PARTITION BY b) AS n FROM t)
        SELECT vec_id, CAST(n AS INTEGER) AS size, round(CASE WHEN len(t) < n THEN 0 ELSE t[1] END, 6) AS first, round(t[-1], 6) AS last FROM w""",
    "strip_padding": f"""{_S}, p AS (SELECT vec_id, vec_id % 10 AS n, list_concat(list_transform(range(vec_id % 10), lambda i: 0.0), x, list_transform(range(vec_id % 10), lambda i: 0.0)) AS p FROM s)
        SELECT vec_id, CAST(len(p[n + 1:len(p) - n]) AS INTEGER) AS size, round(list_sum(p[n + 1:len(p) - n]), 6) AS total, p[n + 1] AS first FROM p""",
    "sequence_packing": f"""{_PK}, z AS (SELECT pack_id, list_concat(flat, list_transform(range((16 - len(flat) % 16) % 16), lambda q: 0)) AS i, list_concat(seg, list_transform(range((16 - len(flat) % 16) % 16), lambda q: 0)) AS g FROM f)
        SELECT pack_id, CAST(unnest(range(len(i))) AS INTEGER) AS pos, CAST(unnest(i) AS INTEGER) AS id, CAST(unnest(g) AS INTEGER) AS segment FROM z""",
    "position_ids": f"{_PK} SELECT pack_id, CAST(unnest(range(len(flat) + (16 - len(flat) % 16) % 16)) AS INTEGER) AS pos, CAST(unnest(list_concat(posn, list_transform(range((16 - len(flat) % 16) % 16), lambda q: 0))) AS INTEGER) AS position FROM f",
    "range_position_ids": f"{_PK} SELECT pack_id, CAST(unnest(range(len(posn[3:9]))) AS INTEGER) AS pos, CAST(unnest(posn[3:9]) AS INTEGER) AS position FROM f",
    "unpack_sequences": f"{_PK} SELECT pack_id, CAST(k AS INTEGER) AS part, CAST(lengths[k + 1] AS INTEGER) AS n, list_sum(parts[k + 1])::BIGINT AS id_sum, CAST(coalesce(list_sum(lengths[1:k]), 0) AS INTEGER) AS start FROM f, range(8) r(k) WHERE k < len(parts)",
    "packed_shards": f"""{_PK}, z AS (SELECT pack_id, list_concat(flat, list_transform(range((4 - len(flat) % 4) % 4), lambda q: 0)) AS i FROM f)
        SELECT pack_id, CAST(k AS INTEGER) AS rank, CAST(len(i) // 4 AS INTEGER) AS n, list_sum(i[k * (len(i) // 4) + 1:(k + 1) * (len(i) // 4)])::BIGINT AS id_sum FROM z, range(4) r(k)""",
    "process_masks": """
        WITH t AS (SELECT vec_id, 3 + vec_id % 4 AS n, list_concat(list_concat(list_transform(range(vec_id % 3), lambda q: 0), range(10, 21 + vec_id % 5)), list_concat([2], list_transform(range(vec_id % 6), lambda q: 0))) AS t FROM embeddings),
        u AS (SELECT vec_id, n, t, vec_id % 3 AS first, vec_id % 3 + 11 + vec_id % 5 AS eos FROM t)
        SELECT vec_id, CAST(eos - first + 1 AS INTEGER) AS attended, CAST(1 + len(list_filter(t[n + 1:len(t) - 1], lambda q: q <> 2 AND q <> 0)) AS INTEGER) AS actions, CAST(eos AS INTEGER) AS eos FROM u
    """,
    "label_masking": f"{_S} SELECT vec_id, CAST(len(x) - vec_id % 30 AS INTEGER) AS kept, CAST(list_sum(list_transform(ix, lambda i: CASE WHEN i < vec_id % 30 THEN -100 ELSE i END)) AS BIGINT) AS label_sum FROM s",
    "range_labels": """
        SELECT seq, CAST(len(list_filter(range(mx + 6), lambda i: len(list_filter(response_ranges, lambda r: i >= r.start_pos AND i <= r.end_pos)) > 0)) AS INTEGER) AS kept, CAST(mx + 6 AS INTEGER) AS n
        FROM (SELECT seq, response_ranges, list_max(list_transform(response_ranges, lambda r: r.end_pos)) AS mx FROM sft_pairs WHERE response_ranges IS NOT NULL)
    """,
    "process_labels": """
        SELECT vec_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos % 4 = 3 AND pos // 4 < 3 THEN [1.0, -1.0, 0.5][pos // 4 + 1]::DOUBLE ELSE -100.0::DOUBLE END AS label
        FROM (SELECT vec_id, unnest(range(11 + vec_id % 9)) AS pos FROM embeddings)
    """,
    "prm_step_scores": f"""{_S}, t AS (SELECT vec_id, list_transform(list_filter(ix, lambda i: i % 9 = 8), lambda i: x[i + 1] - 0.5) AS t FROM s)
        SELECT vec_id, CAST(len(t) AS INTEGER) AS n_steps, round(list_min(t), 6) AS reward, round(list_sum(t), 6) AS total FROM t""",
    "reward_head": f"{_S} SELECT vec_id, round(x[vec_id % len(x) + 1], 6) AS value, round((x[vec_id % len(x) + 1] - 0.1) / 2.0, 6) AS normalised FROM s",
    "action_logprobs": f"{_S} SELECT vec_id, CAST(greatest(1, vec_id % 20) AS INTEGER) AS n, round(list_sum(x[len(x) - greatest(1, vec_id % 20) + 1:]), 6) AS logp_sum FROM s",
    "sparse_to_dense": f"{_S} SELECT vec_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos = vec_id % n THEN label ELSE 0 END::DOUBLE AS reward FROM (SELECT vec_id, label, len(x) AS n, unnest(ix) AS pos FROM s)",
    "policy_loss": f"""{_S}, t AS (SELECT list_sum(list_transform(ix, lambda i: m[i + 1] * -least((CASE WHEN vec_id % 5 <> 0 THEN exp(x[i + 1] - b[i + 1]) ELSE 1 END) * r[i + 1], least(greatest(CASE WHEN vec_id % 5 <> 0 THEN exp(x[i + 1] - b[i + 1]) ELSE 1 END, 0.8), 1.2) * r[i + 1]))) / list_sum(m) AS l FROM s)
        SELECT round(avg(l), 6) AS loss, count(*) AS n FROM t""",
    "value_loss": f"""{_S}, t AS (SELECT list_sum(list_transform(ix, lambda i: m[i + 1] * 0.5 * greatest(pow(v[i + 1] - r[i + 1], 2), pow(b[i + 1] + least(greatest(v[i + 1] - b[i + 1], -0.2), 0.2) - r[i + 1], 2)))) / list_sum(m) AS l, list_sum(list_transform(ix, lambda i: v[i + 1] * m[i + 1])) AS q, list_sum(m) AS n FROM s)
        SELECT round(avg(l), 6) AS critic_loss, round(sum(q) / sum(n), 6) AS values FROM t""",
    "lm_loss": f"{_S} SELECT round(avg({_NLL}), 6) AS loss, count(*) AS kept FROM s WHERE vec_id % 5 <> 4",
    "lm_evaluation": f"{_S}, g AS (SELECT vec_id // 32 AS b, avg({_NLL}) AS m FROM s GROUP BY 1) SELECT round(avg(m), 6) AS loss_mean, count(*) AS n_batches FROM g",
    "kd_loss": f"""{_S}, k AS (SELECT {_NLL} AS ce, {_LSE} AS lx, x, b, ix FROM s), t AS (SELECT ce, -list_sum(list_transform(ix, lambda i: exp(b[i + 1] - lx) * (x[i + 1] - lx))) AS kd FROM k)
        SELECT round(avg(kd), 6) AS kd_loss, round(avg(0.6 * ce + 0.4 * kd), 6) AS mixed_loss FROM t""",
    "prm_loss": f"""{_S}, t AS (SELECT x[1] AS a, x[2] AS b, label % 2 AS y FROM s)
        SELECT round(avg(greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) - CASE y WHEN 0 THEN a ELSE b END), 6) AS loss, round(avg(CAST(CAST(b > a AS INTEGER) = y AS DOUBLE)), 6) AS acc FROM t""",
    "dpo_loss": f"""{_PAIR} SELECT vec_id, round({_SP('-0.1 * z')}, 6) AS dpo, round({_SP('-0.1 * z')} * 0.9 + {_SP('0.1 * z')} * 0.1, 6) AS cdpo, round(pow(z - 5, 2), 6) AS ipo, round(0.1 * (c - rc), 6) AS chosen_reward, round(0.1 * (j - rj), 6) AS rejected_reward FROM q""",
    "dpo_evaluation": f"{_PAIR}, g AS (SELECT vec_id // 16 AS b, avg({_SP('-0.1 * z')}) AS l, avg(CAST(c - rc > j - rj AS DOUBLE)) AS a FROM q GROUP BY 1) SELECT round(avg(l), 6) AS loss_mean, round(avg(a), 6) AS acc_mean FROM g",
    "pairwise_loss": f"{_PAIR} SELECT round(avg({_SP('-(c - j - 0.1)')}), 6) AS sigmoid_loss, round(avg({_SP('j - c')}), 6) AS log_exp_loss, round(avg(CAST(c > j AS DOUBLE)), 6) AS accuracy FROM q",
    "kto_loss": f"""{_PAIR}, k AS (SELECT greatest(avg(j - rj), 0) AS kl FROM q)
        SELECT round(avg(CASE WHEN good THEN 1 - 1 / (1 + exp(-0.1 * (c - rc - kl))) ELSE 1.5 * (1 - 1 / (1 + exp(-0.1 * (kl - (c - rc))))) END), 6) AS loss, round(max(kl), 6) AS kl FROM q, k""",
    "vanilla_kto_loss": f"""{_PAIR}, k AS (SELECT greatest(avg(c - rc), 0) AS ck, greatest(avg(j - rj), 0) AS jk FROM q)
        SELECT round((sum(1 - 1 / (1 + exp(-0.1 * (c - rc - jk)))) + sum(1 - 1 / (1 + exp(-0.1 * (ck - (j - rj)))))) / (2 * count(*)), 6) AS loss FROM q, k""",
}
