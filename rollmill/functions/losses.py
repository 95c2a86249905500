"""Loss values over given log-probabilities, values and logits (forward only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollmill.functions import arrays as A


def softplus(x: Column) -> Column:
    """log(1 + exp(x)), stable."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_sigmoid(x: Column) -> Column:
    return -softplus(-x)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def pairwise(chosen: Column, rejected: Column, margin: Column | None = None) -> Column:
    return -log_sigmoid(chosen - rejected - (margin if margin is not None else F.lit(0.0)))


def log_exp(chosen: Column, rejected: Column) -> Column:
    """log(1 + exp(rejected - chosen))."""
    return softplus(rejected - chosen)


def dpo(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float, smoothing: float = 0.0, ipo: bool = False) -> Column:
    """Preference loss; with label smoothing, or the squared form."""
    ratio = (chosen - rejected) - (ref_chosen - ref_rejected)
    if ipo:
        return F.pow(ratio - 1 / (2 * beta), F.lit(2.0))
    return -log_sigmoid(beta * ratio) * (1 - smoothing) - log_sigmoid(-beta * ratio) * smoothing


def policy_token(logp: Column, old: Column, advantage: Column, eps: float = 0.2, weight: Column | None = None) -> Column:
    """Clipped policy loss per token (arrays). Rows whose weight is false keep a ratio of 1: they add -advantage and no gradient."""
    ratio = F.zip_with(logp.cast("array<double>"), old.cast("array<double>"), lambda a, b: F.exp(a - b))
    if weight is not None:
        ratio = F.transform(ratio, lambda r: F.when(weight, r).otherwise(F.lit(1.0)))
    return F.zip_with(ratio, advantage.cast("array<double>"), lambda r, a: -F.least(r * a, F.least(F.greatest(r, F.lit(1 - eps)), F.lit(1 + eps)) * a))


def value_token(values: Column, old: Column, returns: Column, eps: float | None = 0.2) -> Column:
    """Half the (clipped) squared error per token (arrays)."""
    pair = F.arrays_zip(values.cast("array<double>").alias("v"), old.cast("array<double>").alias("o"), returns.cast("array<double>").alias("r"))

    def one(x: Column) -> Column:
        plain = F.pow(x["v"] - x["r"], F.lit(2.0))
        if eps is None:
            return 0.5 * plain
        clipped = x["o"] + F.least(F.greatest(x["v"] - x["o"], F.lit(-eps)), F.lit(eps))
        return 0.5 * F.greatest(plain, F.pow(clipped - x["r"], F.lit(2.0)))

    return F.transform(pair, one)


def kd(student: Column, teacher: Column) -> Column:
    """-sum softmax(teacher) * log softmax(student) for one token; infinite student logits count as 0."""
    norms = F.struct(A.log_sum_exp(student).alias("s"), A.log_sum_exp(teacher).alias("t"))
    terms = lambda n: F.zip_with(teacher.cast("array<double>"), student.cast("array<double>"), lambda t, s: F.exp(t - n["t"]) * F.when(F.abs(s) == float("inf"), F.lit(0.0)).otherwise(s - n["s"]))
    return A.let(norms, lambda n: -A.total(terms(n)))


def kto_term(log_ratio: Column, kl: Column, desirable: Column, beta: float, good: float = 1.0, bad: float = 1.0) -> Column:
    return F.when(desirable, good * (1 - sigmoid(beta * (log_ratio - kl)))).otherwise(bad * (1 - sigmoid(beta * (kl - log_ratio))))
