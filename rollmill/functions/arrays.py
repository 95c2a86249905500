"""Ragged per-token arrays: padding, packing, masks, KL, rewards, returns. All are Column expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollmill.functions import flat


def _d(x: Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    """Sum of an array; 0 for an empty one."""
    return F.aggregate(_d(x), F.lit(0.0), lambda a, v: a + v)


def indexes(x: Column) -> Column:
    """[0, 1, ..., size - 1]; empty for an empty array."""
    return F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))


def pad(x: Column, length: Column, fill, side: str = "left") -> Column:
    """The array filled up to ``length``; longer arrays stay as they are."""
    more = F.array_repeat(F.lit(fill), F.greatest(length - F.size(x), F.lit(0)).cast("int"))
    return F.concat(more, x) if side == "left" else F.concat(x, more)


def unpad(x: Column, left: Column, right: Column) -> Column:
    """The array without its first ``left`` and last ``right`` elements."""
    return F.slice(x, (left + 1).cast("int"), F.greatest(F.size(x) - left - right, F.lit(0)).cast("int"))


def pack(parts: Column) -> Column:
    """One row of many: the concatenation of an array of arrays."""
    return F.flatten(parts)


def segments(parts: Column) -> Column:
    """For every packed element the 1-based number of its part."""
    return F.flatten(F.transform(parts, lambda p, i: F.array_repeat(i + 1, F.size(p))))


def multiple(x: Column, of: int, fill) -> Column:
    """The array filled up on the right to a multiple of ``of``."""
    return F.concat(x, F.array_repeat(F.lit(fill), F.pmod(-F.size(x), F.lit(of)).cast("int")))


def cumulative_lengths(lengths: Column) -> Column:
    """Leading 0 and running sums, so that part i spans [c[i], c[i+1])."""
    return F.aggregate(lengths.cast("array<int>"), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def unpack(x: Column, lengths: Column) -> Column:
    """The parts of a packed row, by their lengths."""
    starts = cumulative_lengths(lengths)
    return F.transform(lengths, lambda n, i: F.slice(x, F.get(starts, i) + 1, n))


def position_ids(segment: Column) -> Column:
    """Positions that restart in every segment; 0 where the segment is 0 (padding)."""
    return flat.positions_in_segments(segment.cast("array<bigint>"))


def position_ids_of_range(lengths: Column, start: Column, end: Column) -> Column:
    """Position ids of elements [start, end) of a packed row with these part lengths."""
    full = F.flatten(F.transform(lengths, lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    return F.slice(full, start + 1, end - start)


def shard_of(x: Column, rank: Column, ranks: int) -> Column:
    """The contiguous share of a rank: size / ranks elements each."""
    each = F.floor(F.size(x) / ranks).cast("int")
    return F.slice(x, (rank * each + 1).cast("int"), each)


def attention_mask(tokens: Column, prompt_length: Column, eos: int, pad_id: int) -> Column:
    """1 from the first real token to the end-of-sequence position: the first one after the last real token that isn't eos."""
    first = F.coalesce(F.array_position(F.transform(tokens, lambda t: (t != pad_id).cast("int")), 1), F.lit(1)) - 1
    ends = F.struct(first.alias("first"), eos_index(tokens, eos, pad_id).alias("last"))
    return let(ends, lambda e: F.transform(tokens, lambda t, i: ((i >= e["first"]) & (i <= e["last"])).cast("int")))


def eos_index(tokens: Column, eos: int, pad_id: int) -> Column:
    """0-based place of the closing eos: right after the last token that is neither eos nor padding, at most the last place."""
    real = F.transform(tokens, lambda t, i: F.when((t != eos) & (t != pad_id), i).otherwise(F.lit(-1)))
    return F.least(F.array_max(real) + 1, F.size(tokens) - 1)


def action_mask(tokens: Column, prompt_length: Column, eos: int, pad_id: int) -> Column:
    """Over the state shifted by one: 1 where an answer token was produced from a token that is neither eos nor padding; the first is always 1."""
    state = F.slice(tokens, prompt_length.cast("int"), F.size(tokens) - prompt_length.cast("int"))
    return F.transform(state, lambda t, i: F.when(i == 0, F.lit(1)).otherwise(((t != eos) & (t != pad_id)).cast("int")))


def masked(x: Column, mask: Column) -> Column:
    return F.zip_with(_d(x), _d(mask), lambda v, m: v * m)


def masked_mean(x: Column, mask: Column) -> Column:
    """Mean over unmasked elements; NULL if all are masked."""
    return F.try_divide(total(masked(x, mask)), total(mask))


def masked_normalise(x: Column, mask: Column, eps: float = 1e-8) -> Column:
    """Masked elements are zeroed, then the masked mean is taken from all and all are divided by the root of the masked variance."""
    one = let(F.struct(masked(x, mask).alias("z"), total(mask).alias("n")), lambda a: F.struct(a["z"].alias("z"), a["n"].alias("n"), F.try_divide(total(a["z"]), a["n"]).alias("mean")))
    two = let(
        one,
        lambda a: F.struct(
            a["z"].alias("z"), a["mean"].alias("mean"), F.try_divide(total(masked(F.transform(a["z"], lambda v: (v - a["mean"]) * (v - a["mean"])), mask)), a["n"]).alias("var")
        ),
    )
    return let(two, lambda a: F.transform(a["z"], lambda v: (v - a["mean"]) / F.sqrt(F.greatest(a["var"], F.lit(eps)))))


def approx_kl(logp: Column, base: Column, mask: Column | None = None, k3: bool = False) -> Column:
    """Per-token KL estimate: the log ratio, or exp(-ratio) - 1 + ratio."""
    ratio = F.zip_with(_d(logp), _d(base), lambda a, b: a - b)
    ratio = masked(ratio, mask) if mask is not None else ratio
    return F.transform(ratio, lambda r: F.exp(-r) - 1 + r) if k3 else ratio


def last_active(mask: Column) -> Column:
    """0-based place of the last 1; -1 if there is none."""
    return F.array_max(F.concat(F.transform(mask, lambda m, i: F.when(m > 0, i).otherwise(F.lit(-1))), F.array(F.lit(-1))))


def at_place(size_of: Column, place: Column, value: Column) -> Column:
    """Zeros but for one place."""
    return let(place, lambda p: F.transform(size_of, lambda _, i: F.when(i == p, value).otherwise(F.lit(0.0))))


def token_rewards(reward: Column, coefficient: float, kl: Column, mask: Column, low: float | None = None, high: float | None = None) -> Column:
    """-coefficient * KL on every token, and the (clipped) reward on the last active one. A coefficient <= 0 counts as 0."""
    r = reward if low is None else F.least(F.greatest(reward, F.lit(low)), F.lit(high))
    return let(last_active(mask), lambda p: F.transform(_d(kl), lambda v, i: -F.lit(float(max(coefficient, 0.0))) * v + F.when(i == p, r).otherwise(F.lit(0.0))))


def step_rewards(reward: Column, coefficient: float, kl: Column, places: Column, scores: Column, low: float, high: float) -> Column:
    """Clipped step scores, each divided by the number of steps, on their (possibly negative) places, over -coefficient * KL.

    Where the numbers of places and scores differ or a place lies outside, the row is the clipped reward on its last token, without KL.
    """
    n = F.size(kl)
    ok = (F.size(places) == F.size(scores)) & ~F.exists(places, lambda p: (p >= n) | (p < -n))
    clipped = F.transform(_d(scores), lambda s: F.least(F.greatest(s, F.lit(low)), F.lit(high)) / F.size(scores))
    at = F.transform(places, lambda p: F.when(p < 0, p + n).otherwise(p))

    def placed(steps: Column) -> Column:
        here = lambda i: F.aggregate(F.filter(steps, lambda x: x["p"] == i), F.lit(0.0), lambda a, x: a + x["s"])
        return F.transform(_d(kl), lambda v, i: -F.lit(float(max(coefficient, 0.0))) * v + here(i))

    stepped = let(F.zip_with(at, clipped, lambda p, s: F.struct(p.alias("p"), s.alias("s"))), placed)
    sparse = at_place(_d(kl), n - 1, F.least(F.greatest(reward, F.lit(low)), F.lit(high)))
    return F.when(ok, stepped).otherwise(sparse)


def discounted_returns(rewards: Column, mask: Column | None = None, gamma: float = 1.0) -> Column:
    """Return to go; the mask multiplies the rewards first."""
    return flat.scan_back(masked(rewards, mask) if mask is not None else _d(rewards), gamma)


def gae(values: Column, rewards: Column, mask: Column | None = None, gamma: float = 1.0, lam: float = 0.95) -> Column:
    """Generalised advantages; the mask multiplies values and rewards first. Returns are advantages plus values."""
    v = masked(values, mask) if mask is not None else _d(values)
    r = masked(rewards, mask) if mask is not None else _d(rewards)
    nxt = F.concat(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.array(F.lit(0.0)))
    delta = F.zip_with(F.zip_with(r, nxt, lambda a, b: a + gamma * b), v, lambda a, b: a - b)
    return flat.scan_back(delta, gamma * lam)


def log_sum_exp(x: Column) -> Column:
    return let(F.array_max(_d(x)), lambda top: top + F.log(total(F.transform(_d(x), lambda v: F.exp(v - top)))))


def label_log_prob(logits: Column, label: Column) -> Column:
    """log softmax of the logits at a 0-based label."""
    return F.get(_d(logits), label) - log_sum_exp(logits)


def sequence_log_prob(logps: Column, prompt_length: Column, mean: bool = False) -> Column:
    """Sum or mean of the log-probabilities after the prompt."""
    answer = F.slice(_d(logps), (prompt_length + 1).cast("int"), F.greatest(F.size(logps) - prompt_length, F.lit(0)).cast("int"))
    return F.try_divide(total(answer), F.size(answer)) if mean else total(answer)


def mask_labels(ids: Column, prompt_length: Column, ignore: int = -100) -> Column:
    """Labels with the prompt's places set to ``ignore``."""
    return F.transform(ids, lambda t, i: F.when(i < prompt_length, F.lit(ignore)).otherwise(t))


def mask_labels_by_ranges(ids: Column, ranges: Column, ignore: int = -100) -> Column:
    """Labels kept only inside the (inclusive) ranges of structs start_pos, end_pos."""
    return F.transform(ids, lambda t, i: F.when(F.exists(ranges, lambda r: (i >= r["start_pos"]) & (i <= r["end_pos"])), t).otherwise(F.lit(ignore)))


def value_head(values: Column, mask: Column, mean: float | None = None, std: float | None = None) -> Column:
    """The value at the last real token, normalised by stored statistics on request."""
    v = F.get(_d(values), last_active(mask))
    return v if mean is None else (v - mean) / std


def action_slice(logps: Column, n_actions: Column) -> Column:
    """The last ``n_actions`` elements."""
    return F.slice(_d(logps), (F.size(logps) - n_actions + 1).cast("int"), n_actions.cast("int"))


def placeholder_labels(ids: Column, placeholder: int, labels: Column, ignore: int = -100) -> Column:
    """Label k on the k-th placeholder token, ``ignore`` elsewhere; surplus labels are dropped, missing ones are ``ignore``."""
    return flat.labels_at(ids.cast("array<bigint>"), _d(labels), placeholder, ignore)


def step_scores(tokens: Column, scores: Column, tag: int) -> Column:
    """Scores at the step-tag tokens, minus one half."""
    return F.transform(F.filter(F.arrays_zip(tokens.alias("t"), scores.alias("s")), lambda x: x["t"] == tag), lambda x: x["s"].cast("double") - 0.5)
