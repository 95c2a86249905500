"""Mixing sources to target weights: tempered weights, then budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollmill.plans.store import written

#: Documents of a block, about. Only the block at which a budget ends is looked at document by document.
BLOCK_ROWS = 20_000
#: The targets are a stated table of at most so many rows; more are refused.
MAX_TARGETS = 100_000


def entropy(weights: Sequence[float]) -> float:
    w = np.asarray([x for x in weights if x > 0], float)
    w = w / w.sum() if len(w) else w
    return float(-(w * np.log(w)).sum())


def temperature_weights(tokens: Sequence[float], target_entropy: float | None = None, exponent: float | None = None) -> tuple[np.ndarray, float]:
    """Source weights in proportion to (token share) ** exponent; the exponent is given or bisected so that they have the target entropy.

    1 keeps the natural shares, 0 makes all sources with tokens equal. Entropy falls as the exponent rises, so the bisection over
    [0, 64] is exact up to 1e-12; targets beyond what that range reaches give its nearest end. Sources without tokens weigh 0.
    """
    share = np.asarray(tokens, float)
    share = share / share.sum() if share.sum() > 0 else share
    there = share > 0

    def at(a: float) -> np.ndarray:
        out = np.zeros(len(share))
        if there.any():
            log = a * np.log(share[there])
            w = np.exp(log - log.max())
            out[there] = w / w.sum()
        return out

    if exponent is None:
        low, high = 0.0, 64.0
        if target_entropy is None:
            raise ValueError("give an exponent or a target entropy")
        if entropy(at(low)) <= target_entropy:
            high = low
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if entropy(at(middle)) > target_entropy else (low, middle)
            if high - low < 1e-12:
                break
        exponent = (low + high) / 2
    return at(exponent), exponent


def _bisect(holds, low: float = 0.0, high: float = 1.0) -> tuple[float, float]:
    """The two ends, 2 ** -60 apart, of the border between exponents at which ``holds`` is as at ``low`` and the others."""
    first = holds(low)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) == first else (low, middle)
    return low, high


def tempered_targets(
    tokens: Sequence[float], targets: Sequence[float], repeats: Sequence[float], budget: float | None = None, tolerance: float = 0.0
) -> tuple[np.ndarray, float, float]:
    """Weights, exponent and token budget of a mix that keeps every source within its repetition limit.

    Weights are tempered from the targets (of the sources that have tokens, scaled to 1) towards the natural token shares, in
    proportion to target * (share / target) ** exponent: the exponent 0 gives the targets, 1 the natural shares. At each exponent the
    repetition limits (``repeats`` times a source's tokens) allow some largest budget. Without a stated budget, the exponents at which
    every weight is within ``tolerance`` (in proportion) of its target are found by bisection, and the budget is the largest that they allow. The
    exponent is then the smallest, found by bisection, at which the budget keeps the repetition limits: 0 if the targets themselves do.
    A budget beyond what any exponent allows is cut to the largest that one does.
    """
    t, q, r = (np.asarray(x, float) for x in (tokens, targets, repeats))
    there = (t > 0) & (q > 0) & (r > 0)
    weights = np.zeros(len(t))
    if not there.any():
        return weights, 0.0, 0.0
    share, goal = t[there] / t[there].sum(), q[there] / q[there].sum()
    limit = t[there] * r[there]

    def at(a: float) -> np.ndarray:
        w = goal * (share / goal) ** a
        return w / w.sum()

    def allowed(a: float) -> float:
        return float((limit / at(a)).min())

    end = 1.0
    if budget is None:
        near = lambda a: bool((np.abs(at(a) / goal - 1) <= tolerance).all())
        if not near(1.0):
            end = _bisect(near)[0]
        budget = max(allowed(a) for a in np.linspace(0.0, end, 65))
    budget, exponent = min(float(budget), max(allowed(0.0), *(allowed(a) for a in np.linspace(0.0, end, 65)))), 0.0
    if budget > allowed(0.0):
        best = min((a for a in np.linspace(0.0, end, 65) if allowed(a) >= budget), default=end)
        exponent = _bisect(lambda a: allowed(a) >= budget, 0.0, float(best))[1]
    weights[there] = at(exponent)
    return weights, exponent, budget


def larger_budget(tokens: Sequence[float], targets: Sequence[float], repeats: Sequence[float], reach: float) -> float:
    """The token budget that lies the share ``reach`` of the way from the largest at which the targets hold to the largest that any exponent allows."""
    exact, natural = tempered_targets(tokens, targets, repeats)[2], tempered_targets(tokens, targets, repeats, math.inf)[2]
    return exact + reach * max(0.0, natural - exact)


def fill_gap(rows: pd.DataFrame, gap: float) -> pd.DataFrame:
    """Of rows in permuted order, those that fit one after another into ``gap`` tokens; one more if that comes nearer."""
    rows = rows.sort_values(["u", "id"], kind="stable")
    size = rows["n_tokens"].to_numpy()
    left, take = gap, np.zeros(len(rows), bool)
    for k, s in enumerate(size):
        if s <= left:
            take[k] = True
            left -= s
    rest = np.flatnonzero(~take)
    if len(rest):
        k = rest[size[rest].argmin()]
        take[k] = abs(left - size[k]) < left
    return rows[take]


def of_listed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows whose ``source`` is listed in ``targets``: a map-side join with at most MAX_TARGETS names."""
    listed = targets.where(F.col("mix").isNotNull() & F.col("source").isNotNull()).select("source").distinct().limit(MAX_TARGETS)
    return rows.join(F.broadcast(listed), "source", "left_semi")


def _plan(sizes: DataFrame, targets: DataFrame, budgets: dict[str, float] | None, reach: float, tolerance: float) -> tuple[list[dict], dict[str, tuple[int, int]]]:
    """Weights and passes of every (mix, source) of ``targets``, a stated table; totals of those sources, one row each, come to the driver."""
    goals = targets.where(F.col("mix").isNotNull() & F.col("source").isNotNull()).select("mix", "source", "target_share", "max_repeats").limit(MAX_TARGETS + 1).collect()
    if len(goals) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    totals = {r.source: (int(r.t), int(r.c)) for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c")).collect()}
    plan = []
    for mix in sorted({g.mix for g in goals}):
        own = sorted((g for g in goals if g.mix == mix), key=lambda g: g.source)
        tokens = [totals.get(g.source, (0, 0))[0] for g in own]
        wishes, limits = [g.target_share or 0 for g in own], [g.max_repeats or 0 for g in own]
        stated = (budgets or {}).get(mix)
        if stated is None and reach > 0:
            stated = larger_budget(tokens, wishes, limits, reach)
        weights, exponent, budget = tempered_targets(tokens, wishes, limits, stated, tolerance)
        for g, t, w in zip(own, tokens, weights):
            wanted = min(w * budget, t * (g.max_repeats or 0))
            passes = int(math.floor(wanted / t + 1e-9)) if t else 0
            plan.append(dict(mix=mix, source=g.source, target_share=g.target_share, max_repeats=g.max_repeats, weight=float(w), exponent=float(exponent), passes=passes, rest=float(max(0.0, wanted - passes * t))))
    return plan, totals


def mix_sources(sizes: DataFrame, id: str, targets: DataFrame, budgets: dict[str, float] | None = None, seed: int = 17, reach: float = 0.0, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Two tables: uses of documents (``mix``, ``source``, ``id``, ``pass_no``, ``n_tokens``) and shares reached, one row per (mix, source).

    ``sizes`` has ``id``, ``source``, ``n_tokens``; ``targets`` has ``mix``, ``source``, ``target_share``, ``max_repeats`` (both unique per
    id and per mix and source). No document occurs more often in a mix than its source's ``max_repeats``. A listed source without
    documents has share 0 and the others keep their proportions. Documents of unlisted or null sources, null ids and documents without
    tokens are left out; empty tables give empty results; other columns aren't read.

    Weights and budget come from :func:`tempered_targets`; mixes without a stated budget take that of :func:`larger_budget` where ``reach``
    is above 0, else the largest at which all weights are within ``tolerance`` of their targets. Only documents of listed sources are sized (``sizes`` may be a lazy plan: its other rows are filtered out first) and
    written, once; more than ``MAX_TARGETS`` targets are refused. A source is used in whole passes while its budget lasts. The last, partial
    pass follows a seeded permutation: documents fall into blocks by hash, blocks are taken whole while the running block totals fit,
    and only the block in which the budget ends (about ``BLOCK_ROWS`` documents) is chosen document by document. No source is ever
    gathered or sorted as a whole, however large.
    """
    spark = sizes.sparkSession
    rows = sizes.where(F.col(id).isNotNull() & F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    rows = rows.select(F.col(id).alias("id"), "source", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    rows = written(of_listed(rows, targets), "sizes")
    plan, totals = _plan(rows, targets, budgets, reach, tolerance)
    schema = "mix string, source string, target_share double, max_repeats int, weight double, exponent double, passes int, rest double, blocks int"
    listed = spark.createDataFrame([tuple({**p, "blocks": max(1, -(-totals.get(p["source"], (0, 0))[1] // BLOCK_ROWS))}.values()) for p in plan], schema)

    used = rows.join(F.broadcast(listed.select("mix", "source", "passes", "rest", "blocks")), "source").withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix", "id"), 11) / F.lit(float(1 << 53)))
    used = used.withColumn("block", F.floor(F.col("u") * F.col("blocks")).cast("int"))
    whole = used.where(F.col("passes") > 0).select("mix", "source", "id", F.explode(F.sequence(F.lit(1), "passes")).alias("pass_no"), "n_tokens")
    partial = used.where(F.col("rest") > 0)
    running = Window.partitionBy("mix", "source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    block_totals = partial.groupBy("mix", "source", "rest", "block").agg(F.sum("n_tokens").alias("t")).withColumn("until", F.sum("t").over(running))
    ends = block_totals.where(F.col("until") - F.col("t") <= F.col("rest")).groupBy("mix", "source").agg(F.max(F.struct("block", (F.col("rest") - F.col("until") + F.col("t")).alias("gap"))).alias("x"))
    ends = ends.select("mix", "source", F.col("x.block").alias("last"), F.col("x.gap").alias("gap"))
    marked = partial.join(F.broadcast(ends), ["mix", "source"])
    blocks = marked.where(F.col("block") < F.col("last")).select("mix", "source", "id", (F.col("passes") + 1).alias("pass_no"), "n_tokens")
    type_of_id = sizes.schema[id].dataType.simpleString()
    edge = marked.where(F.col("block") == F.col("last")).select("mix", "source", "id", (F.col("passes") + 1).alias("pass_no"), "n_tokens", "u", "gap")
    chosen = edge.groupBy("mix", "source").applyInPandas(
        lambda pdf: fill_gap(pdf, float(pdf["gap"].iloc[0]))[["mix", "source", "id", "pass_no", "n_tokens"]], f"mix string, source string, id {type_of_id}, pass_no int, n_tokens bigint"
    )
    uses = whole.union(blocks).union(chosen)
    sums = uses.groupBy("mix", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"), F.max("pass_no").alias("most_uses"))
    whole_mix = Window.partitionBy("mix")
    shares = (
        listed.join(sums, ["mix", "source"], "left")
        .withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast("bigint")))
        .select(
            "mix", "source", "target_share", "weight", "exponent", "max_repeats", F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"), "n_tokens",
            F.try_divide(F.col("n_tokens").cast("double"), F.sum("n_tokens").over(whole_mix).cast("double")).alias("actual_share"),
        )
    )
    return uses.withColumnRenamed("id", id), shares
