"""Shaped rewards by length, correctness and repetition."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollmill.functions import flat

#: Fixed value: tokens that must be left before the length limit.
MARGIN = 16


def too_long(length: Column, limit: int) -> Column:
    return length + MARGIN >= limit


def classic(length: Column, correct: Column, limit: int, right: float = 1.0, wrong: float = 0.0, exceed: float | None = None) -> Column:
    value = F.when(correct, F.lit(right)).otherwise(F.lit(wrong))
    return value if exceed is None else F.when(too_long(length, limit), F.lit(exceed)).otherwise(value)


def cosine(length: Column, correct: Column, limit: int, right: tuple[float, float], wrong: tuple[float, float], exceed: float = 0.0, penalty: Column | None = None) -> Column:
    """Between (least, most) along half a cosine of length / limit: short right answers and long wrong ones fare best."""
    wave = 0.5 * (1 + F.cos(length / limit * math.pi))
    good = right[0] + (right[1] - right[0]) * wave
    bad = wrong[1] + (wrong[0] - wrong[1]) * wave + (penalty if penalty is not None else 0.0)
    return F.when(too_long(length, limit), F.lit(exceed)).when(correct, good).otherwise(bad)


def length_scaled(length: Column, correct: Column, limit: int, risk: float = 1.0, exceed: float = 0.0) -> Column:
    c = length / limit
    return F.when(too_long(length, limit), F.lit(exceed)).when(correct, (risk + (1 - risk) * c) * (1 - c)).otherwise(c - 1)


def repetition_dense(items: Column, n: int, penalty: float, only_start: bool = False) -> Column:
    """Per position the penalty if it lies in an n-gram that occurred before; with ``only_start``, runs count from their starts only.

    With ``only_start`` a repeated n-gram counts if it starts behind the end of the repeated n-gram before it, counted or not.
    """
    return flat.repeated_marks(items, n, penalty, only_start)


#: Sparse rewards, and the dense one, by name.
REWARDS = {"classic": classic, "cosine": cosine, "length_scaled": length_scaled, "repetition": repetition_dense}
def combined(parts: list[Column], weights: list[float] | None = None, rule: Callable[[list[Column]], Column] | None = None) -> Column:
    """One reward of several models: their (weighted) sum, or what another rule makes of them. A NULL part makes the sum NULL."""
    if not parts or (weights is not None and len(weights) != len(parts)):
        raise ValueError("as many weights as rewards are needed, and one at least")
    if rule is not None:
        return rule(parts)
    scaled = parts if weights is None else [p * w for p, w in zip(parts, weights)]
    return reduce(lambda a, b: a + b, scaled)


def shaped(name: str, score: Callable[[Column, Column], Column], prediction: Column, reference: Column, length: Column, limit: int, **options) -> Column:
    """A sparse reward by name, its correctness given by a score function of the caller's: right where the score is above one half."""
    right = F.coalesce(score(prediction, reference) > 0.5, F.lit(False))
    return REWARDS[name](length, right, limit, **options)


#: The addresses that name a rule-based reward, and how all of them begin.
ADDRESSES = {"math_rule": "classic", "math_rule_cosine_scale": "cosine", "math_rule_len_scale": "length_scaled", "math_rule_repetition_dense": "repetition"}
RULE_ADDRESS = "math_rule"


def selected(address: str):
    """(name, reward) that an address names; None for addresses of other kinds. A rule-based address that is unknown raises."""
    if not address.startswith(RULE_ADDRESS):
        return None
    if address not in ADDRESSES:
        raise ValueError(f"unknown reward {address!r}; known: {', '.join(ADDRESSES)}")
    return ADDRESSES[address], REWARDS[ADDRESSES[address]]
