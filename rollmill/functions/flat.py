"""Passes over the flat values of array columns, an Arrow batch at a time: scans and look-ups that expressions can only do in quadratic time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DOUBLES = T.ArrayType(T.DoubleType())


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths (0 for NULL), row of each value, place of each value in its row."""
    lengths = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return lengths, row, np.arange(lengths.sum()) - starts[row]


def _lists(values: pa.Array, lengths: np.ndarray, like: pa.Array) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    mask = like.is_null() if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def _doubles(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = lists.flatten()
    return np.asarray(values.cast(pa.float64()).fill_null(0.0)), np.asarray(values.is_null())


def scan_back(steps: Column, factor: float) -> Column:
    """y[t] = x[t] + factor * y[t + 1], from the end of every row; NULL from a NULL element on towards the front.

    One vector step for each distance from the end, over all rows that are so long: as many operations as there are values.
    """

    @F.arrow_udf(_DOUBLES)
    def run(lists: pa.Array) -> pa.Array:
        lengths, _, _ = _flat(lists)
        x, gone = _doubles(lists)
        y, bad, ends = x.copy(), gone.copy(), np.cumsum(lengths)
        order = np.argsort(-lengths, kind="stable")
        shorter = -lengths[order]
        for back in range(1, int(lengths.max(initial=0))):
            own = order[: np.searchsorted(shorter, -back, "left")]  # rows of more than ``back`` values
            at = ends[own] - 1 - back
            y[at] += factor * y[at + 1]
            bad[at] |= bad[at + 1]
        return _lists(pa.array(y, mask=bad), lengths, lists)

    return run(steps)


def _first_places(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For every value the place in the flat array where its row has that value first."""
    if not len(row):
        return row
    _, code = np.unique(value, return_inverse=True)
    _, first, again = np.unique(row * np.int64(code.max() + 1) + code, return_index=True, return_inverse=True)
    return first[again]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def positions_in_segments(segments: pa.Array) -> pa.Array:
    """Places counted from the first element of the same segment; 0 in segment 0 and for NULL elements."""
    lengths, row, _ = _flat(segments)
    value = np.asarray(segments.flatten().fill_null(0), dtype=np.int64)
    place = np.arange(len(value)) - _first_places(row, value)
    return _lists(pa.array(np.where(value == 0, 0, place).astype(np.int32)), lengths, segments)


def labels_at(ids: Column, labels: Column, placeholder: int, ignore: float) -> Column:
    """Label k on the k-th placeholder of every row, ``ignore`` elsewhere and where labels are missing or NULL."""

    @F.arrow_udf(_DOUBLES)
    def run(tokens: pa.Array, values: pa.Array) -> pa.Array:
        lengths, row, _ = _flat(tokens)
        many, _, _ = _flat(values)
        label, gone = _doubles(values)
        here = np.asarray(tokens.flatten().fill_null(placeholder + 1), dtype=np.int64) == placeholder
        count = np.cumsum(here)
        before = np.concatenate([[0], count])[(np.cumsum(lengths) - lengths)[row]]
        number = count - before - 1
        known = here & (number < many[row])
        out = np.full(len(here), float(ignore))
        at = (np.cumsum(many) - many)[row[known]] + number[known]
        out[known] = np.where(gone[at], float(ignore), label[at])
        return _lists(pa.array(out), lengths, tokens)

    return run(ids, labels)


def repeated_marks(items: Column, n: int, penalty: float, only_start: bool) -> Column:
    """Per element ``penalty`` if it lies in an n-gram that its row had before, else 0. With ``only_start`` a repeated n-gram counts if it
    starts behind the end of the repeated one before it, counted or not."""

    @F.arrow_udf(_DOUBLES)
    def run(lists: pa.Array) -> pa.Array:
        lengths, row, place = _flat(lists)
        words = lists.flatten().dictionary_encode()
        code = np.asarray(words.indices.fill_null(len(words.dictionary)), dtype=np.int64)
        starts = np.flatnonzero(place + n <= lengths[row])
        gram = code[starts]
        for k in range(1, n):
            _, gram = np.unique(gram, return_inverse=True)
            gram = gram * np.int64(len(words.dictionary) + 1) + code[starts + k]
        again = starts[_first_places(row[starts], gram) < np.arange(len(starts))] if len(starts) else starts
        if only_start and len(again):
            far = np.ones(len(again), bool)
            far[1:] = (row[again[1:]] != row[again[:-1]]) | (again[1:] > again[:-1] + n)
            again = again[far]
        change = np.zeros(len(code) + 1, np.int64)
        np.add.at(change, again, 1)
        np.add.at(change, again + n, -1)
        return _lists(pa.array(np.where(np.cumsum(change[:-1]) > 0, float(penalty), 0.0)), lengths, lists)

    return run(items)
