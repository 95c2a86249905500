"""Evaluation text inside training text: spaced-seed hashing and substitution-tolerant verification."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.llm.normal import _WORD, plain, words

#: Spaced seeds: offsets of the word positions that a mask reads. Positions between them may hold any word.
MASKS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: A quote is WANTED words of some WINDOW successive words of an item.
WINDOW, WANTED = 18, 15
#: Seeds of one item that a quote hits at least, over all masks: 15 words in up to 7 runs have a run of 3 words.
LEAST_HITS = 1
#: How far missing and inserted words may push words from the shift of a hit.
SLACK = 3
#: Shifts so near each other are aligned together; what lies further apart must be parted by a single sentence, of any length.
REACH = 48
#: Characters of the items that are held in memory at once; larger sets are searched in blocks of about this size.
BLOCK_CHARACTERS = 20_000_000
#: Words of texts that are gone through with one block after another, where there are several.
GROUP_WORDS = 1_000_000


_END = re.compile(r"[.!?…。]+[\"'”»)\]]*\s|\n\s*\S")


class Seeds:
    """The seeds of a block of items: word numbers, and for every seed the (item, position) pairs that have it."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids = np.array([i for i, _ in items], np.int64)
        self.items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(t)], np.int64) for _, t in items]
        self.base = np.int64(len(self.vocabulary) + 1)
        owner = [(k, p) for k, item in enumerate(self.items) for p in range(len(item))]
        self.tables = []
        flat = np.concatenate([np.concatenate([x, np.full(4, -1, np.int64)]) for x in self.items]) if self.items else np.zeros(0, np.int64)
        place = np.full((len(flat), 2), -1, np.int64)
        place[flat >= 0] = np.array(owner, np.int64).reshape(-1, 2)
        for mask in MASKS:
            at, code = self.codes(flat, mask)
            order = np.argsort(code, kind="stable")
            self.tables.append((code[order], place[at[order]]))

    def codes(self, flat: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which all words of the mask are known, and their seeds."""
        span = len(flat) - mask[-1]
        if span <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts = [flat[o : o + span] for o in mask]
        at = np.flatnonzero(np.logical_and.reduce([x >= 0 for x in parts]))
        code = np.zeros(len(at), np.int64)
        for x in parts:
            code = code * self.base + x[at]
        return at, code

    def hits(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (text position, item, item position) at which text and item share a seed."""
        out = []
        for mask, (table, place) in zip(MASKS, self.tables):
            at, code = self.codes(flat, mask)
            low = np.searchsorted(table, code, "left")
            many = np.searchsorted(table, code, "right") - low
            keep = many > 0
            at, low, many = at[keep], low[keep], many[keep]
            if len(at):
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                found = place[np.repeat(low, many) + step]
                out.append((np.repeat(at, many), found[:, 0], found[:, 1]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))


def _band(shifts: np.ndarray) -> np.ndarray:
    """The shifts within SLACK of the given ones."""
    return np.unique(shifts[:, None] + np.arange(-SLACK, SLACK + 1))


def _same(item: np.ndarray, text: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Whether the word of the item (second axis) stands in the text at that shift (first axis)."""
    at = np.arange(len(item)) + band[:, None]
    return (text[np.clip(at, 0, len(text) - 1)] == item) & (at >= 0) & (at < len(text))


def _align(same: np.ndarray, band: np.ndarray, windows: np.ndarray, wide: int) -> np.ndarray:
    """The longest common subsequence of the first 0 to ``wide`` words of each window with the text, along the band (windows x words)."""
    best = np.zeros((len(windows), len(band)), np.int64)  # by shift of the last word
    step = np.diff(band) == 1  # a missing word goes one shift down
    out = np.zeros((len(windows), wide + 1), np.int64)
    for o in range(wide):
        kept = best + same[:, windows + o].T
        kept[:, :-1] = np.maximum(kept[:, :-1], np.where(step, best[:, 1:], 0))
        best = np.maximum.accumulate(kept, 1)  # inserted words go up
        out[:, o + 1] = best[:, -1]
    return out


def quoted(item: np.ndarray, text: np.ndarray, shifts: np.ndarray, breaks=None) -> bool:
    """Whether WANTED of some WINDOW words of the item stand in the text in order, within SLACK of the given shifts (text minus item position).

    Shifts more than REACH apart count together if a single sentence lies between the two parts: ``breaks()`` gives, for every word
    and the end of the text, how many sentences end before it.
    """
    if len(item) < WANTED:
        return False
    shifts, wide = np.unique(shifts), min(WINDOW, len(item))
    clusters = []
    for k, s in enumerate(shifts):
        near = shifts[k : np.searchsorted(shifts, s + REACH, "right")]
        band = _band(near)
        same = _same(item, text, band)
        clusters.append((s, band, same))
        run = np.concatenate([[0], np.cumsum(same.any(0))])
        windows = np.flatnonzero(run[wide:] - run[:-wide] >= WANTED)
        if not len(windows):
            continue
        straight = np.concatenate([np.zeros((len(band), 1), int), np.cumsum(same, 1)], 1)
        if (straight[:, wide:] - straight[:, :-wide]).max() >= WANTED:
            return True
        if _align(same, band, windows, wide)[:, -1].max() >= WANTED:
            return True
    if breaks is None or shifts[-1] - shifts[0] <= REACH:
        return False
    windows, ends = np.arange(len(item) - wide + 1), breaks()
    before = [_align(same, band, windows, wide) for _, band, same in clusters]
    # The other part, read from its end: words and shifts turned around.
    after = [_align(same[::-1, ::-1], -band[::-1], len(item) - wide - windows, wide)[:, ::-1] for _, band, same in clusters]
    split = windows[:, None] + np.arange(wide + 1)
    for x, (s1, *_) in enumerate(clusters):
        for y in range(x + 1, len(clusters)):
            s2 = clusters[y][0]
            if s2 - s1 > REACH:
                both = before[x] + after[y] >= WANTED
                if both.any():
                    first, last = np.clip(split[both] + s1, 0, len(ends) - 1), np.clip(split[both] + s2, 0, len(ends) - 1)
                    if (ends[last] - ends[np.minimum(first + SLACK, last)] <= 1).any():
                        return True
    return False


def sentence_ends(text: str) -> np.ndarray:
    """For every word of the plain text, and its end, how many sentences end before it."""
    own = plain(text)
    out, total, last = [], 0, 0
    for match in _WORD.finditer(own):
        total += bool(last and _END.search(own, last, match.start() + 1))
        out.append(total)
        last = match.end()
    return np.array([*out, total + 1], np.int64)


def find_leaks(df: DataFrame, id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(``id``, ``item_id``) for every text that quotes an item: at least 15 of some 18 successive words of the item, in order and
    next to each other but for a few changed, missing or inserted words or one inserted sentence.

    Case, punctuation, spacing, markup, escapes, accents and damaged encodings don't count. Texts are read whole. Null texts
    and items, null ids and items of fewer than 15 words give no row; repeated rows of ``df`` give repeated rows; empty tables
    give an empty result; other columns aren't read.

    Fixed masks pick three of three or four successive words; the seeds of the items, in sorted arrays that every task holds,
    are joined with those of each text (a map-side hash join in one scan of the texts: items come in blocks of about
    ``BLOCK_CHARACTERS``, of which a task holds one at a time). Where a text and an item share at least ``LEAST_HITS`` seeds, the words
    are aligned (longest common subsequence) in a band around the shifts of the hits. An inserted sentence may have any length.
    """
    spark = df.sparkSession
    corpus = df.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("bigint"), F.col(text))
    tests = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"))
    size = tests.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARACTERS))
    seeds = []
    for block in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).distinct().collect()
        seeds.append(spark.sparkContext.broadcast(Seeds(sorted((r.i, r.t) for r in rows))))
    return corpus.mapInArrow(_search(seeds, [id, item_id]), f"`{id}` bigint, `{item_id}` bigint")


def _groups(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[tuple[np.ndarray, list[str], list[list[str]]]]:
    """Ids, texts and words of batches, taken together until they have so many words."""
    ids, texts, found, size = [], [], [], 0
    for batch in batches:
        ids.append(np.asarray(batch.column(0)))
        texts += batch.column(1).to_pylist()
        found += map(words, texts[len(found) :])
        size += sum(map(len, found[-batch.num_rows :])) if batch.num_rows else 0
        if size >= at_least:
            yield np.concatenate(ids), texts, found
            ids, texts, found, size = [], [], [], 0
    if ids:
        yield np.concatenate(ids), texts, found


def _search(broadcasts: list, names: list[str]):
    """One scan of the texts for all blocks: each group of texts is made words once and gone through with every block in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = len(broadcasts) > 1
        for ids, texts, found in _groups(batches, GROUP_WORDS if several else 0):
            for block in broadcasts:
                yield _quotes(block.value, ids, texts, found, names)
                if several and hasattr(block, "_value"):
                    del block._value  # at most one block is held; it is read again from the worker's own copy

    return run


def _quotes(seeds: Seeds, ids: np.ndarray, texts: list[str], found: list[list[str]], names: list[str]) -> pa.RecordBatch:
    """The (id, item) pairs of a group of texts with the items of a block."""
    number = seeds.vocabulary.get
    numbers, starts = [], []
    for own in found:
        starts.append(len(numbers))
        numbers += [number(w, -1) for w in own]
        numbers += (-1, -1, -1, -1)
    flat, starts = np.array(numbers, np.int64), np.array(starts, np.int64)
    at, item, place = seeds.hits(flat)
    doc = np.searchsorted(starts, at, "right") - 1
    order = np.lexsort((item, doc))
    at, item, place, doc = at[order], item[order], place[order], doc[order]
    pair = doc * np.int64(len(seeds.items)) + item
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    many = np.diff(np.concatenate([first, [len(pair)]]))
    out, last, own, there = [], -1, flat[:0], np.zeros(len(seeds.vocabulary) + 1, bool)  # there: the item words of the text; -1 is the spare place
    for f, m in zip(first[many >= LEAST_HITS], many[many >= LEAST_HITS]):
        d, i = doc[f], item[f]
        if d != last:
            there[own] = False
            last, own = d, flat[starts[d] : starts[d + 1] if d + 1 < len(starts) else None]
            there[own] = True
        known = there[seeds.items[i]]
        if np.count_nonzero(known) < WANTED:
            continue
        run, wide = np.concatenate([[0], np.cumsum(known)]), min(WINDOW, len(known))
        if (run[wide:] - run[:-wide]).max() < WANTED:
            continue
        if quoted(seeds.items[i], own, at[f : f + m] - starts[d] - place[f : f + m], lambda d=d: sentence_ends(texts[int(d)])):
            out.append((d, ids[d], seeds.ids[i]))
    got = np.array(list(dict.fromkeys(out)), np.int64).reshape(-1, 3)  # an item of several texts is named once
    return pa.RecordBatch.from_arrays([pa.array(got[:, 1]), pa.array(got[:, 2])], names=names)
