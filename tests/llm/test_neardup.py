"""Groups of near-duplicates against brute force."""

import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollmill.llm import neardup
from rollmill.llm.bitmap import bitmap, with_maybe
from rollmill.llm.components import connected_components
from rollmill.llm.neardup import near_duplicate_pairs, near_duplicates


def brute(rows, threshold):
    bags = {i: Counter(re.findall(r"[^\W_]+", t.lower())) for i, t in rows if t is not None}
    bags = {i: b for i, b in bags.items() if b}
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ids = sorted(bags)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sum((bags[a] & bags[b]).values()) >= threshold * sum((bags[a] | bags[b]).values()) - 1e-9:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i in ids}


def corpus(seed=3, families=60, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    common = ["the", "of", "and", "to", "in"]
    rows, i = [], 0
    for f in range(families):
        base = [rng.choice(vocabulary if rng.random() < 0.5 else common) for _ in range(60)]
        for v in range(rng.choice([1, 1, 2, 4])):
            text = list(base)
            for _ in range(v * 2):
                at = rng.randrange(len(text))
                text[at : at + 1] = [rng.choice(vocabulary)] * rng.choice([0, 1, 2])
            if v == 3:
                text = text[30:] + text[:30]
            rows.append((i, " ".join(text)))
            i += 1
    return rows


def test_groups_match_brute_force(spark):
    rows = corpus() + [(900, None), (901, "  "), (902, "...")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "id bigint, text string, group_id int").repartition(3)
    out = near_duplicates(df, "id", "text", 0.75).collect()
    truth = brute(rows, 0.75)
    got = {r.id: r.group_id for r in out}
    assert set(got) == set(truth)
    pairs = lambda m: {(a, b) for a in m for b in m if a < b and m[a] == m[b]}
    found, true = pairs(got), pairs(truth)
    assert found <= true and len(found) >= 0.98 * len(true)
    assert all(r.n_links > 0 for r in out if r.group_id != r.class_id)


@pytest.mark.parametrize("zipf", [False, True])
@pytest.mark.parametrize("length", [60, 300, 1000, 5000])
def test_recall_does_not_depend_on_length(spark, length, zipf):
    """Pairs with an eighth of the words changed, of which brute force takes those at 0.75 or above."""
    rng = np.random.default_rng(length)
    vocabulary = 30_000
    rate = 1.0 / np.arange(1, vocabulary + 1) if zipf else np.ones(vocabulary)
    draw = lambda n: rng.choice(vocabulary, n, p=rate / rate.sum())
    rows, true = [], 0
    for family in range(120):
        one = draw(length)
        other = one.copy()
        at = rng.random(length) < 0.125
        other[at] = draw(int(at.sum()))
        a, b = Counter(one.tolist()), Counter(other.tolist())
        if (a & b).total() < 0.75 * (a | b).total():
            continue
        true += 1
        rows += [(2 * family, " ".join(f"w{w}" for w in one)), (2 * family + 1, " ".join(f"w{w}" for w in other))]
    got = near_duplicates(spark.createDataFrame(rows, "id bigint, text string").repartition(4), "id", "text").collect()
    group = {r.id: r.group_id for r in got}
    found = sum(group[i] == group[i + 1] for i in group if i % 2 == 0)
    assert true >= 60 and found >= 0.97 * true, (found, true)
    assert len(set(group.values())) >= true  # nothing else is joined


def test_index_rows_go_in_rounds_that_file_every_chunk(spark, monkeypatch):
    """No round shuffles more than half of the index rows; together they have all of them, each once."""
    filed, candidates = [], neardup._candidates

    def spy(keys, threshold):
        filed.append([tuple(r) for r in keys.select("key", "id").collect()])
        return candidates(keys, threshold)

    monkeypatch.setattr(neardup, "_candidates", spy)
    rows = [(i, " ".join(f"w{(i // 2 * 7 + k) % 900}" for k in range(40))) for i in range(400)]
    rows = [(i, f"{t} own{i}") for i, t in rows]
    out = near_duplicates(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()
    whole = neardup.CHUNKS * neardup.SET_BITS * len(rows)
    every = [x for part in filed for x in part]
    assert len(every) == len(set(every)) == whole and max(map(len, filed)) <= whole / 2
    group = {r.id: r.group_id for r in out}
    assert group == brute(rows, 0.75)


def test_shuffles_of_a_written_table_go(spark):
    code = """
import glob, tempfile, time
from pyspark.sql import SparkSession
from rollmill.plans.store import _CLEANUP, written
local = tempfile.mkdtemp(prefix="spark-")
spark = SparkSession.builder.master("local[2]").config("spark.local.dir", local).config("spark.ui.enabled", "false").getOrCreate()
out = written(spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count(), "counts", drop_shuffles=True)
end = time.monotonic() + 10
while (left := glob.glob(local + "/**/shuffle_*.data", recursive=True)) and time.monotonic() < end:
    time.sleep(0.1)
assert not left and out.count() == 10 and spark.conf.get(_CLEANUP, None) is None, left
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_threshold_below_the_reach_of_the_index(spark):
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame([(1, "a")], "id bigint, text string"), "id", "text", 0.7)


def test_copies_form_a_class_however_many(spark):
    rows = [(i, "one two three four five six seven") for i in range(300)] + [(1000, "ONE, two three four five six seven!"), (1001, "other words entirely here")]
    out = {r.id: r for r in near_duplicates(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()}
    assert {out[i].class_id for i in [*range(300), 1000]} == {0} and out[1001].group_id == 1001 and out[0].n_links == 0


def test_reordered_words_and_repeats_count(spark):
    rows = [(1, "a b c d e f g h"), (2, "h g f e d c b a"), (3, "a a a a b b b b")]
    out = {r.id: r.group_id for r in near_duplicates(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()}
    assert out == {1: 1, 2: 1, 3: 3}


def test_pairs_and_empty(spark):
    schema = "id bigint, text string"
    assert near_duplicate_pairs(spark.createDataFrame([], schema), "id", "text").count() == 0
    got = near_duplicate_pairs(spark.createDataFrame([(3, "x y"), (1, "y x"), (2, "x y"), (4, "z")], schema), "id", "text").collect()
    assert {tuple(r) for r in got} == {(1, 2), (1, 3), (2, 3)}


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (11, 10), (5, 5), (None, 7)] + [(i, i + 1) for i in range(100, 140)]
    for n in (1, 5):
        got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint").repartition(n)).collect()}
        assert got[3] == 1 and got[11] == 10 and got[5] == 5 and got[140] == 100 and 7 not in got
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bitmap_never_misses(spark):
    rows = spark.range(2000)
    bits = bitmap(rows.where("id % 5 = 0"), F.col("id"))
    out = with_maybe(rows, F.col("id"), bits)
    assert out.where("id % 5 = 0 and not maybe").count() == 0 and out.where("maybe").count() < 420
    assert with_maybe(rows, F.col("id"), bitmap(rows.limit(0), F.col("id"))).where("maybe").count() == 0
