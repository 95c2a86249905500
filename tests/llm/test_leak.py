"""Quotes of evaluation items in training text."""

import random

from rollmill.llm.leak import find_leaks
from rollmill.llm.normal import words

ITEM = "the courier of the northern harbour carries forty seven silver lanterns to the old mill before the evening bell rings while nobody counts the ropes that are left behind near the bridge"
FILLER = "completely unrelated words stand here so that the quote is somewhere inside of a longer text about other things"
SCHEMA = "id bigint, text string, item_id string"


def leaks(spark, texts, items=((1, ITEM),)):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    tests = spark.createDataFrame(list(items), "item_id bigint, text string")
    return {tuple(r) for r in find_leaks(df, "id", "text", tests, "item_id", "text").collect()}


def test_what_counts(spark):
    w = ITEM.split()
    changed = w[:18]
    for k in (4, 9, 14):
        changed[k] = "other"
    texts = [
        f"{FILLER} {ITEM} {FILLER}",
        f"{FILLER} {' '.join(w[5:22])}",
        " ".join(changed),
        " ".join(w[:9] + FILLER.split() + w[9:18]),
        f"<p>{ITEM.upper().replace(' ', '<br/>', 3)}</p>",
        ITEM.replace("e", "е", 5).replace(" ", "​ ", 4),
        " ".join(w[:14]),
        " ".join(sorted(w)),
        FILLER,
        None,
        "",
    ]
    assert {i for i, _ in leaks(spark, texts)} == {0, 1, 2, 3, 4, 5}


def test_an_inserted_sentence_may_have_any_length_but_only_one(spark):
    w = ITEM.split()
    sentence = lambda n: "Meanwhile " + " ".join(f"word{k}" for k in range(n)) + "."
    inserted = [f"{' '.join(w[:9])}. {sentence(n)} {' '.join(w[9:18])}" for n in (40, 50, 90, 400)]
    swapped = " ".join(w[9:18] + w[:9])
    far = f"{' '.join(w[:9])}. {sentence(40)} {sentence(40)} {sentence(40)} {' '.join(w[9:18])}"
    back = f"{' '.join(w[9:18])}. {sentence(60)} {' '.join(w[:9])}"
    assert {i for i, _ in leaks(spark, [*inserted, swapped, far, back])} == {0, 1, 2, 3}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(k, " ".join(f"x{k}y{j}" for j in range(30))) for k in range(40)]
    texts = [f"{FILLER} {items[k][1]} {items[k + 1][1]}" for k in range(0, 38, 3)]
    whole = leaks(spark, texts, items)
    monkeypatch.setattr("rollmill.llm.leak.BLOCK_CHARACTERS", 1500)
    assert leaks(spark, texts, items) == whole and len(whole) == 26


def test_encodings_are_neutral():
    assert words("Wie&#x27;s f\\u00fcr Ma\\u00dfe ＡＢ１２ cafÃ© café") == ["wie", "s", "fur", "masse", "ab12", "cafe", "cafe"]


def test_items_are_told_apart_and_edges(spark):
    other = ITEM.replace("lanterns", "kettles").replace("courier", "keeper").replace("silver", "copper").replace("mill", "tower").replace("bell", "horn").replace("ropes", "coins").replace("bridge", "gate").replace("evening", "morning").replace("nobody", "everyone").replace("left", "found").replace("forty", "sixty").replace("harbour", "valley")
    assert leaks(spark, [ITEM], [(1, ITEM), (2, other), (3, "too short to leak"), (4, None)]) == {(0, 1)}
    assert leaks(spark, [], [(1, ITEM)]) == set()
    assert leaks(spark, [ITEM], [(None, ITEM)]) == set()


def test_matches_brute_force_under_substitutions(spark):
    rng = random.Random(2)
    w = ITEM.split()
    texts, truth = [], set()
    for i in range(60):
        t = list(w)
        for k in rng.sample(range(len(t)), rng.randrange(0, 14)):
            t[k] = f"other{k}"
        same = [a == b for a, b in zip(t, w)]
        if any(sum(same[k : k + 18]) >= 15 for k in range(len(w) - 17)):
            truth.add(i)
        texts.append(" ".join(t))
    assert {i for i, _ in leaks(spark, texts)} == truth


def test_short_runs_between_insertions_and_deletions(spark):
    w = ITEM.split()[:18]
    given = w[:2] + w[3:9] + ["other"] + w[10:16] + ["inserted"] + w[16:18]  # 16 of 18 words, 12 of them at one shift
    back = w[:3] + ["inserted"] + w[3:5] + w[6:9] + ["inserted"] + w[9:11] + w[12:15] + ["inserted"] + w[15:17]
    reversed_runs = w[12:18] + w[6:12] + w[:6]
    assert {i for i, _ in leaks(spark, [" ".join(t) for t in (given, back, reversed_runs)])} == {0, 1}


def test_matches_brute_force_under_insertions_and_deletions(spark):
    rng = random.Random(5)
    w = ITEM.split()
    texts, truth = [], set()
    for i in range(80):
        start, t = rng.randrange(len(w) - 17), []
        gone = set(rng.sample(range(18), rng.randrange(0, 7)))
        extra = set(rng.sample(range(18), rng.randrange(0, 4)))
        for k in range(18):
            t += [f"new{k}"] * (k in extra) + [w[start + k]] * (k not in gone)
        most = 0
        for p in range(len(w) - 17):
            lcs = [0] * (len(t) + 1)
            for x in w[p : p + 18]:
                row = [0]
                for j, y in enumerate(t):
                    row.append(max(row[-1], lcs[j + 1], lcs[j] + (x == y)))
                lcs = row
            most = max(most, lcs[-1])
        if most >= 15:
            truth.add(i)
        texts.append(" ".join(t))
    assert 20 < len(truth) < 70
    assert {i for i, _ in leaks(spark, texts)} == truth
