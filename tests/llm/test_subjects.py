"""Subjects of made-up documents, held-out labels."""

import random

from rollmill.llm.subjects import subject_shares

LETTERS = "bcdfghklmnprstvz"
TERMS = {s: [f"{s}{LETTERS[k // 16]}a{LETTERS[k % 16]}" for k in range(40)] for s in ("law", "music", "sport")}
FILL = "table window morning people street river mountain garden evening letter".split()


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        own = rng.choice([["law"], ["music"], ["sport"], ["law", "music"], []])
        sentences = [f"Today the {rng.choice(FILL)} was near the {rng.choice(FILL)} of {rng.choice(FILL)}." for _ in range(3)]
        for s in own:
            sentences += [f"In practice the {rng.choice(TERMS[s])} depends on the {rng.choice(TERMS[s])} and a {rng.choice(TERMS[s])}." for _ in range(3)]
        rng.shuffle(sentences)
        rows.append((i, " ".join(sentences)))
        truth[i] = set(own)
    return rows, truth


def test_held_out_accuracy(spark):
    rows, truth = corpus()
    docs = spark.createDataFrame([*[(i, t, "x") for i, t in rows], (900, None, "x"), (901, "", "x"), (902, "!?", "x"), (None, "the court", "x")], "id bigint, text string, subject string").repartition(3)
    labels = spark.createDataFrame([(i, s.upper() + " ") for i in range(160) for s in truth[i]] + [(5, "unknown"), (None, "law"), (7777, "law")], "id bigint, subject string")
    subjects = spark.createDataFrame([("law", "courts and verdicts"), ("music", "playing and singing"), ("sport", "races")], "subject string, about string")
    out = subject_shares(docs, "id", "text", subjects, labels).collect()
    got = {}
    for r in out:
        assert 0 < r.n_sentences <= r.of_sentences and abs(r.share - r.n_sentences / r.of_sentences) < 1e-9
        if r.share >= 0.25:
            got.setdefault(r.id, set()).add(r.subject)
    held_out = [i for i in truth if i >= 160]
    right = sum(got.get(i, set()) == truth[i] for i in held_out)
    assert right >= 0.9 * len(held_out)
    assert not set(got) & {900, 901, 902, None}


def test_empty_tables(spark):
    subjects = spark.createDataFrame([("law", "courts")], "subject string, about string")
    none = spark.createDataFrame([], "id bigint, text string")
    labels = spark.createDataFrame([], "id bigint, subject string")
    assert subject_shares(none, "id", "text", subjects, labels).count() == 0
    some = spark.createDataFrame([(1, "the court and the jury met here. " * 3)], "id bigint, text string")
    subject_shares(some, "id", "text", subjects, labels).collect()


def test_rare_language_and_rare_subject_reach_their_documents(spark):
    """A language with one document in a hundred, and a subject with one in a hundred of the other language's, by held-out labels."""
    rng = random.Random(9)
    terms = {s: [f"{s}{LETTERS[k // 16]}a{LETTERS[k % 16]}" for k in range(24)] for s in ("law", "music", "sport", "droit", "musique", "golf")}
    english = lambda s: f"In practice the {rng.choice(terms[s])} depends on the {rng.choice(terms[s])} and a {rng.choice(terms[s])}."
    french = lambda s: f"Dans la pratique le {rng.choice(terms[s])} est avec la {rng.choice(terms[s])} et pour une {rng.choice(terms[s])}."
    rows, truth = [], {}
    for i in range(6000):
        if i % 100 == 0:
            own, name = rng.choice([("droit", "law"), ("musique", "music")])
            text = " ".join(french(own) for _ in range(6))
        else:
            own = name = "golf" if i % 100 == 1 else rng.choice(["law", "music", "sport"])
            text = " ".join(english(own) for _ in range(6))
        rows.append((i, f"{text} The {rng.choice(FILL)} was near the {rng.choice(FILL)}." if i % 100 else text))
        truth[i] = name
    docs = spark.createDataFrame(rows, "id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, truth[i]) for i in truth if i // 100 % 2 == 0], "id bigint, subject string")
    subjects = spark.createDataFrame([(s, None) for s in ("law", "music", "sport", "golf")], "subject string, about string")
    got = {}
    for r in subject_shares(docs, "id", "text", subjects, labels).where("share >= 0.25").collect():
        got.setdefault(r.id, set()).add(r.subject)
    for rest in (0, 1, 50):
        held_out = [i for i in truth if i % 100 == rest and i // 100 % 2]
        wrong = [(i, got.get(i), truth[i]) for i in held_out if got.get(i) != {truth[i]}]
        assert len(wrong) <= 0.1 * len(held_out), wrong
