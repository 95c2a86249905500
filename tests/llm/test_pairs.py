"""Defects of answers, hand-made."""

import pytest

from rollmill.llm import pairs
from rollmill.llm.pairs import asked_language, flag_pairs, language, last_turn, script

MODEL = {"the": (5000, 1), "without": (400, 0), "weeks": (500, 480), "pension": (300, 8)}


def defects(prompt, answer, counts):
    """The rules, with the verdict on the last word looked up in a plain table; the joins that give it are tested against it below."""
    out, hangs = pairs.defects(prompt, answer)
    if hangs:
        rule, word = hangs
        n, f = counts.get(word, (0, 0))
        longer = max((m for w, (m, _) in counts.items() if w.startswith(word) and w != word and m >= 40), default=0)
        cut = (word in pairs._ANY_FUNCTION and f <= 0.02 * n) or (n >= 20 and f < 0.02 * n) or (n < 20 and f == 0 and len(word) > 1 and longer >= 20 * max(n, 2))
        if not (cut if rule == "cut" else not (n >= 20 and f > 0.8 * n)):
            out.remove("truncated")
    return out


PROMPT = "Compare the harmony with the drum pattern and give five reasons for it."
GOOD = "The harmony follows the drum pattern in most of the songs that were written here."


@pytest.mark.parametrize(
    "prompt, answer, found",
    [
        (PROMPT, GOOD, []),
        (PROMPT, None, ["empty"]), (PROMPT, "", ["empty"]), (PROMPT, " \xa0​", ["empty"]), (PROMPT, "N/A", ["empty"]), (PROMPT, "<think>so</think><answer></answer>", ["empty"]), (PROMPT, "```\n```", ["empty"]),
        (PROMPT, "<think>so it goes", ["truncated"]), (PROMPT, f"<answer>{GOOD}", ["truncated"]), (PROMPT, GOOD[:-6], ["truncated"]), (PROMPT, f"{GOOD}\n```python\nx = 1", ["truncated"]), (PROMPT, f"{GOOD} In practice,", ["truncated"]),
        (PROMPT, f"{GOOD}\n\n- it goes without the pension\n- it goes witho", ["truncated"]),
        (PROMPT, f"{GOOD}\n\nBest regards,\nAnn Lee", []), (PROMPT, f"{GOOD} \\boxed{{5}}", []), (PROMPT, f"{GOOD} 🙂", []), (PROMPT, f"{GOOD} — Ann Lee", []), (PROMPT, f"{GOOD}\n\n- it lasted for ten weeks", []),
        (PROMPT, "I'm sorry, but I can't help with that. I hope you understand.", ["refusal"]), (PROMPT, "Leider gilt: diese Anfrage muss ich ablehnen.", ["refusal", "language"]), (None, "Je ne peux pas aider avec cela.", ["refusal"]),
        (PROMPT, f'The clerk said: "I\'m sorry, but I cannot help you today", and Ann laughed. {GOOD}', []), (PROMPT, "I can't praise the harmony enough, honestly. " + GOOD, []),
        (PROMPT, PROMPT, ["copied"]), (PROMPT, f"> {PROMPT.lower()}", ["copied"]), (PROMPT, f"You asked: {PROMPT[:30]} (...) \n{GOOD}", []), (f"User: Hello there.\nAssistant: Hi.\nUser: {PROMPT}", PROMPT[:-1], ["copied", "truncated"]),
        (PROMPT, "Der Schlagzeuger und die Harmonie sind in der Praxis nicht zu trennen.", ["language"]), (PROMPT + " Reply in German only.", "Der Schlagzeuger und die Harmonie sind in der Praxis nicht zu trennen.", []),
        (PROMPT + " Reply in German only.", GOOD, ["language"]), (" ", "Der Schlagzeuger und die Harmonie sind in der Praxis nicht zu trennen.", []),
    ],
)
def test_rules(prompt, answer, found):
    assert defects(prompt, answer, MODEL) == found


@pytest.mark.parametrize("end", ["f(x) = (a +", '{"k": ["a", "b"', "It is (as they say.", "See [the notes.", 'They said: "we go.', "so x = a +", "y=a+", "so 2 *", "x = (1 + 2) /", "so a ->", "so n^", "they left —", "a) one (of two.\nb) two."])
def test_open_delimiters_and_operators_are_truncated(end):
    assert defects(PROMPT, f"{GOOD} {end}", MODEL) == ["truncated"]


@pytest.mark.parametrize(
    "end",
    [
        "It holds on [0, 1) and (2, 3].", "1) one.\n2) two.", "a) one (of two).\nb) two.", 'It is 5" wide.', '"They go," she said (twice).', "Code `f(` ends.", "```python\nf(\n```", 'The sign "(" opens.', "It rained :( again.", "We use C++", "That is A+", "See https://x.org/",
        "so \\[ x = \\{1\\} \\]", "| a | b |", "**so it goes.**", "**(so it goes.)**", "The key is c2l4dGVlbg==", "---", '"One.\n\n"Two."',
    ],
)
def test_closed_delimiters_are_whole(end):
    assert "truncated" not in defects(PROMPT, f"{GOOD} {GOOD}\n{end}", {"a": (100, 90), "c": (100, 90)})


@pytest.mark.parametrize(
    "answer, found",
    [
        ("和声在大多数歌曲中都遵循鼓的节奏，这里写的歌曲也是如此。", ["language"]), ("Гармония следует за ритмом барабанов в большинстве песен, которые здесь написаны.", ["language"]),
        ("L'armonia segue il ritmo della batteria nella maggior parte delle canzoni che sono state scritte qui.", ["language"]),
        ("申し訳ありませんが、そのご質問にはお答えできません。", ["refusal", "language"]), ("Mi dispiace, ma non posso aiutarti con questa richiesta.", ["refusal", "language"]),
        ("很抱歉，我无法回答这个问题。", ["refusal", "language"]), ("Извините, но я не могу помочь с этим.", ["refusal", "language"]),
        ("There are three reasons and the answer is 42", []), ("x = load(path)\nreturn x", []), ("def double(x):\n    return 2 * x", []),
        ("There are three reasons. One is that the drums lead, and the other is that the", ["truncated"]),
    ],
)
def test_other_scripts_languages_and_code_without_any_counts(answer, found):
    assert defects("Name three reasons for the harmony of the songs.", answer, {}) == found


def test_scripts():
    assert script("plain") == "LATIN" and script("42") is None and script("Größe 5") == "LATIN"
    assert script("日本語のテキスト") == "KANA" and script("汉字文本 ok") == "CJK" and script("Привет, world of") in ("LATIN", None) and script("한국어") == "HANGUL"
    assert defects("Answer in Russian, please: what is the sum?", "Сумма равна двум.", {}) == [] and defects("Answer in Russian, please: what is it?", "It is the sum of the two.", {}) == ["language"]
    assert defects("请用两句话说明原因。", "原因有两个。第一个是鼓。", {}) == []


def test_joined_verdicts_equal_those_of_a_plain_table(spark):
    words = ["alpha", "beta", "gammadelta", "the", "of"]
    rows = []
    for i in range(600):
        w = words[i % 5]
        rows.append((i, f"It was said before. Now it is about {w} and more {w if i % 7 else w + '.'}", None))
    rows += [(1000, "It was so. Then comes the gamma", None), (1001, "- it is about alp", None), (1002, "It was so. We look at unseen", None)]
    df = spark.createDataFrame(rows, "seq bigint, a string, p string").repartition(5)
    counts = {}
    for _, text, _ in rows:
        for token in pairs._TOKEN.findall(text.lower()):
            n, f = counts.get(token.rstrip(".!?"), (0, 0))
            counts[token.rstrip(".!?")] = n + 1, f + token.endswith(".")
    got = sorted((r.seq, r.defect) for r in flag_pairs(df, ["seq"], "p", "a").collect())
    assert got == sorted((i, d) for i, t, p in rows for d in defects(p, t, counts))
    assert len({i for i, _ in got}) > 400


def test_languages():
    assert language("Explica a Ana cómo se relacionan dosis y vendaje.") == "es"
    assert language("Pourquoi le sujet est-il plus important que la matrice ?") == "fr"
    assert language("42") is None
    assert asked_language("Antworte bitte auf Englisch.") == "en" and asked_language("La réponse doit être en espagnol.") == "es" and asked_language("The English horn.") is None
    assert last_turn("User: a\nAssistant: b\nUser: c") == "c" and last_turn("plain") == "plain"


def test_rows_with_clashing_columns_and_repeats(spark):
    rows = [(1, PROMPT, "N/A", "x"), (1, PROMPT, "N/A", "x"), (2, PROMPT, GOOD, "y"), (None, None, "", None)]
    df = spark.createDataFrame(rows, "seq bigint, p string, a string, defect2 string")
    out = flag_pairs(df, ["seq"], "p", "a").collect()
    assert sorted((r.seq or 0, r.defect, r.place) for r in out) == [(0, "empty", 1), (1, "empty", 1), (1, "empty", 1)]
    assert flag_pairs(df.limit(0), ["seq"], "p", "a").count() == 0


def test_very_long_answer():
    assert defects(PROMPT, (GOOD + " ") * 3000, MODEL) == []
