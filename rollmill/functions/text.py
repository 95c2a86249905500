"""Strings: stripping, words, n-grams, repetition, and the tag structure of reasoning answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollmill.functions.arrays import let

#: A word character, as regular expressions of the Unicode kind have it.
WORD = r"[\p{L}\p{N}_]"
#: What ends a rendered sequence, in the order in which it is cut.
STOP_WORDS = ("</s>", "<|im_end|>", "<|endoftext|>", "<｜end▁of▁sentence｜>", "<|eot_id|>")
#: Fixed value: the text of a thinking part that was copied from the instruction.
PLACEHOLDER_THINKING = "reasoning process here"


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def quoted(x: Column) -> Column:
    """A regular expression that matches the text itself."""
    return F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def words(x: Column) -> Column:
    """Lower-case words between white space; blank text has none."""
    return let(strip(F.lower(x)), lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"(?U)\s+")))


def n_words(x: Column) -> Column:
    """Runs of word characters."""
    return F.regexp_count(x, F.lit(WORD + "+"))


def ngrams(items: Column, n: int) -> Column:
    """All runs of n successive elements; none if there are fewer than n."""
    def of(own: Column) -> Column:
        last = F.size(own) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(own, i, n))).otherwise(F.slice(F.array(own), 1, 0))

    return let(items, of)


def repetition_penalty(items: Column, n: int, most: float) -> Column:
    """``most`` (not positive) times the share of repeated n-grams, between 0 and 1."""
    if most > 0:
        raise ValueError("the penalty must not be positive")
    if most == 0:
        return F.lit(0.0)
    share = let(ngrams(items, n), lambda grams: 1 - F.size(F.array_distinct(grams)) / (F.size(grams) + F.lit(1e-5)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * most + F.lit(0.0)


def repeated_starts(items: Column, n: int) -> Column:
    """0-based starts of n-grams that occurred before."""
    first = lambda grams: F.transform(grams, lambda g, i: F.when(F.array_position(grams, g) - 1 < i, i).otherwise(F.lit(-1)))
    return F.filter(let(ngrams(items, n), first), lambda i: i >= 0)


def last_tag(x: Column, tag: str) -> Column:
    """The stripped inside of the last <tag>...</tag>; NULL if there is none."""
    return strip(F.try_element_at(F.regexp_extract_all(x, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), F.lit(-1)))


def answer_of(x: Column, template: str = "qwen") -> Column:
    """The last answer part; in the template without answer tags, what follows the last end of thinking."""
    if template == "deepseek":
        return F.when(x.contains("</think>"), strip(F.substring_index(x, "</think>", -1)))
    return last_tag(x, "answer")


def think_of(x: Column) -> Column:
    return last_tag(x, "think")


def _find(x: Column, what: str) -> Column:
    """0-based place, -1 if missing."""
    return F.locate(what, x) - 1


def well_formed(x: Column, template: str = "qwen") -> Column:
    """Each tag exactly once, and in order. A missing tag's place is -1."""
    tags = ("<think>", "</think>") + (() if template == "deepseek" else ("<answer>", "</answer>"))
    once = [F.regexp_count(x, F.lit(f"\\Q{t}\\E")) == 1 for t in tags]
    ordered = [_find(x, a) <= _find(x, b) for a, b in zip(tags, tags[1:])]
    out = F.lit(True)
    for c in once + ordered:
        out = out & c
    return out


def loose_format(x: Column) -> Column:
    """Thinking and answer in one line each, from the start, with at most a line break between them."""
    return F.regexp_like(x, F.lit(r"^<think>.*?</think>\n?<answer>.*?</answer>"))


def usable(think: Column, answer: Column, formed: Column) -> Column:
    """Formed, with an answer and with thinking that isn't the placeholder."""
    return F.coalesce(formed & (answer != "") & (think != "") & (F.lower(think) != PLACEHOLDER_THINKING), F.lit(False))


def cut_stop_words(x: Column) -> Column:
    """What comes before the first occurrence of each stop word, one after another, stripped after every cut."""
    def cut(word: str):
        return lambda t: F.when(t.contains(word), strip(F.substring_index(t, word, 1))).otherwise(t)

    for word in STOP_WORDS:
        x = let(x, cut(word))
    return x


#: How each chat encoding opens the assistant's answer, in the order of recognition.
ASSISTANT_HEADS = (
    ("qwen", ("<|im_start|>assistant\n<think>",), "<|im_start|>assistant\n"),
    ("deepseek", ("<｜begin▁of▁sentence｜>", "<｜User｜>", "<｜Assistant｜><think>"), "<｜Assistant｜>"),
    ("llama3", ("<|start_header_id|>", "<|end_header_id|>", "assistant<|end_header_id|><think>"), "assistant<|end_header_id|>"),
    ("mistral", ("[INST]", "[/INST]<think>"), "[/INST]"),
    ("base", ("Assistant:<think>",), "Assistant:"),
)


def template_of(sequence: Column) -> Column:
    """The chat encoding of a rendered sequence; NULL if none fits."""
    out = F.lit(None).cast("string")
    for name, signs, _ in reversed(ASSISTANT_HEADS):
        fits = F.lit(True)
        for s in signs:
            fits = fits & sequence.contains(s)
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def model_output(sequence: Column) -> Column:
    """What the model wrote, by the sequence's encoding, up to the stop words."""
    def of(template: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, signs, _ in ASSISTANT_HEADS:
            out = F.when(template == name, F.concat(F.lit("<think>"), F.substring_index(sequence, signs[-1], -1))).otherwise(out)
        return out

    return cut_stop_words(let(template_of(sequence), of))


def strip_marks(x: Column, eos: str, pad: str) -> Column:
    """Without runs of the end and padding marks at both ends, and one end mark at the end."""
    run = f"(?:\\Q{eos}\\E|\\Q{pad}\\E)+"
    return F.concat(F.regexp_replace(F.regexp_replace(x, "^" + run, ""), run + "$", ""), F.lit(eos))


def finish(prompt: Column, response: Column, eos: str) -> Column:
    """Prompt and response without trailing line breaks, closed by the end mark if it isn't there."""
    text = F.regexp_replace(F.concat(prompt, response), r"\n+$", "")
    return F.when(text.endswith(eos), text).otherwise(F.concat(text, F.lit(" " + eos)))


def with_thinking(prompt: Column) -> Column:
    """The prompt with an opening thinking tag, unless it ends in one of the known thinking suffixes."""
    ends = prompt.endswith("<think>") | prompt.endswith("<think>\n") | prompt.endswith("<think>\n\n</think>\n")
    return F.when(ends, prompt).otherwise(F.concat(prompt, F.lit("<think>\n")))


def knights(solution: Column) -> Column:
    """Name to role from a puzzle's solution: per line the first name and the first role after it; later lines win."""
    lines = F.filter(F.transform(F.split(solution, "\n"), strip), lambda s: s != "")
    found = F.transform(lines, lambda s: F.struct(F.regexp_extract(s, r"(?i)\b([A-Za-z]+)\b.*?\b(knight|knave)\b", 1).alias("key"), F.lower(F.regexp_extract(s, r"(?i)\b([A-Za-z]+)\b.*?\b(knight|knave)\b", 2)).alias("value")))
    last = lambda kept: F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda z: z["key"] == e["key"]))
    return F.map_from_entries(let(F.filter(found, lambda e: e["key"] != ""), last))


def knight_answers(answer: Column, roles: Column) -> Column:
    """Whether the answer names every role right: true, false, or NULL if it can't be read (a name missing, or too many or few roles named)."""
    mentions = F.regexp_count(F.lower(answer), F.lit("knight|knave"))

    def of(own: Column) -> Column:
        names = F.map_keys(own)
        role = lambda n: F.lower(F.call_function("regexp_extract", answer, F.concat(F.lit(r"(?i)\b"), quoted(n), F.lit(r"\b\s+is\s+a\s+\b(knight|knave)\b")), F.lit(1)))
        said = F.transform(names, lambda n: F.struct(role(n).alias("said"), F.element_at(own, n).alias("role")))
        readable = (mentions == F.size(names)) & (F.size(names) > 0)
        right = lambda all_: F.when(~F.exists(all_, lambda s: s["said"] == ""), F.forall(all_, lambda s: s["said"] == s["role"]))
        return F.when(readable, let(said, right))

    return let(roles, of)


def knight_score(answer: Column, think: Column, formed: Column, roles: Column, reward: float = 2.0) -> Column:
    right = knight_answers(answer, roles)
    return F.when(usable(think, answer, formed), F.when(right.isNull(), F.lit(-reward)).when(right, F.lit(reward)).otherwise(F.lit(-0.75 * reward))).otherwise(F.lit(-reward))
