"""Rendered conversations: roles and contents of five chat encodings, prompts for a judge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollmill.functions.arrays import let
from rollmill.functions.text import strip

#: What ends the preambles of system prompts; the prompt proper follows.
PREAMBLE_ENDS = (
    "Here is the task definition:\n\n",
    "between one <answer> tag and one </answer> tag.",
    "<think> reasoning process here </think><answer> answer here </answer>.",
)
#: The verdicts that a judge's log-probabilities are compared for.
VERDICTS = ("YES(是)", "NO(否)")
#: Fixed value: the judge's own system text.
JUDGE_SYSTEM = "You are a helpful assistant."
_TURN = "struct<role:string,content:string>"


def _after(x: Column, mark: str) -> Column:
    """What follows the first occurrence of a mark; NULL if there is none."""
    return F.when(x.contains(mark), F.substring(x, F.locate(mark, x) + len(mark), F.length(x)))


def _until(x: Column, mark: str) -> Column:
    """What comes before the first occurrence of a mark, or all of it."""
    return F.substring_index(x, mark, 1)


def without_preamble(system: Column) -> Column:
    """A system prompt without the known preambles."""
    def cut(end: str):
        return lambda t: F.coalesce(_after(t, end), t)

    out = system
    for end in PREAMBLE_ENDS:
        out = let(out, cut(end))
    return out


def _turn(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def _parts(x: Column, mark: str) -> Column:
    """Non-blank pieces between the occurrences of a mark, stripped."""
    return F.filter(F.transform(F.split(x, f"\\Q{mark}\\E", -1), strip), lambda p: p != "")


def _named(role: Column, content: Column) -> Column:
    """System and user turns that hold something; system turns lose their preambles. Other turns get no role."""
    kept = F.when(role == "system", without_preamble(content)).otherwise(content)
    return _turn(F.when(role.isin("system", "user") & (content != ""), role), kept)


def _qwen(x: Column) -> Column:
    def turn(p: Column) -> Column:
        body = F.substring(p, F.locate("\n", p), F.length(p))
        inner = F.when(body.contains("<|im_end|>"), F.regexp_extract(body, r"(?s)^(.*)<\|im_end\|>", 1)).otherwise(body)
        return _named(F.when(p.contains("\n"), _until(p, "\n")), strip(inner))

    return F.transform(_parts(x, "<|im_start|>"), turn)


def _deepseek(x: Column) -> Column:
    system = strip(_until(_after(x, "<｜begin▁of▁sentence｜>"), "<｜User｜>"))
    users = F.transform(_parts(_after(x, "<｜User｜>"), "<｜User｜>"), lambda p: _named(F.lit("user"), strip(_until(p, "<｜Assistant｜>"))))
    return F.concat(F.array(_named(F.lit("system"), system)), users)


def _llama3(x: Column) -> Column:
    def turn(p: Column) -> Column:
        marked = p.contains("<|start_header_id|>") & p.contains("<|end_header_id|>")
        return _named(F.when(marked, _until(_after(p, "<|start_header_id|>"), "<|end_header_id|>")), F.coalesce(_after(p, "<|end_header_id|>"), F.lit("")))

    return F.transform(_parts(x, "<|eot_id|>"), turn)


def _mistral(x: Column) -> Column:
    def turn(p: Column) -> Column:
        user = _until(p, "[/INST]")
        system = without_preamble(user)
        known = p.contains("[/INST]")
        return _turn(F.when(known & (system != user) & (system != ""), F.lit("system")).when(known, F.lit("user")), F.when((system != user) & (system != ""), system).otherwise(user))

    return F.transform(_parts(x, "[INST]"), turn)


def _base(x: Column) -> Column:
    system = _turn(F.when(x.contains("System:"), F.lit("system")), without_preamble(_until(_after(x, "System:"), "User:")))
    dialogue = F.when(x.contains("System:"), F.substring(x, F.locate("User:", x), F.length(x))).otherwise(x)
    users = F.transform(_parts(dialogue, "User:"), lambda p: _turn(F.when(p.contains("Assistant:"), F.lit("user")), _until(p, "Assistant:")))
    return F.concat(F.array(system), users)


#: Encoding: the marks it must have, and how it is read.
ENCODINGS = {
    "qwen": (("<|im_start|>", "<|im_end|>"), _qwen),
    "deepseek": (("<｜begin▁of▁sentence｜>", "<｜User｜>"), _deepseek),
    "llama3": (("<|eot_id|>", "<|begin_of_text|>"), _llama3),
    "mistral": (("[INST]", "[/INST]"), _mistral),
    "base": (("User:",), _base),
}


def encoding_of(prompt: Column) -> Column:
    """The encoding of a rendered prompt by its marks, in the order of ENCODINGS; NULL if none fits."""
    out = F.lit(None).cast("string")
    for name, (marks, _) in reversed(ENCODINGS.items()):
        fits = F.lit(True)
        for mark in marks:
            fits = fits & prompt.contains(mark)
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def turns(prompt: Column, encoding: Column | str) -> Column:
    """The system and user turns of a rendered prompt as array<struct<role, content>>; NULL for an unknown encoding."""
    own = F.lit(encoding) if isinstance(encoding, str) else encoding
    out = F.lit(None).cast(f"array<{_TURN}>")
    for name, (_, read) in ENCODINGS.items():
        out = F.when(own == name, F.filter(read(prompt), lambda t: t["role"].isNotNull() & (t["content"] != "")).cast(f"array<{_TURN}>")).otherwise(out)
    return out


def request_of(prompt: Column, encoding: Column | str) -> Column:
    """What a judge is shown of a prompt: the system text and the last user text, a blank line between; only the former if the last turn isn't a user's."""

    def of(own: Column) -> Column:
        first, last = F.get(own, F.lit(0)), F.try_element_at(own, F.lit(-1))
        system = F.when(first["role"] == "system", first["content"]).otherwise(F.lit(""))
        text = F.when(last["role"] == "user", strip(F.concat(system, F.lit("\n\n"), last["content"]))).otherwise(system)
        return F.when(own.isNotNull(), text)

    return let(turns(prompt, encoding), of)


def judge_content(guide: Column | str, request: Column, answer: Column, question: Column) -> Column:
    """One judge prompt: the guide, the request, the generated text and a question, under their headings."""
    guide = F.lit(guide) if isinstance(guide, str) else guide
    return F.concat(guide, F.lit("\n\n\nInput:\n\n"), request, F.lit("\n\n\nGenerated Text:\n\n"), answer, F.lit("\n\n\nQuestion:\n\n"), question)


def judge_messages(content: Column) -> Column:
    """The messages that ask for a verdict, and those with each verdict given, as one array of three message lists."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    asked = F.array(message("system", F.lit(JUDGE_SYSTEM)), message("user", content))
    return F.array(asked, *[F.concat(asked, F.array(message("assistant", F.lit(v)))) for v in VERDICTS])


def last_lines(x: Column, n: int = 20) -> Column:
    """The last ``n`` lines of a text."""
    return let(F.split(x, "\n", -1), lambda own: F.array_join(F.slice(own, F.greatest(F.size(own) - n, F.lit(0)) + 1, F.lit(n)), "\n"))


def judgement(x: Column) -> Column:
    """1 if the last "Judgement:" of the first line with a verdict, in any case, is followed by "correct" in lower case, else 0: the verdict's own case counts.

    The pattern holds at the starts of lines only ("\\n" ends a line), so its time is linear in the text's length, however long a line.
    """
    return (F.regexp_extract(x, r"(?imd)^.*Judgement:\s+(correct|wrong|not_found)", 1) == "correct").cast("int")
