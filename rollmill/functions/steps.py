"""Solutions in steps: rewrites for outcome models, and scores by the boxed answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollmill.functions.answers import maths_equal
from rollmill.functions.arrays import let

#: Fixed value: the mark that closes a step.
STEP_MARK = "<|reserved_special_token_0|>"
#: Fixed value: the mark of a text's end, which rewrites take out.
TEXT_END = "<|end_of_text|>"
ANSWER_HEAD = "\n\n# Answer\n\n"
_BOXED = r"(?s)The final answer is: \\boxed\{(.*?)\}"
_CLOSING = r"\\boxed\{(.*?)\}\s*\\\]"


def _last(x: Column, mark: str) -> Column:
    return F.substring_index(x, mark, -1)


def numbered_steps(sequence: Column) -> Column:
    """A solution under its headings as "question Step 1: ... Step 2: ... last step The answer is: ...", each step closed by the step mark."""
    question = _last(F.substring_index(sequence, "\n\n# Solution\n\n", 1), "# Question\n\n")
    solution = _last(sequence, "\n\n# Solution\n\n")
    answer, body = _last(solution, ANSWER_HEAD), F.substring_index(solution, ANSWER_HEAD, 1)

    def of(parts: Column) -> Column:
        before = F.slice(parts, F.lit(1), F.size(parts) - 1)
        numbered = F.transform(before, lambda p, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), p, F.lit(f" {STEP_MARK}\n")))
        return F.concat(question, F.lit(" "), F.array_join(numbered, ""), F.element_at(parts, -1), F.lit(" The answer is: "), answer, F.lit(f" {STEP_MARK}\n"))

    return let(F.split(body, "\n\n", -1), of)


def _matched(x: Column, pattern: str) -> Column:
    return F.when(F.regexp_like(x, F.lit(pattern)), F.regexp_extract(x, pattern, 1)).otherwise(F.lit("none"))


def boxed_answer(sequence: Column) -> Column:
    """The box after "The final answer is: " in the assistant's part, else "none"."""
    return _matched(_last(sequence, "ASSISTANT:\n"), _BOXED)


def closing_answer(sequence: Column) -> Column:
    """The box that closes a display formula after the last "**Final Answer**", else "none"."""
    return _matched(_last(sequence, "**Final Answer**"), _CLOSING)


def answered(sequence: Column, answer: Column, cut: bool = True) -> Column:
    """The sequence (``cut``: up to the step mark before "The final answer is:") with its answer under a heading, closed by the step mark."""
    body = F.substring_index(sequence, STEP_MARK + "The final answer is:", 1) if cut else sequence
    return F.replace(F.concat(body, F.lit(ANSWER_HEAD), answer, F.lit(STEP_MARK)), F.lit(TEXT_END), F.lit(""))


def _match_score(found: Column, gold: Column, right: float, wrong: float) -> Column:
    return F.when(maths_equal(found, gold), F.lit(right)).otherwise(F.lit(wrong))


def boxed_scores(sequence: Column, gold: Column) -> dict[str, Column]:
    """Scores of four schemes: ``v1`` 1 or -1 and ``v2`` one half or minus one half by the box after "The final answer is: ", ``v3`` 1 or -1
    by the closing box, ``v4`` 1 or minus one half by it, and -1 where "**Final Answer**" is missing."""
    plain, closing = boxed_answer(sequence), closing_answer(sequence)
    fourth = F.when(sequence.contains("**Final Answer**"), _match_score(closing, gold, 1.0, -0.5)).otherwise(F.lit(-1.0))
    return {"v1": _match_score(plain, gold, 1.0, -1.0), "v2": _match_score(plain, gold, 0.5, -0.5), "v3": _match_score(closing, gold, 1.0, -1.0), "v4": fourth}


def default_steps(sequence: Column, scores: Column, empty: float = -0.5) -> Column:
    """The step scores of answers that have a box, else the default: one step of ``empty`` (-0.5 where steps start from 0, -1 from -0.5)."""
    return F.when(boxed_answer(sequence) == "none", F.array(F.lit(empty))).otherwise(scores)


def with_bonus(scores: Column, bonus: Column) -> Column:
    """(steps, sample): centred step scores with a bonus on the last one, and their smallest (before the bonus) with the bonus.

    An array of one step or none keeps it; otherwise the step before the last is taken out, as the last repeats it.
    """
    def of(own: Column) -> Column:
        n = F.size(own)
        kept = F.filter(own, lambda _, i: (n < 2) | (i != n - 2))
        raised = F.transform(kept, lambda s, i: F.when(i == F.size(kept) - 1, s + bonus).otherwise(s))
        return F.struct(raised.alias("steps"), (F.array_min(own) + bonus).alias("sample"))

    return let(scores.cast("array<double>"), of)
