"""Benchmark records to questions, true answers and few-shot prompts, by tables of their shapes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions import answers as N
from rollmill.functions.arrays import let
from rollmill.functions.text import strip

#: Data sets whose true answers keep their form but for the spelling of relations.
AS_THEY_ARE = N.UNIT_SETS


def _c(name: str) -> Column:
    return F.col(name)


def _no_dollars(x: Column) -> Column:
    return strip(F.replace(x, F.lit("$"), F.lit("")))


def _table_number(answer: Column, kind: Column) -> Column:
    """Numbers of tables: a quotient, thousands commas or a percentage, as a double's text; other answers stay."""
    part = lambda k: F.split_part(answer, F.lit("/"), F.lit(k)).try_cast("double")
    value = (
        F.when(answer.contains("/"), F.try_divide(part(1), part(2))).when(answer.contains(","), F.replace(answer, F.lit(","), F.lit("")).try_cast("double"))
        .when(answer.contains("%"), F.split_part(answer, F.lit("%"), F.lit(1)).try_cast("double") / 100).otherwise(answer.try_cast("double"))
    )
    return F.when(kind.isin("integer_number", "decimal_number"), value.cast("string")).otherwise(answer)


@dataclass(frozen=True)
class Truth:
    """Where a data set has its worked solution (or None) and its answer; ``extracted`` answers are read from the solution."""

    solution: Callable[[], Column] | None
    answer: Callable[[], Column]
    extracted: bool = False


def _field(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


_SOLVED = Truth(_field("solution"), _field("solution"), extracted=True)
_ANSWER = Truth(None, _field("answer"))
_NO_DOLLARS = Truth(None, lambda: _no_dollars(_c("answer")))
_CHOICE_FIRST = Truth(None, lambda: F.when(F.length("choice_answer") > 0, _c("choice_answer")).otherwise(_c("answer")))
#: Shapes by data set.
TRUTHS: dict[str, Truth] = {
    "math": _SOLVED, "minerva_math": _SOLVED, "math500": _SOLVED,
    "gsm8k": Truth(lambda: F.split_part("answer", F.lit("####"), F.lit(1)), lambda: F.split_part("answer", F.lit("####"), F.lit(2))),
    "svamp": Truth(_field("Equation"), _field("Answer")), "asdiv": Truth(_field("formula"), lambda: F.regexp_replace("answer", r"\(.*?\)", "")), "mawps": Truth(None, _field("target")),
    "tabmwp": Truth(_field("solution"), lambda: _table_number(_c("answer"), _c("ans_type"))), "carp_en": Truth(_field("steps"), _field("answer")),
    "mmlu_stem": Truth(None, lambda: F.substring(F.lit("ABCD"), _c("answer").cast("int") + 1, F.lit(1))), "sat_math": Truth(None, _field("Answer")), "aqua": Truth(None, _field("correct")),
    "gaokao2023en": _NO_DOLLARS, "college_math": _NO_DOLLARS, "gaokao_math_cloze": _NO_DOLLARS, "gaokao_math_qa": Truth(None, _field("label")),
    "gaokao2024_mix": _CHOICE_FIRST, "cn_middle_school": _CHOICE_FIRST, "olympiadbench": Truth(None, lambda: F.btrim(F.get("final_answer", F.lit(0)), F.lit("$"))),
    "aime24": _ANSWER, "amc23": _ANSWER, "cmath": _ANSWER, "gaokao2024_I": _ANSWER, "gaokao2024_II": _ANSWER, "imo2024": _ANSWER,
}


def _truth(name: str) -> Truth:
    if name not in TRUTHS:
        raise ValueError(f"unknown data set {name!r}; known: {', '.join(sorted(TRUTHS))}")
    return TRUTHS[name]


def with_truth(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``gt_cot`` (the worked solution, "None" where the data set has none) and ``gt`` (the true answer in canonical form).

    Tables that have both columns already keep their solution; the answer is made canonical (or, for "math", read from the solution).
    NULL fields give NULL answers. Columns that a data set needs must be there.
    """
    ready = "gt_cot" in df.columns and "gt" in df.columns
    own = Truth(_field("gt_cot"), _field("gt_cot") if name == "math" else _field("gt"), name == "math") if ready else _truth(name)
    answer = own.answer().cast("string")
    solution = own.solution().cast("string") if own.solution else F.lit("None")
    if own.extracted:
        answer = N.cleaned_answer(answer, name)
    if name in AS_THEY_ARE:
        if not ready:
            for old, new in (("\\neq", "\\ne"), ("\\leq", "\\le"), ("\\geq", "\\ge")):
                answer = F.replace(answer, F.lit(old), F.lit(new))
    else:
        answer = N.canonical_long(answer)
    kept = [c for c in df.columns if c not in ("gt_cot", "gt")]
    return df.select(*kept, (solution if ready else strip(solution)).alias("gt_cot"), answer.alias("gt"))


def _options(labels: Column, texts: Column) -> Column:
    return F.array_join(F.zip_with(labels, texts, lambda a, t: F.concat(F.lit("("), a, F.lit(") "), strip(t.cast("string")))), " ")


def _choices(lead: str, options: Column) -> Column:
    return F.concat(strip(_c("question")), F.lit(lead), options)


def _marked_options(text: Column) -> Column:
    """Options in one line as "A) ... B) ...", with their letters in parentheses."""
    out = F.concat(F.lit("("), strip(text))
    for letter in "BCD":
        out = F.replace(out, F.lit(f" {letter}) "), F.lit(f" ({letter}) "))
    return out


def _joined_options(options: Column) -> Column:
    return strip(F.replace(F.replace(F.concat(F.lit("("), F.array_join(options, "(")), F.lit("("), F.lit(" (")), F.lit(")"), F.lit(") ")))


def _table_question() -> Column:
    title = F.when(F.coalesce(F.length("table_title"), F.lit(0)) > 0, F.concat(F.lit('regarding "'), _c("table_title"), F.lit('" '))).otherwise(F.lit(""))
    choices = F.when(F.coalesce(F.length("choices"), F.lit(0)) > 0, F.concat(F.lit(" Please select from the following options: "), _c("choices"))).otherwise(F.lit(""))
    return F.concat(F.lit("Read the following table "), title, F.lit("and answer a question:\n"), _c("table"), F.lit("\n"), _c("question"), choices)


#: How a question is put together, where it isn't a column of its own.
QUESTIONS: dict[str, Callable[[], Column]] = {
    "asdiv": lambda: F.concat(strip(_c("body")), F.lit(" "), strip(_c("question"))),
    "svamp": lambda: F.concat(let(strip(_c("Body")), lambda b: F.when(b.endswith("."), b).otherwise(F.concat(b, F.lit(".")))), F.lit(" "), strip(_c("Question"))),
    "tabmwp": _table_question,
    "carp_en": _field("content"),
    "mmlu_stem": lambda: _choices("\nAnswer Choices: ", _options(F.array(*map(F.lit, "ABCD")), _c("choices"))),
    "sat_math": lambda: _choices("\nAnswer Choices: ", _marked_options(_c("options"))),
    "aqua": lambda: _choices("\nAnswer Choices: ", _joined_options(_c("options"))),
    "gaokao_math_qa": lambda: _choices("\n选项: ", _options(F.map_keys("options"), F.map_values("options"))),
}
#: Columns that hold a question, in the order of preference.
QUESTION_COLUMNS = ("question", "problem", "Question", "input")
#: What is added to a question with such an answer.
ASKED = ((("true", "false"), " (True or False)"), (("yes", "no"), " (Yes or No)"))


def with_question(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``built_question``: the question as its data set puts it, stripped, and with the two possible answers where it has two."""
    own = next((q for n, q in QUESTIONS.items() if n == name or (n == "aqua" and n in name)), None)
    column = next((c for c in QUESTION_COLUMNS if c in df.columns), None)
    question = own() if own else _c(column) if column else F.lit("")
    rows = with_truth(df.withColumn("built_question", question), name)
    added = F.lit("")
    for answers, text in ASKED:
        added = F.when(F.lower("gt").isin(*answers), F.lit(text)).otherwise(added)
    return rows.withColumn("built_question", strip(F.concat("built_question", added))).drop("gt", "gt_cot")


@dataclass(frozen=True)
class Template:
    """How a shown or asked question, an answer and the border between two examples are written."""

    question: str
    answer: str = "{output}"
    border: str = "\n\n"


_BOX = "Please reason step by step, and put your final answer within \\boxed{}."
# Prompt templates by name; {input} and {output} are filled in.
TEMPLATES = {
    "direct": Template("Question: {input}\nAnswer: "),
    "cot": Template("Question: {input}\nAnswer: ", border="\n\n\n"),
    "pal": Template("Question: {input}\n\n", border="\n---\n"),
    "tool-integrated": Template("Question: {input}\n\nSolution:\n", border="\n---\n"),
    "self-instruct": Template("<|user|>\n{input}\n<|assistant|>\n", border="\n"),
    "tora": Template("<|user|>\n{input}\n<|assistant|>\n", border="\n"),
    "wizard_zs": Template("### Instruction:\n{input}\n\n### Response: Let's think step by step.", border="\n\n\n"),
    "platypus_fs": Template("### Instruction:\n{input}\n\n### Response:\n", border="\n\n\n"),
    "deepseek-math": Template(f"User: {{input}}\n{_BOX}\n\nAssistant:", border="\n\n\n"),
    "kpmath": Template('User: Please reason step by step and put your final answer at the end with "The answer is: ".\n\n{input}\n\nAssistant:'),
    "jiuzhang": Template("## Question\n{input}\n\n## Solution\n", border="\n\n\n"),
    "jiuzhang_tora": Template("## Question\n{input}\n\n## Code Solution\n", border="\n\n\n"),
    "jiuzhang_nl": Template("## Question\n{input}\n\n## Natural Language Solution\n", border="\n\n\n"),
    "mmiqc": Template('Please solve the following problem and put your answer at the end with "The answer is: ".\n\n{input}\n\n', border="\n\n\n"),
    "abel": Template("Question:\n{input}\nAnswer:\nLet's think step by step.\n"),
    "shepherd": Template("{input}\n", border="\n\n\n"),
    "qwen-boxed": Template(f"<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n{{input}}\n{_BOX}<|im_end|>\n<|im_start|>assistant\n"),
    "qwen25-math-cot": Template(f"<|im_start|>system\n{_BOX}<|im_end|>\n<|im_start|>user\n{{input}}<|im_end|>\n<|im_start|>assistant\n"),
    "mathstral": Template(f"{{input}}\n{_BOX}"),
    "internlm-math-fs": Template("Question:{input}\nAnswer:", border="\n"),
    "internlm-math-chat": Template("<|im_start|>user\n{input}<|im_end|>\n<|im_start|>assistant\n"),
    "mistral": Template("[INST] {input}[/INST]"),
    "numina": Template("### Problem: {input}\n### Solution:", " {output}"),
    "o1_cot": Template(f"[Round 0] USER:\n{{input}}\n{_BOX} ASSISTANT:\n"),
}
# Whose examples a data set borrows.
BORROWED = {
    **dict.fromkeys(("gsm_hard", "svamp", "tabmwp", "asdiv", "mawps"), "gsm8k"),
    **dict.fromkeys(("math_oai", "hungarian_exam", "math-oai", "aime24", "amc23"), "math"),
    "sat_math": "mmlu_stem",
    **dict.fromkeys(("gaokao2024_I", "gaokao2024_II", "gaokao_math_qa", "gaokao2024_mix", "cn_middle_school"), "gaokao"),
}
#: Fixed value: what stands before a whole prompt of this template.
_WRAP = {"platypus_fs": "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n{input}\n\n### Response:\n"}
#: Data sets that may adapt their examples, and how many they then show.
ADAPTIVE, ADAPTED_SHOTS = tuple(k for k, v in BORROWED.items() if v == "gaokao"), 5
#: Examples of a data set are a stated table; a prompt shows at most so many.
MOST_SHOTS = 64


def _fill(template: str, mark: str, value: Column) -> Column:
    before, found, after = template.partition(mark)
    return F.concat(F.lit(before), value, F.lit(after)) if found else F.lit(template)


def few_shot_prompts(df: DataFrame, examples: DataFrame, name: str, template: str, shots: int, question: str = "question", gt: str | None = None, adapt: bool = False, out: str = "prompt") -> DataFrame:
    """``df`` with a prompt of the first ``shots`` examples of its data set and the question, in a named template.

    ``examples`` has ``data_set``, ``place``, ``question`` and ``answer``; data sets without examples of their own borrow those of others.
    With ``adapt``, sets of choices show five, and rows whose ``gt`` isn't a letter A to E show none. One template puts all examples into a
    single turn, another wraps the whole prompt. Blanks at both ends go. Unknown templates and more than ``MOST_SHOTS`` examples raise.
    The examples are one row, broadcast.
    """
    if template not in TEMPLATES:
        raise ValueError(f"unknown template {template!r}; known: {', '.join(TEMPLATES)}")
    shots = ADAPTED_SHOTS if adapt and name in ADAPTIVE else shots
    if not 0 <= shots <= MOST_SHOTS:
        raise ValueError(f"0 to {MOST_SHOTS} examples can be shown")
    own, single = TEMPLATES[template], template == "qwen25-math-cot"
    chosen = examples.where(F.col("data_set") == BORROWED.get(name, name)).orderBy("place").limit(shots)
    shown = chosen.agg(F.array_sort(F.collect_list(F.struct("place", F.col("question").alias("q"), F.col("answer").alias("a")))).alias("_shown"))
    one = (lambda e: F.concat(e["q"], F.lit("\n"), e["a"])) if single else (lambda e: F.concat(_fill(own.question, "{input}", e["q"]), _fill(own.answer, "{output}", e["a"])))
    rows = df.crossJoin(F.broadcast(shown))  # one row
    demos = F.array_join(F.transform("_shown", one), own.border)
    alone = F.size("_shown") == 0
    if adapt:
        alone = alone | ~F.coalesce(F.col(gt).isin(*"ABCDE"), F.lit(False))
    asked = F.col(question)
    context = _fill(own.question, "{input}", asked)
    joined = _fill(own.question, "{input}", F.concat(demos, F.lit(own.border), asked)) if single else F.concat(demos, F.lit(own.border), context)
    prompt = F.when(alone, context).otherwise(joined)
    prompt = _fill(_WRAP[template], "{input}", prompt) if template in _WRAP else prompt
    return rows.withColumn(out, F.btrim(prompt, F.lit(" "))).drop("_shown")


def sample_of(df: DataFrame, key: str, value, fields: list[str] | None = None) -> DataFrame:
    """One record as (field, value) rows, for looking at: the row with that key, fields in the table's order or as listed, NULL fields left out."""
    names = [c for c in (fields or df.columns) if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(k).alias("no"), F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for k, c in enumerate(names)])
    return df.where(F.col(key) == F.lit(value)).limit(1).select(F.explode(pairs).alias("x")).select("x.no", "x.field", "x.value").where(F.col("value").isNotNull())
