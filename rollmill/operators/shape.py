"""Raw records to training rows: chat rendering, filters, pairs, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollmill.functions.text import finish, strip


def present(df: DataFrame, name: str) -> Column:
    """Whether a row has a non-null value in an optional column (false if the column is missing)."""
    return F.col(name).isNotNull() if name in df.columns else F.lit(False)


def lower_columns(df: DataFrame) -> DataFrame:
    """Column names in lower case; names that would clash raise."""
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("column names differ only in case")
    return df.toDF(*names)


def fill_template(template: str, prompt: Column) -> Column:
    """The template with its one {} filled."""
    before, _, after = template.partition("{}")
    return F.concat(F.lit(before), prompt, F.lit(after))


def render_chat(messages: Column, generation: bool = False) -> Column:
    """An array of (role, content) as one string, each turn between its marks; an open assistant turn on request."""
    turns = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    text = F.array_join(turns, "")
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if generation else text


def sft_rows(df: DataFrame, prompt: str, response: str, length: Column, max_length: int, template: str | None = None, pretrain: bool = False) -> DataFrame:
    """Prompt and response with the prompt's length; rows with an empty side or a prompt of ``max_length - 2`` or more are dropped.

    Pretraining rows have no prompt: length 0 and only the response must not be empty.
    """
    text = fill_template(template, F.col(prompt)) if template else F.col(prompt)
    out = df.withColumn("prompt_ids_len", (F.lit(0) if pretrain else length).cast("int")).withColumn("_text", F.lit("") if pretrain else text)
    keep = (F.col(response) != "") & F.col(response).isNotNull()
    if not pretrain:
        keep = keep & (F.col(prompt) != "") & (F.col("prompt_ids_len") < max_length - 2)
    return out.where(keep).withColumn(prompt, F.col("_text")).drop("_text")


def turn_ranges(turns: DataFrame, conversation: str, order: str, role: str, length: Column) -> DataFrame:
    """(conversation, order, start, end) of every assistant turn, inclusive, in units of ``length``. Conversations are small."""
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("_n", length).withColumn("start_pos", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("int"))
    return placed.where(F.col(role) == "assistant").select(conversation, order, "start_pos", (F.col("start_pos") + F.col("_n") - 1).cast("int").alias("end_pos"))


def split_turns(df: DataFrame, id: str, text: str) -> DataFrame:
    """Conversations rendered as "User: ..." and "Assistant: ..." lines, as rows (id, turn, role, content)."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.col(text)), r"\n(User|Assistant): ?", "\u0001$1\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: p.contains("\u0002"))
    rows = df.select(id, F.posexplode(parts).alias("turn", "part"))
    return rows.select(id, "turn", F.lower(F.substring_index("part", "\u0002", 1)).alias("role"), F.substring_index("part", "\u0002", -1).alias("content"))


def preference_rows(df: DataFrame, prompt: str, chosen: str, rejected: str, margin: str | None, length: Column, max_length: int, dpo: bool) -> DataFrame:
    """Prompt ('' if missing), chosen, rejected, margin (0 if missing) and prompt length; DPO drops prompts of ``max_length - 2`` or more."""
    m = F.coalesce(F.col(margin), F.lit(0.0)) if margin and margin in df.columns else F.lit(0.0)
    out = df.select(*[c for c in df.columns if c not in (prompt, chosen, rejected, margin)], F.coalesce(prompt, F.lit("")).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"), m.alias("margin"), length.cast("int").alias("prompt_ids_len"))
    return out.where(F.col("prompt_ids_len") < max_length - 2) if dpo else out


def unpaired_rows(df: DataFrame, prompt: str, response: str, label: Column, length: Column, max_length: int) -> DataFrame:
    """Prompt, response, label and prompt length, without over-long prompts; empty texts stay."""
    out = df.select(*[c for c in df.columns if c not in (prompt, response)], F.col(prompt).alias("prompt"), F.col(response).alias("response"), label.cast("int").alias("label"), length.cast("int").alias("prompt_ids_len"))
    return out.where(F.col("prompt_ids_len") < max_length - 2)


def prompt_rows(df: DataFrame, input: str, label: str | None = None, template: str | None = None) -> DataFrame:
    """Prompt (in its template) and label ('' without a label column)."""
    text = fill_template(template, F.col(input)) if template else F.col(input)
    rest = [c for c in df.columns if c not in (input, label)]
    return df.select(*rest, text.alias("prompt"), (F.coalesce(label, F.lit("")) if label else F.lit("")).alias("label"))


def few_shot(examples: Column, question: Column, shots: int, separator: str = "\n\n") -> Column:
    """Question and answer pairs of the first ``shots`` examples, then the question."""
    shown = F.transform(F.slice(examples, 1, shots), lambda e: F.concat(F.lit("Question: "), e["question"], F.lit("\nAnswer: "), e["answer"]))
    return F.concat(F.array_join(shown, separator), F.lit(separator if shots else ""), F.lit("Question: "), question, F.lit("\nAnswer:"))


def paired_rows(
    df: DataFrame, chosen: str, rejected: str, prompt: str | None = None, margin: str | None = None, messages: bool = False, template: str | None = None, dpo: bool = False, eos: str | None = None
) -> DataFrame:
    """``prompt``, ``chosen``, ``rejected`` and ``margin`` of paired preferences, whichever form they have.

    Texts: the prompt (in its template, '' without a prompt column) and both answers. ``messages``: arrays of (role, content). With a prompt
    column, that conversation is rendered with an open assistant turn and the answers are what follows it; without one, whole conversations
    are rendered, and for ``dpo`` all but the last turn are the prompt, which is cut off both answers. A missing margin is 0. With ``eos``
    the answers lose trailing line breaks and end in that mark.
    """
    m = F.coalesce(F.col(margin), F.lit(0.0)) if margin and margin in df.columns else F.lit(0.0)
    if messages:
        sides = [F.col(c) for c in (chosen, rejected)]
        if prompt:
            head = render_chat(F.col(prompt), True)
            whole = [render_chat(F.concat(F.col(prompt), s)) for s in sides]
        elif dpo:
            head = render_chat(F.slice(sides[0], F.lit(1), F.greatest(F.size(sides[0]) - 1, F.lit(0))), True)
            whole = [render_chat(s) for s in sides]
        else:
            head, whole = F.lit(""), [render_chat(s) for s in sides]
        answers = [F.substring(w, F.length(head) + 1, F.length(w)) for w in whole]
    else:
        head = F.coalesce(F.col(prompt), F.lit("")) if prompt else F.lit("")
        head = fill_template(template, head) if template and prompt else head
        answers = [F.col(chosen), F.col(rejected)]
    if eos:
        answers = [finish(F.lit(""), a, eos) for a in answers]
    kept = [c for c in df.columns if c not in (prompt, chosen, rejected, margin, "prompt", "chosen", "rejected", "margin")]
    return df.select(*kept, head.alias("prompt"), answers[0].alias("chosen"), answers[1].alias("rejected"), m.alias("margin"))


def inference_prompt(prompt: Column, suffix: str) -> Column:
    """A prompt with the suffix that reward-conditioned training gave it, stripped and closed by one blank."""
    return F.concat(prompt, F.lit(suffix.strip() + " "))


def user_text(x: Column) -> Column:
    """The last user text of a rendered prompt in any of five encodings; other text as it is."""
    after = lambda mark: F.substring_index(x, mark, -1)
    return strip(
        F.when(x.contains("<|im_start|>user\n"), F.substring_index(after("<|im_start|>user\n"), "<|im_end|>", 1))
        .when(x.contains("<｜User｜>"), F.substring_index(after("<｜User｜>"), "<｜Assistant｜>", 1))
        .when(x.contains("user<|end_header_id|>"), F.substring_index(after("user<|end_header_id|>"), "<|eot_id|>", 1))
        .when(x.contains("[INST]"), F.substring_index(after("[INST]"), "[/INST]", 1))
        .when(x.contains("User:"), F.substring_index(after("User:"), "Assistant:", 1))
        .otherwise(x)
    )


def symmetric_conflicts(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """A conflict table closed under swapping, without self-conflicts and repeats."""
    one = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))
    return one.union(one.select("b", "a")).where(F.col("a") != F.col("b")).distinct()


def both_sides(df: DataFrame, keep: list[str], chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Chosen and rejected texts as rows with their side, chosen first."""
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("text")) for i, c in enumerate((chosen, rejected))])
    return df.select(*keep, F.explode(sides).alias("s")).select(*keep, "s.side", "s.text")
