"""Scores of rendered sequences by task: maths, logic, instructions, and what waits for a judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions import answers as N
from rollmill.functions import checkers as C
from rollmill.functions import text as X

#: Scores of maths answers: right, wrong, without a box; of a sequence that can't be read.
RIGHT, WRONG, UNBOXED, UNREADABLE = 2.0, -1.5, -2.0, -2.0
#: Fixed value: a task of this ending is scored without looking at the tags.
WITHOUT_FORMAT = "woFormat"
#: Fixed value: the words that open the field of a prompt's stored number of instructions followed without reasoning.
REFERENCE_FIELD = "follow_score"


def _score_of(hits: Column, n: Column) -> Column:
    return C.combined_score(hits, n)


def task_scores(df: DataFrame, sequence: str, target: str, task: str, reference_field: str = "follow_score_reference", only: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with ``template``, ``format_score``, ``format_correct``, ``answer_score``, ``answer_correct``, ``superior`` and ``pending``.

    The task's name begins with its kind: *default* (also NULL: the extracted answer against the target, -2 without a box), *kk* (roles of a
    puzzle), *ifeval* (instructions of the target's JSON; 2 if all are followed, -2 if none is, else their share) or *complex* (``pending``
    is true where a judge must decide, else the score is -2). Names that end in "woFormat" are scored on the whole output, with format
    score 1. ``superior`` tells whether as many instructions are followed as the target's ``reference_field`` says (0 if missing); it is
    true where nothing was compared. Sequences of no known encoding get -2, format score -1 and no format. Unknown tasks raise an error.
    NULL sequences or targets, and targets that can't be read, score as wrong. The table isn't shuffled.
    """
    kind = F.coalesce(F.col(task), F.lit("default"))
    rows = df.withColumn("template", X.template_of(F.col(sequence))).withColumn("_out", X.model_output(F.col(sequence)))
    out = F.col("_out")
    plain = F.col("template") == "deepseek"
    formed = F.when(plain, X.well_formed(out, "deepseek")).otherwise(X.well_formed(out))
    loose = kind.endswith(WITHOUT_FORMAT)
    rows = rows.withColumn("_loose", loose).withColumn("_formed", F.coalesce(formed, F.lit(False)))
    answer = F.when(plain, X.answer_of(out, "deepseek")).otherwise(X.answer_of(out))
    rows = rows.withColumn("_answer", F.when(F.col("_loose"), out).otherwise(answer)).withColumn("_think", X.think_of(out))
    rows = rows.withColumn("_usable", F.coalesce(F.col("_loose") & (F.col("_answer") != ""), F.lit(False)) | X.usable(F.col("_think"), F.col("_answer"), F.col("_formed")))

    text = F.col("_answer")
    roles = X.knights(F.get_json_object(target, "$.solution_text_format"))
    rows = rows.withColumn("_roles", F.when(kind.startswith("kk"), X.knight_answers(text, roles)))
    ids = F.from_json(F.get_json_object(target, "$.instruction_id_list"), "array<string>")
    arguments = F.from_json(F.get_json_object(target, "$.kwargs"), "array<map<string,string>>")
    stated = kind.startswith("ifeval")
    names = tuple(only or C.REGISTRY)
    rows = rows.withColumn("_stated", F.when(stated & F.col("_usable"), F.struct(ids.alias("ids"), arguments.alias("arguments"))))
    known = {}
    for k, name in enumerate(n for n in names if n in C.BY_TEXT):
        wanted = F.when(F.array_contains(F.col("_stated.ids"), name), text)
        rows = rows.withColumn(f"_known{k}", C.BY_TEXT[name](wanted))
        known[name] = F.col(f"_known{k}")
    rows = rows.withColumn("_followed", C.followed(text, F.col("_stated.ids"), F.col("_stated.arguments"), names, known))
    hits, n = F.size(F.filter("_followed", lambda x: x)), F.size("_followed")
    rows = rows.withColumn("_equal", F.when(kind == "default", N.maths_equal(N.cleaned_answer(out), F.col(target))))

    maths = F.when(~out.contains("boxed"), F.lit(UNBOXED)).when(F.col("_equal"), F.lit(RIGHT)).otherwise(F.lit(WRONG))
    logic = F.when(~F.col("_usable") | F.col("_roles").isNull(), F.lit(-2.0)).when(F.col("_roles"), F.lit(2.0)).otherwise(F.lit(-1.5))
    obeyed = F.when(F.col("_usable") & (n > 0), _score_of(hits, n)).otherwise(F.lit(-2.0))
    waits = kind.startswith("complex") & F.col("_usable") & F.col("template").isNotNull()
    readable = F.col("template").isNotNull()
    score = (
        F.when(~readable, F.lit(UNREADABLE)).when(kind == "default", maths).when(kind.startswith("kk"), logic).when(stated, obeyed)
        .when(kind.startswith("complex"), F.when(waits, F.lit(None).cast("double")).otherwise(F.lit(-2.0)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown task "), kind)).cast("double"))
    )
    share = F.when(F.col("_usable") & (n > 0), F.when(hits == 0, F.lit(0.0)).otherwise(hits / n)).otherwise(F.lit(0.0))
    correct = F.when(kind == "default", F.coalesce(F.col("_equal"), F.lit(False)).cast("double")).when(kind.startswith("kk"), (F.col("_usable") & F.coalesce(F.col("_roles"), F.lit(False))).cast("double")).when(stated, share)
    reference = F.coalesce(F.get_json_object(target, f"$.{reference_field}").try_cast("double"), F.lit(0.0))
    scored = (
        rows.withColumn("format_score", F.when(readable & (F.col("_loose") | F.col("_formed")), F.lit(1.0)).otherwise(F.lit(-1.0)))
        .withColumn("format_correct", (readable & F.col("_formed")).cast("double"))
        .withColumn("answer_score", score)
        .withColumn("answer_correct", F.when(readable, F.coalesce(correct, F.lit(0.0))).otherwise(F.lit(0.0)))
        .withColumn("superior", F.when(stated & F.col("_usable") & readable, F.coalesce(hits >= reference, F.lit(True))).otherwise(F.lit(True)))
        .withColumn("pending", F.coalesce(waits, F.lit(False)))
    )
    return scored.drop("_out", "_loose", "_formed", "_answer", "_think", "_usable", "_roles", "_stated", "_followed", "_equal", *[f"_known{k}" for k in range(len(known))])
