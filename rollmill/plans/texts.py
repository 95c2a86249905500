"""Queries over text: tags, structure, instruction checkers, answers, shaped rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.functions import answers as N
from rollmill.functions import chat, scoring, steps
from rollmill.functions import checkers as C
from rollmill.functions import languages as G
from rollmill.functions import rewards as R
from rollmill.functions import text as X
from rollmill.functions.sentences import sentences_of
from rollmill.plans.tables import table


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sft_pairs").where(F.col("response").isNotNull()).select("seq", "prompt", F.col("response").alias("x"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where(F.col("text").isNotNull()).select("doc_id", F.col("text").alias("x"))


def extract_tags(spark, folder):
    return _answers(spark, folder).select("seq", X.think_of(F.col("x")).alias("think"), X.answer_of(F.col("x")).alias("answer"))


def extract_after_thinking(spark, folder):
    return _answers(spark, folder).select("seq", X.answer_of(F.col("x"), "deepseek").alias("answer"))


def validate_structure(spark, folder):
    return _answers(spark, folder).select("seq", X.well_formed(F.col("x")).alias("formed"), X.well_formed(F.col("x"), "deepseek").alias("formed_plain"))


def loose_format(spark, folder):
    return _answers(spark, folder).select("seq", X.loose_format(F.col("x")).alias("ok"))


def judge_eligibility(spark, folder):
    x = F.col("x")
    pending = X.well_formed(x) & (X.answer_of(x) != "") & (X.think_of(x) != "") & (X.think_of(x) != X.PLACEHOLDER_THINKING)
    return _answers(spark, folder).select("seq", F.when(F.coalesce(pending, F.lit(False)), F.lit(None).cast("double")).otherwise(F.lit(-2.0)).alias("score"))


def _puzzles(spark, folder):
    """Puzzles with an answer made of their solution: right, one role turned, a role missing or no tags, by seq modulo 4."""
    rows = table(spark, folder, "box_prompts").where(F.col("task").startswith("kk") & F.col("target").isNotNull())
    solution = F.get_json_object("target", "$.solution_text_format")
    turned = F.regexp_replace(solution, r"knight(?![\s\S]*knight)", "knave")
    short = F.regexp_replace(solution, r"\n[^\n]*$", "")
    said = F.when(F.col("seq") % 4 == 1, turned).when(F.col("seq") % 4 == 2, short).otherwise(solution)
    x = F.when(F.col("seq") % 4 == 3, said).otherwise(F.concat(F.lit("<think>step by step</think>\n<answer>"), said, F.lit("</answer>")))
    return rows.where(solution.isNotNull()).select("seq", solution.alias("solution"), x.alias("x"))


def logic_truth(spark, folder):
    roles = X.knights(F.col("solution"))
    return _puzzles(spark, folder).select("seq", F.explode(roles).alias("name", "role"))


def kk_score(spark, folder):
    x = F.col("x")
    roles = X.knights(F.col("solution"))
    return _puzzles(spark, folder).select("seq", X.knight_score(X.answer_of(x), X.think_of(x), X.well_formed(x), roles).alias("score"), F.coalesce(X.knight_answers(X.answer_of(x), roles), F.lit(False)).alias("correct"))


def _sequences(spark, folder):
    """Whole answers, with the marks that they hold, as rendered sequences in the five encodings, by seq modulo 6 (the sixth fits none), closed by a stop word."""
    k = F.col("seq") % 6
    body = F.concat(F.lit("<think>because</think><answer>"), F.col("x"), F.lit("</answer>"))
    head = (
        F.when(k == 0, F.lit("<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\n")).when(k == 1, F.lit("<｜begin▁of▁sentence｜><｜User｜>Hi<｜Assistant｜>"))
        .when(k == 2, F.lit("<|start_header_id|>user<|end_header_id|>Hi<|start_header_id|>assistant<|end_header_id|>")).when(k == 3, F.lit("[INST] Hi [/INST]")).when(k == 4, F.lit("User: Hi\nAssistant:")).otherwise(F.lit("Hi "))
    )
    end = F.when(k == 0, F.lit("<|im_end|>")).when(k == 1, F.lit("<｜end▁of▁sentence｜>")).when(k == 2, F.lit("<|eot_id|>")).otherwise(F.lit("</s>"))
    return _answers(spark, folder).select("seq", F.concat(head, body, end, F.lit("rest")).alias("x"))


def sequence_route(spark, folder):
    x = F.col("x")
    return _sequences(spark, folder).select("seq", X.template_of(x).alias("template"), X.model_output(x).alias("output"))


def ngram_counts(spark, folder):
    g = X.ngrams(X.words(F.col("x")), 3)
    return _answers(spark, folder).select("seq", F.size(g).alias("n"), F.size(F.array_distinct(g)).alias("n_distinct"))


def repetition_penalty(spark, folder):
    return _answers(spark, folder).select("seq", F.round(F.abs(X.repetition_penalty(X.words(F.col("x")), 2, -0.5)), 6).alias("penalty"))


def repetition_dense(spark, folder):
    d = R.repetition_dense(X.words(F.col("x")), 2, -1.0)
    return _answers(spark, folder).select("seq", F.size(F.filter(d, lambda v: v < 0)).alias("n_repeated"), F.size(d).alias("n"))


def strip_marks(spark, folder):
    x = F.concat(F.lit("<pad><pad></s>"), F.col("x"), F.lit("</s></s><pad>"))
    return _answers(spark, folder).select("seq", X.strip_marks(x, "</s>", "<pad>").alias("text"))


def finish_text(spark, folder):
    t = X.finish(F.coalesce("prompt", F.lit("")), F.col("x"), "</s>")
    return _answers(spark, folder).select("seq", t.alias("text"))


def box_prompts_thinking(spark, folder):
    rows = table(spark, folder, "box_prompts").where(F.col("input").isNotNull())
    p = X.with_thinking(F.col("input"))
    return rows.select("seq", p.alias("prompt"), F.coalesce("task", F.lit("default")).alias("task"))


def task_scores(spark, folder):
    """Score of default tasks: 2 or -1.5 by the boxed answer, -2 without a box; the answer of every third row is made right."""
    rows = table(spark, folder, "box_prompts").where((F.coalesce("task", F.lit("default")) == "default") & F.col("target").isNotNull())
    x = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("So \\boxed{"), F.col("target"), F.lit("}"))).when(F.col("seq") % 3 == 1, F.lit("So \\boxed{0}")).otherwise(F.concat(F.lit("The answer is "), "target"))
    right = N.number_matches(N.number(N.extract_answer(x)), N.number(F.col("target")))
    return rows.select("seq", F.when(~x.contains("boxed"), F.lit(-2.0)).when(right, F.lit(2.0)).otherwise(F.lit(-1.5)).alias("score"), right.alias("correct"))


def boxed_answers(spark, folder):
    return _answers(spark, folder).select("seq", N.unboxed(N.last_boxed(F.col("x"))).alias("boxed"))


def boxed_match(spark, folder):
    rows = table(spark, folder, "documents").where(F.col("text").isNotNull())
    a = N.final_answer(F.col("text"))
    return rows.select("doc_id", a.alias("answer"), F.when(a == F.lit("65"), F.lit(0.5)).otherwise(F.lit(-0.5)).alias("score"))


def extracted_answers(spark, folder):
    return _answers(spark, folder).select("seq", N.extract_answer(F.col("x")).alias("answer"))


def numeric_equal(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "value")
    a, b = F.col("value"), F.col("value") * (1 + (F.col("event_id") % 7 - 3) * 0.00005)
    return rows.select("event_id", N.numbers_equal(a, b).alias("near"), N.numbers_equal(a, b, False).alias("near_absolute"), N.number_matches(a, b * 100).alias("matches"))


def parse_numbers(spark, folder):
    rows = table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.format_number(F.col("value") * 1000, 1))).when(F.col("event_id") % 3 == 1, F.concat(F.round("value", 2).cast("string"), F.lit("%"))).otherwise(F.col("event_type")).alias("x"))
    return rows.select("event_id", F.round(N.number(F.col("x")), 6).alias("number"))


def canonical_equal(spark, folder):
    """Fractions in two spellings: equal in canonical form, and equal in value (halves and two quarters, say)."""
    n = F.col("event_id")
    part = lambda by, of, more: (F.floor(n / by) % of + more).cast("string")
    a, b = F.concat(F.lit("\\dfrac{"), part(1, 9, 1), F.lit("}{"), part(1, 5, 2), F.lit("}")), F.concat(part(7, 9, 1), F.lit("/"), part(3, 5, 2))
    return table(spark, folder, "events").select("event_id", N.equivalent(a, b).alias("same"), N.maths_equal(a, b).alias("equal"))


def judge_verdict(spark, folder):
    """Questions of three per query with log-probabilities of YES and NO: all true 2, none -2, else the share."""
    rows = table(spark, folder, "events").select(F.floor(F.col("event_id") / 3).cast("bigint").alias("query_idx"), F.col("value").alias("yes"), (F.lit(30.0) - F.col("value")).alias("no"))
    g = rows.groupBy("query_idx").agg(F.sum((F.col("yes") > F.col("no")).cast("bigint")).alias("n_true"), F.count("*").alias("n"))
    return g.select("query_idx", "n_true", F.round(C.combined_score(F.col("n_true"), F.col("n")), 6).alias("score"))


def scatter_back(spark, folder):
    """Judge scores joined back to their rows; rows that weren't judged keep the default."""
    judged = judge_verdict(spark, folder).where(F.col("query_idx") % 2 == 0)
    rows = table(spark, folder, "sft_pairs").select("seq")
    return rows.join(judged, rows.seq == judged.query_idx, "left").select("seq", F.coalesce("score", F.lit(-2.0)).alias("score"))


def judge_pairs(spark, folder):
    """A YES and a NO row for every scoring question of a prompt."""
    rows = table(spark, folder, "box_prompts").where(F.col("task").startswith("complex"))
    q = rows.select("seq", F.posexplode(F.from_json(F.get_json_object("target", "$.scoring_questions"), "array<string>")).alias("q_pos", "question"))
    return q.select("seq", "q_pos", F.explode(F.array(F.lit("YES"), F.lit("NO"))).alias("verdict"), "question")


_RE2 = {"IsHiragana": "Hiragana", "IsKatakana": "Katakana", "IsHangul": "Hangul", "IsHan": "Han", "IsCyrillic": "Cyrillic", "IsArabic": "Arabic", "IsHebrew": "Hebrew", "IsGreek": "Greek", "IsDevanagari": "Devanagari", "IsThai": "Thai", "IsBengali": "Bengali", "IsTamil": "Tamil", "IsTelugu": "Telugu", "IsKannada": "Kannada", "IsGujarati": "Gujarati", "IsGurmukhi": "Gurmukhi", "IsMalayalam": "Malayalam"}


def _re2(pattern: str) -> str:
    for java, own in _RE2.items():
        pattern = pattern.replace("{" + java + "}", "{" + own + "}")
    return pattern


_WORD_LIST = "regexp_extract_all(lower(x), '\\p{L}+')"
_VOTES = ", ".join(f"len(list_filter({_WORD_LIST}, lambda w: list_contains([{', '.join(repr(w) for w in words)}], w)))" for words in G.FUNCTION_WORDS.values())
_BY_SCRIPT = " ".join(f"WHEN len(regexp_extract_all(x, '{_re2(pattern)}')) > {0.05 if code == 'ja' else G.MOST_LETTERS} * len(regexp_extract_all(x, '\\p{{L}}')) THEN '{code}'" for code, pattern in G.SCRIPTS.items())
#: The language of x in DuckDB.
_LANGUAGE = f"(CASE {_BY_SCRIPT} WHEN list_max([{_VOTES}]) > 0 THEN [{', '.join(repr(c) for c in G.FUNCTION_WORDS)}][list_position([{_VOTES}], list_max([{_VOTES}]))] END)"

#: name: (checker of the text, DuckDB expression of x)
_CHECKS = {
    "keyword_existence": (lambda x: C.keywords_exist(x, F.array(F.lit("answer"), F.lit("THE"))), "contains(lower(x), 'answer') AND contains(lower(x), 'the')"),
    "keyword_frequency": (lambda x: C.keyword_frequency(x, "the", "at least", 5), "len(regexp_extract_all(lower(x), 'the')) >= 5"),
    "forbidden_words": (lambda x: C.no_forbidden_words(x, F.array(F.lit("practice"), F.lit("link"))), "NOT regexp_matches(x, '(?i)(^|[^\\p{L}\\p{N}_])(practice|link)($|[^\\p{L}\\p{N}_])')"),
    "letter_frequency": (lambda x: C.letter_frequency(x, "e", "less than", 40), "length(lower(x)) - length(replace(lower(x), 'e', '')) < 40"),
    "number_words": (lambda x: C.word_count(x, "at least", 50), "len(regexp_extract_all(x, '[\\p{L}\\p{N}_]+')) >= 50"),
    "number_paragraphs": (lambda x: C.paragraphs(F.replace(x, F.lit("\n\n"), F.lit(" *** ")), 2), "len(list_filter(regexp_split_to_array(replace(x, chr(10) || chr(10), ' *** '), '[\\s]?\\*\\*\\*[\\s]?'), lambda p: regexp_matches(p, '[^\\s\\x{00a0}\\x{200b}]'))) = 2 AND len(list_filter(regexp_split_to_array(replace(x, chr(10) || chr(10), ' *** '), '[\\s]?\\*\\*\\*[\\s]?')[2:-2], lambda p: NOT regexp_matches(p, '[^\\s\\x{00a0}\\x{200b}]'))) = 0"),
    "first_word": (lambda x: C.nth_paragraph_first_word(x, 1, "in", 2), "len(list_filter(string_split(x, chr(10) || chr(10)), lambda p: regexp_matches(p, '[^\\s]'))) = 2 AND regexp_matches(string_split(x, chr(10) || chr(10))[1], '^\\s*[''\"]*[Ii][Nn]([.,?!''\"].*)?(\\s|$)')"),
    "placeholders": (lambda x: C.placeholders(x, 1), "regexp_matches(x, '\\[.*?\\]')"),
    "postscript": (lambda x: C.postscript(x, "P.S."), "regexp_matches(lower(x), 'p\\.\\s?s\\.')"),
    "bullet_lists": (lambda x: C.bullets(x, 3), "len(regexp_extract_all(x, '(?m)^\\s*\\*[^\\*].*$')) + len(regexp_extract_all(x, '(?m)^\\s*-.*$')) = 3"),
    "constrained_response": (lambda x: C.constrained_response(x), "contains(x, 'My answer is yes.') OR contains(x, 'My answer is no.') OR contains(x, 'My answer is maybe.')"),
    "highlights": (lambda x: C.highlights(x, 1), "regexp_matches(x, '\\*[^\\n\\*]*[^\\n\\*\\s][^\\n\\*]*\\*')"),
    "multiple_sections": (lambda x: C.sections(x, "Step", 2), "len(regexp_extract_all(x, '\\s?Step\\s?\\d+\\s?')) >= 2"),
    "title": (lambda x: C.title(x), "regexp_matches(x, '<<[^\\n]*[^\\n<>\\s][^\\n]*>>')"),
    "two_responses": (lambda x: C.two_responses(F.concat(x, F.lit("******"), F.lower(x))), "x <> lower(x) AND regexp_matches(x, '[^\\s]')"),
    "end_phrase": (lambda x: C.ends_with(x, "enough."), "ends_with(lower(rtrim(rtrim(x, ' ' || chr(10) || chr(9)), '\"')), 'enough.')"),
    "capital_words": (lambda x: C.capital_words(x, "at least", 3), None),
    "english_capital": (lambda x: C.all_capitals(x), f"x = upper(x) AND x <> lower(x) AND coalesce({_LANGUAGE} = 'en', TRUE)"),
    "english_lowercase": (lambda x: C.all_lower(x), f"x = lower(x) AND x <> upper(x) AND coalesce({_LANGUAGE} = 'en', TRUE)"),
    "response_language": (lambda x: C.response_language(x, "de"), f"coalesce({_LANGUAGE} = 'de', TRUE)"),
    "no_comma": (lambda x: C.no_comma(x), "NOT contains(x, ',')"),
    "quotation": (lambda x: C.in_quotes(x), "length(trim(x, ' ' || chr(10) || chr(9))) > 1 AND starts_with(trim(x, ' ' || chr(10) || chr(9)), '\"') AND ends_with(trim(x, ' ' || chr(10) || chr(9)), '\"')"),
    "json_format": (lambda x: C.json_valid(x), None),
    "xml_format": (lambda x: C.xml_valid(x), None),
    "number_sentences": (lambda x: C.sentences(x, "at least", 4), None),
    "constrained_start": (lambda x: C.constrained_start(x, "In practice"), "regexp_matches(x, '(?m)^\\s*In practice')"),
}


def _check(build):
    return lambda spark, folder: _answers(spark, folder).select("seq", build(F.col("x")).alias("followed"))


def repeat_prompt(spark, folder):
    rows = _answers(spark, folder).where(F.col("prompt").isNotNull())
    return rows.select("seq", C.repeats_prompt(F.col("x"), F.col("prompt")).alias("followed"))


_INSTRUCTIONS = ("punctuation:no_comma", "length_constraints:number_words", "keywords:letter_frequency")


def _instructed(spark, folder):
    args = F.array(
        F.create_map(F.lit("none"), F.lit("")), F.create_map(F.lit("relation"), F.lit("at least"), F.lit("num_words"), F.lit("60")),
        F.create_map(F.lit("letter"), F.lit("e"), F.lit("let_relation"), F.lit("less than"), F.lit("let_frequency"), F.lit("60")),
    )
    return _answers(spark, folder).select("seq", "x", F.array(*map(F.lit, _INSTRUCTIONS)).alias("ids"), args.alias("args"))


def _followed(rows, found):
    counted = rows.select("seq", found.alias("f")).select("seq", F.size(F.filter("f", lambda y: y)).cast("bigint").alias("n_followed"), F.size("f").alias("n"))
    return counted.select("seq", "n_followed", F.round(C.combined_score(F.col("n_followed"), F.col("n")), 6).alias("score"))


def ifeval_strict(spark, folder):
    """Instructions followed by each answer, and their combined score; a blank answer follows none."""
    rows = _instructed(spark, folder)
    return _followed(rows, C.followed(F.col("x"), F.col("ids"), F.col("args"), _INSTRUCTIONS))


def ifeval_loose(spark, folder):
    """As strict, but any of eight variants of the answer may follow an instruction."""
    rows = _instructed(spark, folder)
    return _followed(rows, C.followed_loosely(F.col("x"), F.col("ids"), F.col("args"), _INSTRUCTIONS))


def _lengths(spark, folder):
    return table(spark, folder, "sft_pairs").where(F.col("response").isNotNull()).select("seq", F.length("response").alias("n"), (F.col("seq") % 3 == 0).alias("right"), F.col("response").alias("x"))


def classic_reward(spark, folder):
    return _lengths(spark, folder).select("seq", R.classic(F.col("n"), F.col("right"), 600, 1.0, -0.5, -2.0).alias("reward"))


def cosine_reward(spark, folder):
    p = X.repetition_penalty(X.words(F.col("x")), 2, -0.5)
    return _lengths(spark, folder).select("seq", F.round(R.cosine(F.col("n"), F.col("right"), 600, (0.5, 1.0), (-1.0, -0.5), -2.0, p), 6).alias("reward"))


def length_scaled_reward(spark, folder):
    return _lengths(spark, folder).select("seq", F.round(R.length_scaled(F.col("n"), F.col("right"), 600, 0.6, -2.0), 6).alias("reward"))


def bag_overlap(spark, folder):
    """Words shared by both answers of a pair, repeats counted: the smaller of both counts, summed."""
    rows = table(spark, folder, "preference_pairs").where(F.col("chosen").isNotNull() & F.col("rejected").isNotNull())
    w = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"({X.WORD}+)"), F.lit(1))
    both = rows.select("seq", F.explode(F.concat(F.transform(w("chosen"), lambda t: F.struct(t.alias("w"), F.lit(1).alias("c"), F.lit(0).alias("j"))), F.transform(w("rejected"), lambda t: F.struct(t.alias("w"), F.lit(0).alias("c"), F.lit(1).alias("j"))))).alias("t"))
    counted = both.groupBy("seq", "t.w").agg(F.sum("t.c").alias("c"), F.sum("t.j").alias("j"))
    return counted.groupBy("seq").agg(F.sum(F.least("c", "j")).alias("shared"), F.sum(F.greatest("c", "j")).alias("union"))


def text_language(spark, folder):
    return _documents(spark, folder).select("doc_id", G.language(F.col("x")).alias("language"))


def canonical_answers(spark, folder):
    """Extracted answers in canonical form, and the choice that an answer names."""
    x = F.col("x")
    return _answers(spark, folder).select("seq", N.cleaned_answer(x).alias("answer"), N.clean_choice(x).alias("choice"), N.last_choice(x).alias("last_choice"))


def choice_said(spark, folder):
    return _answers(spark, folder).select("seq", N.said_choice(F.col("x")).alias("choice"))


def final_answers(spark, folder):
    """Three more readings of an answer: in plain form, what "the answer is:" introduces, and the best of five against its own box."""
    x = F.col("x")
    gold = N.unboxed(N.last_boxed(x))
    return _answers(spark, folder).select("seq", N.final_text(x).alias("plain"), N.answer_said(x).alias("said"), N.best_reading(x, gold).alias("reading"))


def number_words(spark, folder):
    """Numbers below a hundred, spelled out and read again."""
    n = (F.col("event_id") % 100).cast("int")
    ones, tens = F.array(*map(F.lit, N.latex.ONES)), F.array(F.lit(""), F.lit(""), *map(F.lit, N.latex.TENS))
    ten = F.get(tens, F.floor(n / 10).cast("int"))
    spelled = F.when(n < 20, F.get(ones, n)).when(n % 10 == 0, ten).otherwise(F.concat(ten, F.lit("-"), F.get(ones, n % 10)))
    return table(spark, folder, "events").select("event_id", N.digits_of_words(spelled).alias("number"))


def requests(spark, folder):
    """System and last user text of every prompt, by its encoding."""
    rows = table(spark, folder, "box_prompts").where(F.col("input").isNotNull())
    e = chat.encoding_of(F.col("input"))
    return rows.select("seq", e.alias("encoding"), chat.request_of(F.col("input"), e).alias("request"))


def judge_prompts(spark, folder):
    """What a judge is asked about each prompt, once for every scoring question."""
    rows = table(spark, folder, "box_prompts").where(F.col("task").startswith("complex") & F.col("input").isNotNull())
    q = rows.select("seq", "input", F.posexplode(F.from_json(F.get_json_object("target", "$.scoring_questions"), "array<string>")).alias("q_pos", "question"))
    return q.select("seq", "q_pos", chat.judge_content("Judge.", F.col("input"), F.lit("Done."), F.col("question")).alias("content"))


def judge_sums(spark, folder):
    """Verdicts from summed token log-probabilities of both answers, three tokens each."""
    rows = table(spark, folder, "events").select(F.floor(F.col("event_id") / 4).cast("bigint").alias("query_idx"), "value")
    tokens = F.array(F.col("value") / 3, F.col("value") / 3, F.col("value") / 3)
    yes, no = F.aggregate(tokens, F.lit(0.0), lambda a, v: a + v), F.aggregate(F.transform(tokens, lambda v: F.lit(9.0) - v), F.lit(0.0), lambda a, v: a + v)
    g = rows.groupBy("query_idx").agg(F.sum((yes > no).cast("bigint")).alias("n_true"), F.count("*").alias("n"))
    return g.select("query_idx", "n_true", F.round(C.combined_score(F.col("n_true"), F.col("n")), 6).alias("score"))


def judgements(spark, folder):
    """The last lines of documents, with a verdict put behind some, and what is read off it."""
    verdict = F.element_at(F.array(*map(F.lit, ("correct", "Correct", "wrong", "not_found"))), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.concat(chat.last_lines(F.col("x"), 2), F.lit("\nJUDGEMENT: "), verdict)
    return _documents(spark, folder).select("doc_id", chat.judgement(text).alias("score"), chat.last_lines(text, 2).alias("shown"))


def step_rewrites(spark, folder):
    """Stepwise solutions rewritten for an outcome model, and scored by their box in four ways."""
    x = F.col("x")
    scores = steps.boxed_scores(x, F.lit("65"))
    answered = steps.answered(x, steps.boxed_answer(x))
    return _documents(spark, folder).select("doc_id", steps.numbered_steps(x).alias("steps"), answered.alias("answered"), *[c.alias(k) for k, c in scores.items()])


def sentence_lists(spark, folder):
    """Sentences by rules, and whether the first one is a key sentence of the answer."""
    found = sentences_of(F.col("x"))
    return _answers(spark, folder).select("seq", found.alias("sentences")).select("seq", "sentences", C.key_sentences(F.col("sentences"), F.slice("sentences", 1, 1), 1).alias("followed"))


def rephrase_overlap(spark, folder):
    """Whether both answers of a pair share 10 to 60 words, repeats counted."""
    rows = table(spark, folder, "preference_pairs").where(F.col("chosen").isNotNull() & F.col("rejected").isNotNull())
    return rows.select("seq", C.rephrased_paragraph(F.col("chosen"), F.col("rejected"), 10, 60).alias("followed"))


#: The instruction ids of the test table, as further checkers.
_OWN_IDS = {
    "punct:no_comma": lambda x, k: C.no_comma(x), "layout:bullets": lambda x, k: C.bullets(x, k["num"].cast("int")), "layout:title": lambda x, k: C.title(x),
    "layout:sections": lambda x, k: C.sections(x, "Section", k["num"].cast("int")), "close:postscript": lambda x, k: C.postscript(x, "P.S."), "close:quotes": lambda x, k: C.in_quotes(x),
    "case:lower": lambda x, k: C.all_lower(x), "case:capital_word": lambda x, k: C.capital_words(x, "at least", F.coalesce(k["num"].cast("int"), F.lit(1))),
    "length:words": lambda x, k: C.word_count(x, "at least", k["num"].cast("int")), "length:sentences": lambda x, k: C.sentences(x, "at least", k["num"].cast("int")),
}
for _id, _checker in _OWN_IDS.items():
    C.register(_id, _checker)


def route_scores(spark, folder):
    """Every prompt of every task with an answer in one of the encodings: its own target (its request for instructions), scored by task."""
    k = F.col("seq") % 4
    body = F.when(F.col("task").startswith("kk"), F.get_json_object("target", "$.solution_text_format")).when(F.coalesce("task", F.lit("default")) == "default", F.concat(F.lit("\\boxed{"), "target", F.lit("}"))).otherwise(F.col("input"))
    answer = F.concat(F.lit("<think>step by step</think>\n<answer>"), F.coalesce(body, F.lit("")), F.lit("</answer>"))
    head = F.when(k == 0, F.lit("<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\n")).when(k == 1, F.lit("User: Hi\nAssistant:")).when(k == 2, F.lit("[INST] Hi [/INST]")).otherwise(F.lit("Hi "))
    rows = table(spark, folder, "box_prompts").select("seq", "task", "target", F.concat(head, answer, F.lit("</s>")).alias("sequence"))
    out = scoring.task_scores(rows, "sequence", "target", "task", only=tuple(_OWN_IDS))
    return out.select("seq", "task", "template", "format_score", "answer_score", "answer_correct", "superior", "pending")


QUERIES = {
    f.__name__: f
    for f in (
        extract_tags, extract_after_thinking, validate_structure, loose_format, judge_eligibility, logic_truth, kk_score, sequence_route, ngram_counts, repetition_penalty, repetition_dense, strip_marks, finish_text,
        box_prompts_thinking, task_scores, boxed_answers, boxed_match, extracted_answers, numeric_equal, parse_numbers, canonical_equal, judge_verdict, scatter_back, judge_pairs, repeat_prompt, ifeval_strict,
        ifeval_loose, classic_reward, cosine_reward, length_scaled_reward, bag_overlap, text_language, canonical_answers, choice_said, final_answers, number_words, requests, judge_prompts, judge_sums,
        judgements, step_rewrites, sentence_lists, rephrase_overlap, route_scores,
    )
}
QUERIES |= {f"check_{name}": _check(build) for name, (build, _) in _CHECKS.items()}

_A = "WITH a AS (SELECT seq, prompt, response AS x FROM sft_pairs WHERE response IS NOT NULL)"
_T = lambda tag: f"regexp_replace(regexp_extract_all(x, '(?s)<{tag}>(.*?)</{tag}>', 1)[-1], '^\\s+|\\s+$', '', 'g')"
_CNT = lambda tag: f"(length(x) - length(replace(x, '{tag}', ''))) // {len(tag)}"
_FORMED = f"({_CNT('<think>')} = 1 AND {_CNT('</think>')} = 1 AND {_CNT('<answer>')} = 1 AND {_CNT('</answer>')} = 1 AND instr(x, '<think>') <= instr(x, '</think>') AND instr(x, '</think>') <= instr(x, '<answer>') AND instr(x, '<answer>') <= instr(x, '</answer>'))"
_KK = """
WITH p AS (SELECT seq, json_extract_string(target, '$.solution_text_format') AS s FROM box_prompts WHERE task LIKE 'kk%' AND target IS NOT NULL),
l AS (SELECT seq, s, unnest(string_split(s, chr(10))) AS line, unnest(range(len(string_split(s, chr(10))))) AS i FROM p WHERE s IS NOT NULL),
r AS (SELECT seq, s, i, regexp_extract(line, '(?i)\\b([A-Za-z]+)\\b.*?\\b(knight|knave)\\b', 1) AS name, lower(regexp_extract(line, '(?i)\\b([A-Za-z]+)\\b.*?\\b(knight|knave)\\b', 2)) AS role FROM l)
"""
_W = "(CASE WHEN regexp_matches(x, '[^\\s\\x{00a0}]') THEN regexp_split_to_array(regexp_replace(lower(x), '^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$', '', 'g'), '[\\s\\x{00a0}]+') ELSE [] END)"
_STRIP = lambda x: f"regexp_replace({x}, '^[\\s\\x{{00a0}}\\x{{3000}}]+|[\\s\\x{{00a0}}\\x{{3000}}]+$', '', 'g')"


def _routed() -> str:
    """Sequences as the query makes them, their encoding by its signs, and what follows its last opening, cut at each stop word in turn."""
    heads = ("<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\n", "<｜begin▁of▁sentence｜><｜User｜>Hi<｜Assistant｜>", "<|start_header_id|>user<|end_header_id|>Hi<|start_header_id|>assistant<|end_header_id|>", "[INST] Hi [/INST]", "User: Hi\nAssistant:", "Hi ")
    ends = ("<|im_end|>", "<｜end▁of▁sentence｜>", "<|eot_id|>", "</s>", "</s>", "</s>")
    pick = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "][seq % 6 + 1]"
    kind = " ".join(f"WHEN {' AND '.join(f"contains(s, '{sign}')" for sign in signs)} THEN '{name}'" for name, signs, _ in X.ASSISTANT_HEADS)
    last = " ".join(f"WHEN '{name}' THEN string_split(s, '{signs[-1]}')[-1]" for name, signs, _ in X.ASSISTANT_HEADS)
    steps_ = [
        f"b AS (SELECT seq, {pick(heads)} || '<think>because</think><answer>' || x || '</answer>' || {pick(ends)} || 'rest' AS s FROM a)",
        f"t AS (SELECT seq, s, CASE {kind} END AS template FROM b)", f"o0 AS (SELECT seq, template, '<think>' || CASE template {last} END AS o FROM t)",
    ]
    for k, word in enumerate(X.STOP_WORDS):
        cut = f"string_split(o, '{word}')[1]"
        steps_.append(f"o{k + 1} AS (SELECT seq, template, CASE WHEN contains(o, '{word}') THEN {_STRIP(cut)} ELSE o END AS o FROM o{k})")
    return f"{_A}, {', '.join(steps_)} SELECT seq, template, o AS output FROM o{len(X.STOP_WORDS)}"


_ROUTED = _routed()
_BALANCED = r"[^{}]"
for _ in range(5):
    _BALANCED = rf"(?:[^{{}}]|\{{{_BALANCED}*\}})"
_BOX_TAIL = "string_split(x, 'boxed')[-1]"
_BOXED_INSIDE = f"CASE WHEN NOT starts_with({_BOX_TAIL}, '{{') THEN string_split({_BOX_TAIL}, '$')[1] WHEN regexp_matches({_BOX_TAIL}, '^\\{{{_BALANCED}*\\}}') THEN regexp_extract({_BOX_TAIL}, '^\\{{({_BALANCED}*)\\}}', 1) ELSE {_BOX_TAIL}[2:] END"
_MINERVA = "(?s)final answer is \\$(.*?)\\$\\. I hope"
_LAST_SAID = lambda what: f"string_split(x, '{what}')[-1]"
_EXTRACTED = f"""{_A}, f AS (SELECT seq, CASE WHEN regexp_matches(x, '{_MINERVA}') THEN regexp_extract(x, '{_MINERVA}', 1) WHEN contains(x, 'boxed') THEN {_BOXED_INSIDE}
        WHEN contains(x, 'he answer is') THEN {_LAST_SAID('he answer is')} WHEN contains(x, 'final answer is') THEN {_LAST_SAID('final answer is')}
        WHEN contains(x, '答案是') THEN string_split({_STRIP("string_split(x, '答案是')[2]")}, chr(10) || chr(10))[1] ELSE coalesce(regexp_extract_all(replace(x, ',', ''), '-?\\d*\\.?\\d+')[-1], '') END AS f FROM a),
    j AS (SELECT seq, regexp_replace({_STRIP('f')}, '\\n\\s*', '', 'g') AS j FROM f)
    SELECT seq, {_STRIP("regexp_replace(regexp_replace(regexp_replace(j, '^:', ''), '[.]$', ''), '/$', '')")} AS answer FROM j"""
SQL = {
    "extract_tags": f"{_A} SELECT seq, {_T('think')} AS think, {_T('answer')} AS answer FROM a",
    "extract_after_thinking": f"{_A} SELECT seq, CASE WHEN contains(x, '</think>') THEN regexp_replace(string_split(x, '</think>')[-1], '^\\s+|\\s+$', '', 'g') END AS answer FROM a",
    "validate_structure": f"{_A} SELECT seq, {_FORMED} AS formed, {_CNT('<think>')} = 1 AND {_CNT('</think>')} = 1 AND instr(x, '<think>') <= instr(x, '</think>') AS formed_plain FROM a",
    "loose_format": f"{_A} SELECT seq, regexp_matches(x, '^<think>.*?</think>\\n?<answer>.*?</answer>') AS ok FROM a",
    "judge_eligibility": f"{_A} SELECT seq, CASE WHEN coalesce({_FORMED} AND {_T('answer')} <> '' AND {_T('think')} <> '' AND {_T('think')} <> 'reasoning process here', FALSE) THEN NULL ELSE -2.0 END::DOUBLE AS score FROM a",
    "logic_truth": f"{_KK} SELECT seq, name, arg_max(role, i) AS role FROM r WHERE name <> '' GROUP BY 1, 2",
    "kk_score": f"""{_KK}, g AS (SELECT seq, count(*) AS lines, count(*) FILTER (role = 'knight') AS knights FROM r WHERE name <> '' GROUP BY 1)
        SELECT seq, CASE WHEN seq % 4 = 0 THEN 2.0 WHEN seq % 4 = 1 AND knights > 0 THEN -1.5 WHEN seq % 4 = 1 THEN 2.0 ELSE -2.0 END::DOUBLE AS score, seq % 4 = 0 OR (seq % 4 = 1 AND knights = 0) AS correct FROM g""",
    "sequence_route": _ROUTED,
    "ngram_counts": f"{_A}, w AS (SELECT seq, {_W} AS w FROM a), g AS (SELECT seq, list_transform(range(greatest(len(w) - 2, 0)), lambda i: w[i + 1:i + 3]) AS g FROM w) SELECT seq, CAST(len(g) AS INTEGER) AS n, CAST(len(list_distinct(g)) AS INTEGER) AS n_distinct FROM g",
    "repetition_penalty": f"{_A}, w AS (SELECT seq, {_W} AS w FROM a), g AS (SELECT seq, list_transform(range(greatest(len(w) - 1, 0)), lambda i: w[i + 1:i + 2]) AS g FROM w) SELECT seq, round(greatest(0, least(1, 1 - len(list_distinct(g)) / (len(g) + 1e-5::DOUBLE))) * 0.5, 6) AS penalty FROM g",
    "repetition_dense": f"""{_A}, w AS (SELECT seq, {_W} AS w FROM a), g AS (SELECT seq, len(w) AS n, list_transform(range(greatest(len(w) - 1, 0)), lambda i: w[i + 1:i + 2]) AS g FROM w),
        s AS (SELECT seq, n, list_filter(range(len(g)), lambda i: list_position(g, g[i + 1]) <= i) AS s FROM g)
        SELECT seq, CAST(len(list_distinct(list_concat(s, list_transform(s, lambda i: i + 1)))) AS INTEGER) AS n_repeated, CAST(n AS INTEGER) AS n FROM s""",
    "strip_marks": f"{_A} SELECT seq, regexp_replace(regexp_replace('<pad><pad></s>' || x || '</s></s><pad>', '^(</s>|<pad>)+', ''), '(</s>|<pad>)+$', '') || '</s>' AS text FROM a",
    "finish_text": f"{_A}, t AS (SELECT seq, regexp_replace(coalesce(prompt, '') || x, '\\n+$', '') AS t FROM a) SELECT seq, CASE WHEN ends_with(t, '</s>') THEN t ELSE t || ' </s>' END AS text FROM t",
    "box_prompts_thinking": """
        SELECT seq, CASE WHEN ends_with(input, '<think>') OR ends_with(input, '<think>' || chr(10)) OR ends_with(input, '<think>' || chr(10) || chr(10) || '</think>' || chr(10)) THEN input ELSE input || '<think>' || chr(10) END AS prompt,
            coalesce(task, 'default') AS task FROM box_prompts WHERE input IS NOT NULL
    """,
    "task_scores": """
        WITH t AS (SELECT seq, target, try_cast(replace(trim(target), ',', '') AS DOUBLE) AS v FROM box_prompts WHERE coalesce(task, 'default') = 'default' AND target IS NOT NULL)
        SELECT seq, CASE WHEN seq % 3 = 2 THEN -2.0 WHEN seq % 3 = 0 AND v IS NOT NULL THEN 2.0 WHEN seq % 3 = 1 AND v = 0 THEN 2.0 ELSE -1.5 END::DOUBLE AS score, coalesce(v IS NOT NULL AND (seq % 3 <> 1 OR v = 0), FALSE) AS correct FROM t
    """,
    "boxed_answers": f"{_A} SELECT seq, CASE WHEN contains(x, '\\boxed') THEN regexp_extract(string_split(x, '\\boxed')[-1], '^\\{{([^{{}}]*)\\}}', 1) END AS boxed FROM a WHERE NOT contains(x, '\\boxed') OR regexp_matches(string_split(x, '\\boxed')[-1], '^\\{{[^{{}}]*\\}}') UNION ALL SELECT seq, NULL FROM a WHERE contains(x, '\\boxed') AND NOT regexp_matches(string_split(x, '\\boxed')[-1], '^\\{{[^{{}}]*\\}}')",
    "boxed_match": "WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?s)The final answer is: \\\\boxed\\{(.*?)\\}') THEN regexp_extract(text, '(?s)The final answer is: \\\\boxed\\{(.*?)\\}', 1) ELSE 'none' END AS answer FROM documents WHERE text IS NOT NULL) SELECT doc_id, answer, CASE WHEN answer = '65' THEN 0.5 ELSE -0.5 END::DOUBLE AS score FROM d",
    "extracted_answers": _EXTRACTED,
    "numeric_equal": """
        WITH p AS (SELECT event_id, value AS a, value * (1 + (event_id % 7 - 3) * 0.00005::DOUBLE) AS b FROM events)
        SELECT event_id, abs(a - b) <= 1e-4 * greatest(abs(a), abs(b)) AS near, abs(a - b) <= greatest(1e-9 * greatest(abs(a), abs(b)), 1e-3) AS near_absolute, abs(a - b * 100 / 100) <= 1e-4 * greatest(abs(a), abs(b * 100 / 100)) OR a = 0 AND b = 0 AS matches FROM p
    """,
    "parse_numbers": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round(value * 1000, 1) WHEN event_id % 3 = 1 THEN round(round(value, 2) / 100, 6) END AS number FROM events",
    "canonical_equal": """
        WITH f AS (SELECT event_id, event_id % 9 + 1 AS p, event_id % 5 + 2 AS q, event_id // 7 % 9 + 1 AS r, event_id // 3 % 5 + 2 AS s FROM events)
        SELECT event_id, p = r AND q = s AS same, p * s = r * q AS equal FROM f
    """,
    "judge_verdict": "WITH g AS (SELECT event_id // 3 AS query_idx, count(*) FILTER (value > 30.0 - value) AS n_true, count(*) AS n FROM events GROUP BY 1) SELECT query_idx, n_true, round(CASE WHEN n_true = n THEN 2.0 WHEN n_true = 0 THEN -2.0 ELSE n_true / n::DOUBLE END, 6)::DOUBLE AS score FROM g",
    "scatter_back": "WITH g AS (SELECT event_id // 3 AS q, count(*) FILTER (value > 30.0 - value) AS t, count(*) AS n FROM events GROUP BY 1) SELECT seq, coalesce(round(CASE WHEN t = n THEN 2.0 WHEN t = 0 THEN -2.0 ELSE t / n::DOUBLE END, 6), -2.0)::DOUBLE AS score FROM sft_pairs LEFT JOIN g ON seq = q AND q % 2 = 0",
    "judge_pairs": """
        WITH q AS (SELECT seq, CAST(json_extract(target, '$.scoring_questions') AS VARCHAR[]) AS q FROM box_prompts WHERE task LIKE 'complex%')
        SELECT seq, CAST(k AS INTEGER) AS q_pos, v AS verdict, q[k + 1] AS question FROM q, range(20) r(k), (VALUES ('YES'), ('NO')) t(v) WHERE k < len(q)
    """,
    "repeat_prompt": f"{_A}, s AS (SELECT seq, regexp_replace(lower(x), '^\\s+|\\s+$', '', 'g') AS x, regexp_replace(lower(prompt), '^\\s+|\\s+$', '', 'g') AS p FROM a WHERE prompt IS NOT NULL) SELECT seq, starts_with(x, p) OR starts_with(x, '''' || p) OR starts_with(x, '\"' || p) AS followed FROM s",
    "ifeval_strict": f"""{_A}, c AS (SELECT seq, CASE WHEN regexp_matches(x, '[^\\s\\x{{00a0}}]') THEN (NOT contains(x, ','))::INT + (len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+')) >= 60)::INT + (length(lower(x)) - length(replace(lower(x), 'e', '')) < 60)::INT ELSE 0 END AS n FROM a)
        SELECT seq, n::BIGINT AS n_followed, round(CASE n WHEN 3 THEN 2.0 WHEN 0 THEN -2.0 ELSE n / 3.0::DOUBLE END, 6)::DOUBLE AS score FROM c""",
    "ifeval_loose": f"""{_A}, l AS (SELECT seq, x, string_split(x, chr(10)) AS l FROM a),
        v AS (SELECT seq, [x, array_to_string(l[2:], chr(10)), array_to_string(l[:len(l) - 1], chr(10)), array_to_string(l[2:len(l) - 1], chr(10))] AS v FROM l),
        u AS (SELECT seq, unnest(list_concat(v, list_transform(v, lambda t: replace(t, '*', '')))) AS x FROM v),
        c AS (SELECT seq, max((NOT contains(x, ','))::INT) + max((len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+')) >= 60)::INT) + max((length(lower(x)) - length(replace(lower(x), 'e', '')) < 60)::INT) AS n FROM u WHERE regexp_matches(x, '[^\\s\\x{{00a0}}]') GROUP BY 1)
        SELECT a.seq, coalesce(n, 0)::BIGINT AS n_followed, round(CASE coalesce(n, 0) WHEN 3 THEN 2.0 WHEN 0 THEN -2.0 ELSE n / 3.0::DOUBLE END, 6)::DOUBLE AS score FROM a LEFT JOIN c USING (seq)""",
    "classic_reward": f"{_A} SELECT seq, CASE WHEN length(x) + 16 >= 600 THEN -2.0 WHEN seq % 3 = 0 THEN 1.0 ELSE -0.5 END::DOUBLE AS reward FROM a",
    "cosine_reward": f"""{_A}, w AS (SELECT seq, length(x) AS n, {_W} AS w FROM a), g AS (SELECT seq, n, list_transform(range(greatest(len(w) - 1, 0)), lambda i: w[i + 1:i + 2]) AS g FROM w)
        SELECT seq, round(CASE WHEN n + 16 >= 600 THEN -2.0 WHEN seq % 3 = 0 THEN 0.5 + 0.25 * (1 + cos(n / 600::DOUBLE * pi())) ELSE -0.5 - 0.25 * (1 + cos(n / 600::DOUBLE * pi())) + greatest(0, least(1, 1 - len(list_distinct(g)) / (len(g) + 1e-5::DOUBLE))) * -0.5 END, 6)::DOUBLE AS reward FROM g""",
    "length_scaled_reward": f"{_A}, n AS (SELECT seq, length(x) AS n, length(x) / 600::DOUBLE AS c FROM a) SELECT seq, round(CASE WHEN n + 16 >= 600 THEN -2.0 WHEN seq % 3 = 0 THEN (0.6 + 0.4 * c) * (1 - c) ELSE c - 1 END, 6)::DOUBLE AS reward FROM n",
    "text_language": f"SELECT doc_id, {_LANGUAGE} AS language FROM (SELECT doc_id, text AS x FROM documents WHERE text IS NOT NULL)",
    "choice_said": f"{_A} SELECT seq, coalesce(upper(nullif(regexp_extract(lower(replace(string_split(x, 'Problem:')[1], 'choice is', 'answer is')), 'answer is \\(?([abcde])\\)?', 1), '')), 'placeholder') AS choice FROM a",
    "number_words": "SELECT event_id, CAST(event_id % 100 AS VARCHAR) AS number FROM events",
    "judge_prompts": """
        WITH q AS (SELECT seq, input, CAST(json_extract(target, '$.scoring_questions') AS VARCHAR[]) AS q FROM box_prompts WHERE task LIKE 'complex%' AND input IS NOT NULL)
        SELECT seq, CAST(k AS INTEGER) AS q_pos, 'Judge.' || repeat(chr(10), 3) || 'Input:' || repeat(chr(10), 2) || input || repeat(chr(10), 3) || 'Generated Text:' || repeat(chr(10), 2) || 'Done.' || repeat(chr(10), 3) || 'Question:' || repeat(chr(10), 2) || q[k + 1] AS content
        FROM q, range(20) r(k) WHERE k < len(q)
    """,
    "judge_sums": "WITH g AS (SELECT event_id // 4 AS query_idx, count(*) FILTER (value / 3 + value / 3 + value / 3 > (9 - value / 3) + (9 - value / 3) + (9 - value / 3)) AS n_true, count(*) AS n FROM events GROUP BY 1) SELECT query_idx, n_true, round(CASE WHEN n_true = n THEN 2.0 WHEN n_true = 0 THEN -2.0 ELSE n_true / n::DOUBLE END, 6)::DOUBLE AS score FROM g",
    "judgements": """
        WITH d AS (SELECT doc_id, array_to_string(string_split(text, chr(10))[-2:], chr(10)) || chr(10) || 'JUDGEMENT: ' || ['correct', 'Correct', 'wrong', 'not_found'][doc_id % 4 + 1] AS x FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, CAST(regexp_extract(x, '(?i).*judgement:\\s+(correct|wrong|not_found).*', 1) = 'correct' AS INTEGER) AS score, array_to_string(string_split(x, chr(10))[-2:], chr(10)) AS shown FROM d
    """,
    "rephrase_overlap": """
        WITH t AS (SELECT seq, unnest(regexp_extract_all(lower(chosen), '[\\p{L}\\p{N}_]+')) AS w, 1 AS c, 0 AS j FROM preference_pairs WHERE chosen IS NOT NULL AND rejected IS NOT NULL
                   UNION ALL SELECT seq, unnest(regexp_extract_all(lower(rejected), '[\\p{L}\\p{N}_]+')), 0, 1 FROM preference_pairs WHERE chosen IS NOT NULL AND rejected IS NOT NULL),
        k AS (SELECT seq, w, least(sum(c), sum(j)) AS s FROM t GROUP BY 1, 2), g AS (SELECT seq, sum(s) AS s FROM k GROUP BY 1)
        SELECT p.seq, coalesce(s, 0) BETWEEN 10 AND 60 AS followed FROM preference_pairs p LEFT JOIN g USING (seq) WHERE chosen IS NOT NULL AND rejected IS NOT NULL
    """,
    "bag_overlap": """
        WITH t AS (SELECT seq, unnest(regexp_extract_all(lower(chosen), '[\\p{L}\\p{N}_]+')) AS w, 1 AS c, 0 AS j FROM preference_pairs WHERE chosen IS NOT NULL AND rejected IS NOT NULL
                   UNION ALL SELECT seq, unnest(regexp_extract_all(lower(rejected), '[\\p{L}\\p{N}_]+')), 0, 1 FROM preference_pairs WHERE chosen IS NOT NULL AND rejected IS NOT NULL),
        k AS (SELECT seq, w, sum(c) AS c, sum(j) AS j FROM t GROUP BY 1, 2)
        SELECT seq, sum(least(c, j))::BIGINT AS shared, sum(greatest(c, j))::BIGINT AS "union" FROM k GROUP BY 1
    """,
}
SQL |= {f"check_{name}": f"{_A} SELECT seq, ({sql}) AS followed FROM a" for name, (_, sql) in _CHECKS.items() if sql}
