"""Chat roles, steps, task scores, checkers, benchmark records, token batches, state and stretches of rows, on hand-made rows."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from rollmill.functions import arrays as A
from rollmill.functions import chat, flat, rewards, scoring, sentences, steps
from rollmill.functions import checkers as C
from rollmill.functions import languages as G
from rollmill.operators import benchmarks, groups, order, shape, tokenise
from rollmill.plans import store
from rollmill.sources import io
from rollmill.streaming import state


def column(spark, build, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.r for r in rows.select("i", build(F.col("x")).alias("r")).orderBy("i").collect()]


QWEN = "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user\none<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\ntwo\nlines<|im_end|>\n<|im_start|>assistant\n"


def test_requests_of_five_encodings(spark):
    values = [
        QWEN, "<｜begin▁of▁sentence｜>Be kind.<｜User｜>one<｜Assistant｜>yes<｜User｜>two<｜Assistant｜>", "<|begin_of_text|><|start_header_id|>system<|end_header_id|>Be kind.<|eot_id|><|start_header_id|>user<|end_header_id|>one<|eot_id|>",
        "[INST] hello [/INST]", "System: Be kind. User: one\nAssistant: yes User: two\nAssistant:", "plain text", None, "<|im_start|>user\nonly<|im_end|>\n", "User: open",
    ]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    got = [tuple(r) for r in rows.orderBy("i").select(chat.encoding_of(F.col("x")), chat.request_of(F.col("x"), chat.encoding_of(F.col("x")))).collect()]
    assert got[:5] == [("qwen", "Be kind.\n\ntwo\nlines"), ("deepseek", "Be kind.\n\ntwo"), ("llama3", "Be kind.\n\none"), ("mistral", "hello"), ("base", "Be kind. \n\ntwo")]
    assert got[5] == (None, None) and got[6] == (None, None) and got[7] == ("qwen", "only") and got[8][0] == "base"


def test_preambles_go(spark):
    end = "between one <answer> tag and one </answer> tag."
    assert column(spark, chat.without_preamble, [f"Think first {end} Be brief.", f"x Here is the task definition:\n\n{end}y", "as it is"]) == [" Be brief.", "y", "as it is"]


def test_judge_prompts_and_verdicts(spark):
    content = column(spark, lambda x: chat.judge_content("G", F.lit("I"), F.lit("T"), x), ["Q"])[0]
    assert content == "G\n\n\nInput:\n\nI\n\n\nGenerated Text:\n\nT\n\n\nQuestion:\n\nQ"
    asked, yes, no = column(spark, chat.judge_messages, ["c"])[0]
    assert [m.role for m in asked] == ["system", "user"] and yes[2].content == "YES(是)" and no[2].content == "NO(否)"
    assert column(spark, chat.judgement, ["Judgement: correct", "judgement:  Correct", "JUDGEMENT: correct and Judgement: wrong", "no", None]) == [1, 0, 0, 0, None]
    assert column(spark, chat.last_lines, ["\n".join(map(str, range(30))), "one", ""])[0].split("\n") == [str(i) for i in range(10, 30)]


def test_judgement_of_long_and_odd_lines(spark):
    say = "Judgement: "
    texts = [
        f"{say}wrong\r{say}correct", f"{say}correct {say}wrong", f"{say}correct\n{say}wrong", f"{say}none\n{say}wrong {say}\n\n correct", f"{say}Correct", "judgement:correct", f"\n{say}", "", "\n\n",
        f"{say}correct\u2028{say}wrong", f"{say}correct\u0085{say}wrong", f"x\r\nx {say}correct\r\n", f"{say * 3}\ncorrect {say}",
    ]
    found = [re.search(r".*Judgement:\s+(correct|wrong|not_found).*", x, re.IGNORECASE) for x in texts]
    assert column(spark, chat.judgement, texts) == [int(m is not None and m.group(1) == "correct") for m in found]
    began = time.monotonic()
    assert column(spark, chat.judgement, ["judge " * 60_000, "judge " * 60_000 + f"\n{say}correct", f"{say}x " * 20_000 + f"{say}correct"]) == [0, 1, 1]
    assert time.monotonic() - began < 10  # minutes, were the lines tried from every character


def test_steps(spark):
    text = "# Question\n\nq\n\n# Solution\n\na\n\nb\n\n# Answer\n\n5"
    assert column(spark, steps.numbered_steps, [text]) == [f"q Step 1: a {steps.STEP_MARK}\nb The answer is: 5 {steps.STEP_MARK}\n"]
    x = f"Q ASSISTANT:\nwork{steps.STEP_MARK}The final answer is: \\boxed{{5}}<|end_of_text|>"
    assert column(spark, lambda c: steps.answered(c, steps.boxed_answer(c)), [x]) == [f"Q ASSISTANT:\nwork\n\n# Answer\n\n5{steps.STEP_MARK}"]
    closing = "so **Final Answer** \\[ \\boxed{0.5} \\]"
    rows = spark.createDataFrame([(0, x), (1, closing), (2, "none")], "i int, x string")
    got = [tuple(r) for r in rows.orderBy("i").select(*steps.boxed_scores(F.col("x"), F.lit("5")).values()).collect()]
    assert got == [(1.0, 0.5, -1.0, -1.0), (-1.0, -0.5, -1.0, -0.5), (-1.0, -0.5, -1.0, -1.0)]
    half = rows.where("i = 1").select(steps.boxed_scores(F.col("x"), F.lit("\\frac12"))["v4"].alias("v")).first().v
    assert half == 1.0
    assert column(spark, lambda c: steps.default_steps(c, F.array(F.lit(0.2))), [x, "none"]) == [[0.2], [-0.5]]
    one = spark.range(1).select(steps.with_bonus(F.array(F.lit(0.1), F.lit(-0.2), F.lit(0.3)), F.lit(0.5)).alias("b")).first().b
    assert one.steps == pytest.approx([0.1, 0.8]) and one.sample == pytest.approx(0.3)


def sequence(answer, think="because", head="<|im_start|>assistant\n"):
    return f"{head}<think>{think}</think>\n<answer>{answer}</answer><|im_end|>"


def test_scores_of_all_tasks(spark):
    roles = json.dumps({"solution_text_format": "(1) Ann is a knight\n(2) Bob is a knave"})
    obey = json.dumps({"instruction_id_list": ["punctuation:no_comma", "length_constraints:number_words", "detectable_format:json_format"], "kwargs": [{}, {"relation": "less than", "num_words": 5}, {}], "follow_score_reference": 2})
    cases = [
        (None, sequence("so \\boxed{5}"), "5", 2.0, 1.0), ("default", sequence("so \\boxed{6}"), "5", -1.5, 0.0), ("default", sequence("5"), "5", -2.0, 1.0), ("default", "no head", "5", -2.0, 0.0),
        ("kk", sequence("Ann is a knight, Bob is a knave"), roles, 2.0, 1.0), ("kk", sequence("Ann is a knave, Bob is a knave"), roles, -1.5, 0.0), ("kk", sequence("who knows"), roles, -2.0, 0.0), ("kk", sequence("Ann is a knight, Bob is a knave", ""), roles, -2.0, 0.0),
        ("ifeval", sequence("7"), obey, 2.0, 1.0), ("ifeval", sequence("one, two"), obey, 1 / 3, 1 / 3), ("ifeval", sequence("a, b c d e f g"), obey, -2.0, 0.0), ("ifeval", sequence("7", "reasoning process here"), obey, -2.0, 0.0),
        ("complex", sequence("done"), "{}", None, 0.0), ("complex", sequence(""), "{}", -2.0, 0.0), ("ifeval", sequence("7"), "broken", -2.0, 0.0), ("default", None, "5", -2.0, 0.0), ("kk", sequence("x"), None, -2.0, 0.0),
    ]
    rows = spark.createDataFrame([(i, t, s, g) for i, (t, s, g, _, _) in enumerate(cases)], "i int, task string, sequence string, target string").repartition(2)
    out = {r.i: r for r in scoring.task_scores(rows, "sequence", "target", "task").collect()}
    for i, (task, _, _, score, correct) in enumerate(cases):
        assert out[i].answer_score == pytest.approx(score) and out[i].answer_correct == pytest.approx(correct), (i, task, out[i])
    assert out[0].format_score == 1.0 and out[3].format_score == -1.0 and out[12].pending and not out[13].pending
    assert out[8].superior and not out[9].superior and out[11].superior
    loose = spark.createDataFrame([(0, "kkwoFormat", "<|im_start|>assistant\n<think>Ann is a knight, Bob is a knave", roles)], "i int, task string, sequence string, target string")
    r = scoring.task_scores(loose, "sequence", "target", "task").first()
    assert r.answer_score == 2.0 and r.format_score == 1.0
    with pytest.raises(Exception, match="unknown task"):
        scoring.task_scores(rows.limit(1).withColumn("task", F.lit("chess")).withColumn("sequence", F.lit(sequence("x"))), "sequence", "target", "task").collect()
    assert scoring.task_scores(rows.limit(0), "sequence", "target", "task").count() == 0


def test_sentences():
    text = 'Mr. Smith went to Washington. He lives 3.5 km from example.com today! "Really?" she said... Yes. The U.S.A. is big. Acme Inc. He works. J. Doe has a Ph.D. in maths. end'
    assert sentences.split_sentences(text) == ["Mr. Smith went to Washington.", "He lives 3.5 km from example.com today!", '"Really?"', "she said...", "Yes.", "The U.S.A. is big.", "Acme Inc.", "He works.", "J. Doe has a Ph.D. in maths.", "end"]
    assert sentences.split_sentences("") == [] and sentences.split_sentences("?!") == ["?", "!"]


def test_more_checkers(spark):
    assert column(spark, lambda x: C.response_language(x, "de"), ["Das ist nicht der Hund und die Katze.", "This is the cat and the dog.", "42", None]) == [True, False, True, None]
    assert column(spark, C.all_capitals, ["THE CAT AND THE DOG", "DER HUND UND DIE KATZE IST NICHT DA", "ABC", "abc"]) == [True, False, True, False]
    assert column(spark, lambda x: C.rephrased(x, "a *b* c"), ["a *x y* c", "a *x* d", "none"]) == [True, False, None]
    assert column(spark, lambda x: C.shared_words(x, "a b b c"), ["b b b a", "x", ""]) == [3, 0, 0]
    assert column(spark, lambda x: C.key_sentences(sentences.sentences_of(x), F.array(F.lit("One."), F.lit("Two.")), 1), ["One. Three.", "One. Two.", "none"]) == [True, False, False]
    assert column(spark, C.xml_valid, ["<a>1</a>", '<!DOCTYPE x [<!ENTITY y "z">]><a>&y;</a>', "plain"]) == [True, False, False]
    with pytest.raises(ValueError):
        C.register("punctuation:no_comma", lambda x, k: x)
    pairs = set(C.conflicts())
    assert all((b, a) in pairs for a, b in pairs) and ("startend:quotation", "detectable_format:title") in pairs and ("keywords:existence", "detectable_format:json_format") not in pairs
    ids, args = F.array(F.lit("punctuation:no_comma"), F.lit("unknown")), F.array(F.create_map(F.lit("a"), F.lit("b")), F.create_map(F.lit("a"), F.lit("b")))
    assert column(spark, lambda x: C.followed(x, ids, args, ("punctuation:no_comma",)), ["ab", "a,b", " "]) == [[True, False], [False, False], [False, False]]
    assert column(spark, lambda x: C.followed_loosely(x, ids, args, ("punctuation:no_comma",)), ["a,\nb", "a,b", ""]) == [[True, False], [False, False], [False, False]]


def test_languages(spark):
    texts = ["The cat is on the mat and it sleeps.", "Le chat est sur le tapis et il dort.", "El gato está en la mesa y no duerme.", "il gatto è sul tavolo e non dorme", "これはペンです。", "这是一支笔。", "Это ручка.", "", "123", None]
    assert column(spark, G.language, texts) == ["en", "fr", "es", "it", "ja", "zh", "ru", None, None, None]
    asked = ["zh-cn", "uk", "pl", "fi", "en"]
    given = ["这是一支笔。", "Это ручка.", "The cat is on the mat.", "Это ручка.", "Это ручка."]
    rows = spark.createDataFrame(list(enumerate(zip(asked, given))), "i int, p struct<code:string,x:string>")
    got = [tuple(r) for r in rows.orderBy("i").select(G.is_language(F.col("p.x"), F.col("p.code")), G.name_of(F.col("p.code"))).collect()]
    assert got == [(True, "Chinese"), (True, "Ukrainian"), (True, "Polish"), (False, "Finnish"), (False, "English")]


def test_flat_passes_against_plain_loops(spark):
    rng = random.Random(5)
    values = [[rng.randint(0, 4) for _ in range(rng.randrange(0, 30))] for _ in range(60)] + [[], None]
    got = column(spark, lambda x: flat.scan_back(x.cast("array<double>"), 0.5), values, "array<int>")
    for v, g in zip(values, got):
        run, want = 0.0, []
        for x in reversed(v or []):
            run = x + 0.5 * run
            want.append(run)
        assert g == (None if v is None else pytest.approx(want[::-1]))
    got = column(spark, A.position_ids, values, "array<int>")
    assert got == [None if v is None else [0 if s == 0 else i - v.index(s) for i, s in enumerate(v)] for v in values]
    got = column(spark, lambda x: A.placeholder_labels(x, 3, F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.5))), values, "array<int>")
    for v, g in zip(values, got):
        labels, want = [1.0, -100.0, 0.5], []
        for x in v or []:
            want.append(labels.pop(0) if x == 3 and labels else -100.0)
        assert g == (None if v is None else want)
    for only in (False, True):
        got = column(spark, lambda x: rewards.repetition_dense(x.cast("array<string>"), 2, -1.0, only), values, "array<int>")
        for v, g in zip(values, got):
            if v is None:
                assert g is None
                continue
            grams = [tuple(v[i : i + 2]) for i in range(len(v) - 1)]
            again = [i for i, x in enumerate(grams) if x in grams[:i]]
            again = [s for k, s in enumerate(again) if not only or k == 0 or s > again[k - 1] + 2]
            assert g == [-1.0 if any(s <= i < s + 2 for s in again) else 0.0 for i in range(len(v))]
    assert column(spark, lambda x: flat.scan_back(x, 1.0), [[1.0, None, 2.0]], "array<double>") == [[None, None, 2.0]]


def test_reward_addresses():
    assert rewards.selected("math_rule")[0] == "classic" and rewards.selected("math_rule_cosine_scale")[0] == "cosine" and rewards.selected("http://x") is None
    with pytest.raises(ValueError):
        rewards.selected("math_rule_other")


def test_combined_and_shaped_rewards(spark):
    rows = spark.createDataFrame([(1.0, 3.0, "a", "a"), (None, 2.0, "a", "b")], "x double, y double, p string, r string")
    got = [tuple(r) for r in rows.select(rewards.combined([F.col("x"), F.col("y")], [1.0, 0.5]), rewards.combined([F.col("x"), F.col("y")], rule=lambda p: F.greatest(*p))).collect()]
    assert got == [(2.5, 3.0), (None, 2.0)]
    same = lambda p, r: (p == r).cast("double")
    got = [r[0] for r in rows.select(rewards.shaped("classic", same, F.col("p"), F.col("r"), F.lit(10), 100, right=1.0, wrong=-1.0)).collect()]
    assert got == [1.0, -1.0]
    with pytest.raises(ValueError):
        rewards.combined([], None)


def test_benchmark_records(spark):
    rows = spark.createDataFrame([("work #### 1,000", "x"), (None, "y")], "answer string, gt string").drop("gt")
    assert [tuple(r) for r in benchmarks.with_truth(rows, "gsm8k").select("gt_cot", "gt").collect()] == [("work", "1,000"), (None, None)]
    rows = spark.createDataFrame([("so \\boxed{\\dfrac12}",)], "solution string")
    assert benchmarks.with_truth(rows, "math").first().gt == "\\frac{1}{2}"
    rows = spark.createDataFrame([("q ", ["a", "b ", "c", "d"], 2)], "question string, choices array<string>, answer int")
    assert benchmarks.with_truth(rows, "mmlu_stem").first().gt == "C" and benchmarks.with_question(rows, "mmlu_stem").first().built_question == "q\nAnswer Choices: (A) a (B) b (C) c (D) d"
    rows = spark.createDataFrame([("q", "A) 1 B) 2 C) 3 D) 4", "A")], "question string, options string, Answer string")
    assert benchmarks.with_question(rows, "sat_math").first().built_question == "q\nAnswer Choices: (A) 1 (B) 2 (C) 3 (D) 4"
    rows = spark.createDataFrame([("q", ["A)1", "B)2"], "A")], "question string, options array<string>, correct string")
    assert benchmarks.with_question(rows, "aqua").first().built_question == "q\nAnswer Choices: (A) 1 (B) 2"
    rows = spark.createDataFrame([("t", "a|b", "q?", None, "1/4", "decimal_number", "s"), (None, "a|b", "q?", "x, y", "yes", "text", "s")], "table_title string, table string, question string, choices string, answer string, ans_type string, solution string")
    got = [(r.built_question, g.gt) for r, g in zip(benchmarks.with_question(rows, "tabmwp").collect(), benchmarks.with_truth(rows, "tabmwp").collect())]
    assert got[0] == ('Read the following table regarding "t" and answer a question:\na|b\nq?', "0.25")
    assert got[1] == ("Read the following table and answer a question:\na|b\nq? Please select from the following options: x, y (Yes or No)", "yes")
    assert benchmarks.with_truth(spark.createDataFrame([(["$5$"],)], "final_answer array<string>"), "olympiadbench").first().gt == "5"
    with pytest.raises(ValueError):
        benchmarks.with_truth(rows, "unknown")


def test_few_shot(spark):
    examples = spark.createDataFrame([("gsm8k", k, f"q{k}", f"a{k}") for k in range(4)] + [("math", 0, "m", "n")], "data_set string, place int, question string, answer string")
    rows = spark.createDataFrame([(1, "Q", "A"), (2, None, "7")], "i int, question string, gt string")
    prompt = lambda *a, **k: {r.i: r.prompt for r in benchmarks.few_shot_prompts(rows, examples, *a, **k).collect()}
    assert prompt("svamp", "cot", 2)[1] == "Question: q0\nAnswer: a0\n\n\nQuestion: q1\nAnswer: a1\n\n\nQuestion: Q\nAnswer:"
    assert prompt("gsm8k", "direct", 0)[1] == "Question: Q\nAnswer:" and prompt("gsm8k", "cot", 2)[2] is None
    assert prompt("gsm8k", "qwen25-math-cot", 1)[1].startswith("<|im_start|>system\nPlease reason") and "q0\na0\n\nQ<|im_end|>" in prompt("gsm8k", "qwen25-math-cot", 1)[1]
    assert prompt("gsm8k", "platypus_fs", 1)[1].startswith("Below is an instruction") and len(benchmarks.TEMPLATES) == 24
    with pytest.raises(ValueError):
        prompt("gsm8k", "none", 1)
    assert [tuple(r) for r in benchmarks.sample_of(rows, "i", 2).collect()] == [(0, "i", "2"), (2, "gt", "7")]


def test_tokenising(spark):
    rows = spark.createDataFrame([(1, "héllo", 9, 0), (2, "", 9, 0), (3, None, 9, 1)], "i int, text string, ids int, b int")
    got = {r.i: r for r in tokenise.tokenise(rows, "text", tokenise.byte_tokens, 3).collect()}
    assert got[1].ids == [104, 195, 169] and got[1].n_ids == 6 and got[2].ids == [] and got[3].ids is None and got[3].n_ids is None
    assert tokenise.tokenise(rows.where("i = 1"), "text", tokenise.byte_tokens, 2, side="left").first().ids == [108, 111]
    got = {r.i: r for r in tokenise.judge_inputs(rows.where("i < 3").drop("ids"), "text", tokenise.byte_tokens, 4, 0, batch="b").collect()}
    assert got[1].ids == [104, 195, 169, 108] and got[2].ids == [0, 0, 0, 0] and got[2].mask == [0, 0, 0, 0]
    assert tokenise.tokenise(rows.limit(0), "text").count() == 0
    assert spark.range(1).select(tokenise.pad_id(None, 2).alias("p")).first().p == 2


def test_batches(spark):
    rows = spark.createDataFrame([(2, 0, [1, 2], [5]), (1, 0, [1], [6, 9]), (3, 1, [4], [7])], "i int, b int, p array<int>, o array<int>")
    held = {r.b: r for r in tokenise.collate(rows, "b", "i", ["i", "p"]).collect()}
    assert held[0].i == [1, 2] and held[0].p == [[1], [1, 2]] and held[0].n_rows == 2
    assert tokenise.uncollate(tokenise.collate(rows, "b", "i", ["i"]), "b", ["i"]).count() == 3
    wide = {r.i: r for r in tokenise.rectangle(rows, "b", "p", "o", 9, 0).collect()}
    assert wide[1].sequence == [0, 1, 6, 9] and wide[2].sequence == [1, 2, 5, 9] and wide[1].attention == [0, 1, 1, 1] and wide[3].n_actions == 2
    packed = {r.b: r for r in tokenise.packed_rows(rows, "b", "i", "p", "o", 9).collect()}
    assert packed[0].sequence == [1, 6, 9, 1, 2, 5, 9] and packed[0].segments == [1, 1, 1, 2, 2, 2, 2] and packed[0].lengths == [3, 4] and packed[0].n_actions == [2, 2]
    assert column(spark, lambda x: tokenise.last_is(x, 9), [[1, 2], []], "array<int>") == [[1, 9], []]


def test_stretches_of_rows(spark):
    rows = spark.range(5000).select((F.col("id") * 37 % 5003).alias("k"), F.lit("x").alias("_pos2")).repartition(3)
    keys = sorted(r.k for r in rows.collect())
    for start, stop in ((0, 10), (100, 250), (4990, 6000), (7000, 8000), (5, 5), (0, 5000)):
        assert sorted(r.k for r in order.between(rows, start, stop, "k").collect()) == keys[start:stop]
    named = rows.select(F.format_string("%06d", "k").alias("s"))
    assert sorted(r.s for r in order.between(named, 10, 20, "s").collect()) == [f"{k:06d}" for k in keys[10:20]]
    some = rows.select(F.when(F.col("k") >= 40, F.col("k")).alias("k"))
    assert [r.k for r in order.between(some, 0, 3, "k").collect()] == [None] * 3
    assert order.between(rows.limit(0), 0, 5, "k").count() == 0 and order.eval_split(rows, "k").count() == 150
    order_top = order.TOP_K
    order.TOP_K = 10
    try:
        assert sorted(r.k for r in order.prefix(rows, 50, "k").collect()) == keys[:50]
    finally:
        order.TOP_K = order_top
    assert order.split_or_whole({"all": rows}, "train", 3, "k").count() == 3
    with pytest.raises(ValueError):
        order.split_or_whole({"a": rows, "b": rows}, "train", None)


def test_group_size_must_divide(spark):
    rows = spark.range(8).withColumnRenamed("id", "pos")
    assert rows.select(groups.group_of(F.col("pos"), 4, 8).alias("g")).distinct().count() == 2
    with pytest.raises(Exception, match="not divisible"):
        rows.select(groups.group_of(F.col("pos"), 3, 8)).collect()


def test_hot_and_null_prompts_in_the_contrast_filter(spark):
    bare = groups.NO_REASONING
    rows = [(f"hot<think>\n" if i % 4 else f"hot{bare}", float(i % 4), True) for i in range(400)] + [(None, 1.0, True), ("one<think>", None, True)]
    out = groups.superior_filter(spark.createDataFrame(rows, "prompt string, reward double, superior boolean"))
    assert out.columns == ["prompt", "reward", "superior", "kept"] and out.count() == 402
    assert out.where(f"prompt like 'hot%' and kept").count() == 300 and out.where("prompt is null and kept").count() == 1


def test_paired_rows(spark):
    message = "array<struct<role:string,content:string>>"
    talk = lambda a: [("user", "hi"), ("assistant", a)]
    rows = spark.createDataFrame([(talk("yes"), talk("no"), None, 7)], f"c {message}, j {message}, margin double, prompt int")
    r = shape.paired_rows(rows, "c", "j", margin="margin", messages=True, dpo=True).first()
    assert r.prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n" and r.chosen == "yes<|im_end|>\n" and r.rejected == "no<|im_end|>\n" and r.margin == 0.0
    assert shape.paired_rows(rows, "c", "j", messages=True).first().chosen.startswith("<|im_start|>user\nhi")
    keyed = spark.createDataFrame([([("user", "hi")], [("assistant", "yes")], [("assistant", "no")])], f"p {message}, c {message}, j {message}")
    assert shape.paired_rows(keyed, "c", "j", "p", messages=True, eos="</s>").first().chosen == "yes<|im_end|> </s>"
    plain = spark.createDataFrame([("q", "a", "b")], "p string, c string, j string")
    assert tuple(shape.paired_rows(plain, "c", "j", "p", template="Q: {}").first()) == ("Q: q", "a", "b", 0.0)


def test_state(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", 5, 3.0)], "name string, step int, value double")
    got = {r.name: r.average for r in state.moving_average(rows, "name", "step", "value", 0.5).collect()}
    assert got == {"a": pytest.approx(2.75), "b": 3.0}
    factors = spark.createDataFrame([(0.0,), (0.0,)], "v double")
    out = state.adaptive_coefficient(factors, "v", F.lit(100), 0.2, 1.0, 10.0).first()
    assert out.coefficient == pytest.approx(0.2) and out.n_updates == 2  # two factors of -1
    assert state.adaptive_coefficient(factors.limit(1), "v", F.lit(100), 0.2, 1.0, 10.0).first().coefficient == pytest.approx(-0.2)
    place = spark.range(5).withColumnRenamed("id", "pos")
    got = {r.pos: (r.epoch, r.order) for r in state.resume_from(place, "pos", 12, 5).collect()}
    assert got == {0: (3, 3), 1: (3, 4), 2: (2, 0), 3: (2, 1), 4: (2, 2)}
    asked = spark.createDataFrame([(0,), (1,), (2,), (2,)], "actor int")
    assert {(r.engine, r.ready) for r in state.coalesced_requests(asked, "actor", 4, 2).collect()} == {(0, True), (1, False)}
    with pytest.raises(Exception):
        spark.range(4).select(F.raise_error(F.lit("x"))).collect()


def test_rollout_loop_resumes(spark, tmp_path):
    source, folder, seen = str(tmp_path / "in"), str(tmp_path / "offsets"), []
    spark.createDataFrame([(i, float(i)) for i in range(6)], "seq bigint, reward double").coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema("seq bigint, reward double").parquet(source)
        query = state.rollout_loop(stream, folder, lambda d: d.withColumn("score", F.col("reward") * 2), lambda d, n: seen.append((n, sorted((r.seq, r.score) for r in d.collect()))), 4, "seq")
        query.processAllAvailable()
        query.stop()

    run()
    spark.createDataFrame([(10, 1.0)], "seq bigint, reward double").coalesce(1).write.mode("append").parquet(source)
    run()
    assert seen == [(0, [(2, 4.0), (3, 6.0), (4, 8.0), (5, 10.0)]), (1, [(10, 2.0)])]


def test_registered_sources(spark):
    class Letters(DataSource):
        @classmethod
        def name(cls):
            return "letters"

        def schema(self):
            return "letter string"

        def reader(self, schema):
            class Reader(DataSourceReader):
                def read(self, partition):
                    yield from (("a",), ("b",))

            return Reader()

    io.register_source(spark, "own.py", Letters)
    assert sorted(r.letter for r in io.read_source(spark, "own.py").collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        io.read_source(spark, "other.py")


def test_written_tables_can_be_cleared(spark):
    rows = store.written(spark.range(3), "probe")
    assert rows.count() == 3 and store.clear(spark) >= 1
    with pytest.raises(Exception):
        rows.count()


def test_skipping_consumed_rows(spark):
    placed = spark.range(10).withColumnRenamed("id", "pos")
    assert sorted((r.rank, r.turn) for r in order.shard(placed, "pos", 2, 10, False, consumed=5).collect()) == [(k, t) for k in (0, 1) for t in (2, 3, 4)]
