"""Hand-derived rows for Column functions."""

import math

import pytest
from pyspark.sql import functions as F

from rollmill.functions import answers as N
from rollmill.functions import arrays as A
from rollmill.functions import checkers as C
from rollmill.functions import losses as L
from rollmill.functions import rewards as R
from rollmill.functions import text as X


def one(spark, column, **values):
    """The column over a row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()] or [F.lit(0).alias("_")])
    return row.select(column.alias("r")).first().r


def texts(spark, build, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.r for r in rows.select("i", build(F.col("x")).alias("r")).orderBy("i").collect()]


def array(*values):
    return F.array(*[F.lit(v) for v in values])


def test_position_ids(spark):
    assert one(spark, A.position_ids(array(1, 1, 1, 2, 2, 2, 3, 3, 0))) == [0, 1, 2, 0, 1, 2, 0, 1, 0]
    assert one(spark, A.position_ids_of_range(array(3, 2, 4, 1), F.lit(2), F.lit(8))) == [2, 0, 1, 0, 1, 2]


def test_pack_and_unpack(spark):
    parts = F.array(array(1, 2), array(3), array(4, 5, 6))
    assert one(spark, A.pack(parts)) == [1, 2, 3, 4, 5, 6]
    assert one(spark, A.segments(parts)) == [1, 1, 2, 3, 3, 3]
    assert one(spark, A.unpack(A.pack(parts), array(2, 1, 3))) == [[1, 2], [3], [4, 5, 6]]
    assert one(spark, A.multiple(array(1, 2, 3, 4), 4, 0)) == [1, 2, 3, 4]
    assert one(spark, A.multiple(array(1, 2, 3), 4, 0)) == [1, 2, 3, 0]


def test_padding(spark):
    assert one(spark, A.pad(array(1, 2), F.lit(4), 0, "left")) == [0, 0, 1, 2]
    assert one(spark, A.pad(array(1, 2), F.lit(1), 0, "right")) == [1, 2]
    assert one(spark, A.unpad(array(0, 1, 2, 0), F.lit(1), F.lit(1))) == [1, 2]


def test_masked_statistics(spark):
    assert one(spark, A.masked_mean(array(1.0, 3.0, 9.0), array(1, 1, 0))) == 2.0
    assert one(spark, A.masked_mean(array(1.0), array(0))) is None
    out = one(spark, A.masked_normalise(array(1.0, 3.0, 9.0), array(1, 1, 0)))
    assert out == pytest.approx([-1, 1, -2])


def test_returns_and_gae(spark):
    assert one(spark, A.discounted_returns(array(1.0, 2.0, 4.0), None, 0.5)) == [3.0, 4.0, 4.0]
    assert one(spark, A.gae(array(0.0, 0.0, 0.0), array(1.0, 2.0, 4.0), None, 1.0, 1.0)) == [7.0, 6.0, 4.0]
    assert one(spark, A.gae(array(1.0, 2.0), array(1.0, 1.0), None, 1.0, 0.5)) == pytest.approx([1.5, -1.0])


def test_token_rewards(spark):
    assert one(spark, A.token_rewards(F.lit(20.0), 0.5, array(2.0, 2.0, 2.0), array(1, 1, 0), -5.0, 5.0)) == [-1.0, 4.0, -1.0]
    assert one(spark, A.token_rewards(F.lit(1.0), -1.0, array(2.0), array(1))) == [1.0]
    kl = array(1.0, 1.0, 1.0)
    assert one(spark, A.step_rewards(F.lit(3.0), 0.5, kl, array(-1, 0), array(4.0, 0.5), -1.0, 1.0)) == [-0.25, -0.5, 0.0]
    assert one(spark, A.step_rewards(F.lit(3.0), 0.5, kl, array(7), array(4.0), -1.0, 1.0)) == [0.0, 0.0, 1.0]


def test_kl_is_never_negative_in_its_third_form(spark):
    out = one(spark, A.approx_kl(array(-1.0, 0.0, 2.0), array(0.0, 0.0, 0.0), None, True))
    assert all(v >= 0 for v in out) and out[1] == 0
    assert one(spark, A.approx_kl(array(-1.0, 2.0), array(0.0, 0.0), array(1, 0))) == [-1.0, 0.0]


def test_sequence_masks(spark):
    tokens = array(0, 0, 5, 6, 7, 2, 0)
    assert one(spark, A.attention_mask(tokens, F.lit(3), 2, 0)) == [0, 0, 1, 1, 1, 1, 0]
    assert one(spark, A.action_mask(tokens, F.lit(3), 2, 0)) == [1, 1, 1, 0]
    assert one(spark, A.mask_labels(array(1, 2, 3), F.lit(2))) == [-100, -100, 3]
    assert one(spark, A.placeholder_labels(array(7, 1, 7, 7), 7, array(0.5, 1.0))) == [0.5, -100, 1.0, -100]


def test_log_probabilities_are_stable(spark):
    assert one(spark, A.label_log_prob(array(1000.0, 1000.0), F.lit(0))) == pytest.approx(-math.log(2))
    assert one(spark, L.softplus(F.lit(800.0))) == 800.0
    assert one(spark, L.pairwise(F.lit(1.0), F.lit(1.0))) == pytest.approx(math.log(2))
    assert one(spark, L.dpo(F.lit(-1.0), F.lit(-2.0), F.lit(-1.0), F.lit(-2.0), 0.1)) == pytest.approx(math.log(2))
    assert one(spark, L.policy_token(array(0.0), array(-1.0), array(2.0), 0.2)) == pytest.approx([-2.4])
    assert one(spark, L.policy_token(array(0.0), array(-1.0), array(2.0), 0.2, F.lit(False))) == pytest.approx([-2.0])


def test_tags(spark):
    ok = "<think>a</think>\n<answer> b </answer>"
    assert texts(spark, X.answer_of, [ok, "<answer>x</answer><answer>y</answer>", "no", None, ""]) == ["b", "y", None, None, None]
    assert texts(spark, X.well_formed, [ok, ok + "<answer>", "<answer>b</answer><think>a</think>", ""]) == [True, False, False, False]
    assert texts(spark, lambda x: X.answer_of(x, "deepseek"), ["<think>a</think> b ", "b"]) == ["b", None]
    assert texts(spark, X.loose_format, [ok, "<think>a\n</think><answer>b</answer>", " " + ok]) == [True, False, False]


def test_sequence_parts(spark):
    x = "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<think>a</think>b<|im_end|>rest"
    assert texts(spark, X.template_of, [x, "Assistant:<think>", "none"]) == ["qwen", "base", None]
    assert texts(spark, X.model_output, [x, "none"]) == ["<think>a</think>b", None]
    assert texts(spark, X.with_thinking, ["q", "q<think>", "q<think>\n"]) == ["q<think>\n", "q<think>", "q<think>\n"]
    assert texts(spark, lambda t: X.strip_marks(t, "</s>", "<p>"), ["<p><p>a</s></s>", "a"]) == ["a</s>", "a</s>"]


def test_logic_answers(spark):
    roles = X.knights(F.lit("(1) Ann is a knight\n(2) Bob is a knave\n(3) Ann is a knave"))
    assert one(spark, roles) == {"Bob": "knave", "Ann": "knave"}
    read = lambda t: X.knight_answers(t, X.knights(F.lit("Ann is a knight\nBob is a knave")))
    assert texts(spark, read, ["Ann is a KNIGHT, bob is  a knave", "Ann is a knave. Bob is a knave.", "Ann is a knight", "Ann is a knight. Bob is a knave. Not a knave."]) == [True, False, None, None]


def test_repetition(spark):
    p = lambda t: X.repetition_penalty(X.words(t), 2, -1.0)
    out = texts(spark, p, ["a b a b a b", "a b c", "", "a"])
    assert out[0] == pytest.approx(-0.6, abs=1e-4) and out[1] == pytest.approx(0, abs=1e-4) and out[2:] == [-1.0, -1.0] or out[2] <= 0
    d = lambda t: R.repetition_dense(X.words(t), 2, -1.0)
    assert texts(spark, d, ["a b a b", ""]) == [[0.0, 0.0, -1.0, -1.0], []]


def test_checkers(spark):
    check = lambda build, values: texts(spark, build, values)
    assert check(lambda x: C.paragraphs(x, 2), ["a *** b", "a\n***\n\n***\nb", "*** a *** b ***", "a"]) == [True, False, True, False]
    assert check(lambda x: C.bullets(x, 2), ["* a\n* b", "- a\n* b", "** a\n* b", "a"]) == [True, True, False, False]
    assert check(lambda x: C.two_responses(x), ["a****** b", "a******a", "a", "a******b******c"]) == [True, False, False, False]
    assert check(lambda x: C.highlights(x, 1), ["*a*", "* *", "**b**", "a"]) == [True, False, True, False]
    assert check(lambda x: C.title(x), ["<<t>>", "<< >>", "<t>"]) == [True, False, False]
    assert check(lambda x: C.in_quotes(x), [' "a" ', '"', "a"]) == [True, False, False]
    assert check(lambda x: C.ends_with(x, " The End "), ['... the end"', "the end."]) == [True, False]
    assert check(lambda x: C.postscript(x, "P.S."), ["a\nP. S. b", "ps"]) == [True, False]
    assert check(lambda x: C.keyword_frequency(x, "a.c", "at least", 2), ["A.C a.c", "abc a.c"]) == [True, False]
    assert check(lambda x: C.no_forbidden_words(x, array("cat", "Ärger")), ["concat", "a CAT.", "kein ärger!"]) == [True, False, False]
    assert check(lambda x: C.nth_paragraph_first_word(x, 2, "so", 2), ["a\n\n'So, b", "a\n\nb", "a"]) == [True, False, False]
    assert check(lambda x: C.json_valid(x), ['```json\n{"a": 1}\n```', "{} x", "[NaN]", "NaN", '{"a":1,"a":2}', "", None]) == [True, False, True, False, True, False, None]  # the fence characters N are stripped
    assert check(lambda x: C.xml_valid(x), ["<a><b/></a>", "x <a> y </a>", "<a>", ""]) == [True, True, False, False]
    assert check(lambda x: C.capital_words(x, "at least", 2), ["AB CD-E x", "Ab CD"]) == [True, False]
    assert check(lambda x: C.sentences(x, "at least", 2), ["One. Two", "One", "A 3.5 b."]) == [True, False, False]
    assert check(lambda x: C.word_count(x, "between", 2), ["a b"]) == [None]
    assert check(lambda x: C.all_lower(x), ["a1", "A", "1"]) == [True, False, False]


def test_registry_gives_null_for_unknown_ids(spark):
    args = F.create_map(F.lit("x"), F.lit("y"))
    assert one(spark, C.check(F.lit("a, b"), F.lit("punctuation:no_comma"), args)) is False
    assert one(spark, C.check(F.lit("a"), F.lit("nothing:such"), args)) is None
    assert one(spark, C.check(F.lit("a"), F.lit("keywords:existence"), args)) is None


def test_strict_implies_loose(spark):
    rows = spark.createDataFrame([("a\n*b, c*\nd",), ("a, b",), ("x",)], "x string")
    out = rows.select(C.no_comma(F.col("x")).alias("strict"), F.exists(C.loose_variants(F.col("x")), C.no_comma).alias("loose")).collect()
    assert all(r.loose or not r.strict for r in out)


def test_answers(spark):
    assert texts(spark, N.last_boxed, ["\\boxed{1} \\boxed{a{b}c}", "\\boxed{open", "none", None]) == ["\\boxed{a{b}c}", None, None, None]
    assert texts(spark, N.extract_answer, ["so \\boxed{5}.", "The answer is 7.", "I count 1,234 of them", "", "答案是 8."]) == ["5", "7", "1234", "", "8"]
    assert texts(spark, N.number, ["1,234.5", "50%", "x", None]) == [1234.5, 0.5, None, None]
    assert texts(spark, N.choice, ["(B)", "it is x."]) == ["B", "it is x"]


@pytest.mark.parametrize(
    "a, b, same",
    [("0.5", "\\frac{1}{2}", True), ("50\\%", "0.5", True), ("(1, 2)", "(1,2)", True), ("(1,2)", "(2,1)", False), ("x=3", "3", True), ("1/2", "\\dfrac12", True), ("33.3", "\\frac{100}{3}", False), ("a", "b", False), (None, None, True), ("1", None, False)],
)
def test_maths_equality(a, b, same):
    assert N.maths_equal_text(a, b) is same


def test_rewards(spark):
    r = lambda n, ok: one(spark, R.cosine(F.lit(n), F.lit(ok), 100, (0.5, 1.0), (-1.0, -0.5), -9.0))
    assert r(0, True) == 1.0 and r(0, False) == -1.0 and r(90, True) == -9.0
    assert one(spark, R.length_scaled(F.lit(50), F.lit(True), 100, 0.5)) == pytest.approx(0.375)
    assert one(spark, R.classic(F.lit(90), F.lit(True), 100)) == 1.0
