"""Text queries over whole answers, against brute force on hand-made tables."""

import re

from rollmill.plans import texts

STOP = ("</s>", "<|im_end|>", "<|endoftext|>", "<｜end▁of▁sentence｜>", "<|eot_id|>")
HEADS = (
    ("<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\n", "<|im_end|>"), ("<｜begin▁of▁sentence｜><｜User｜>Hi<｜Assistant｜>", "<｜end▁of▁sentence｜>"),
    ("<|start_header_id|>user<|end_header_id|>Hi<|start_header_id|>assistant<|end_header_id|>", "<|eot_id|>"), ("[INST] Hi [/INST]", "</s>"), ("User: Hi\nAssistant:", "</s>"), ("Hi ", "</s>"),
)
SIGNS = (
    ("qwen", ("<|im_start|>assistant\n<think>",)), ("deepseek", ("<｜begin▁of▁sentence｜>", "<｜User｜>", "<｜Assistant｜><think>")),
    ("llama3", ("<|start_header_id|>", "<|end_header_id|>", "assistant<|end_header_id|><think>")), ("mistral", ("[INST]", "[/INST]<think>")), ("base", ("Assistant:<think>",)),
)


def answers(spark, tmp_path, values):
    """A folder whose sft_pairs hold the values, at seq 0, 1, ..."""
    spark.createDataFrame([(i, "Hi", v) for i, v in enumerate(values)], "seq bigint, prompt string, response string").write.parquet(str(tmp_path / "sft_pairs.parquet"))
    return str(tmp_path)


def routed(seq, response):
    head, end = HEADS[seq % 6]
    x = f"{head}<think>because</think><answer>{response}</answer>{end}rest"
    for name, signs in SIGNS:
        if all(s in x for s in signs):
            out = x[x.rfind(signs[-1]) + len(signs[-1]) - len("<think>") :]
            for word in STOP:
                if word in out:
                    out = out.split(word)[0].strip()
            return name, out
    return None, None


def test_sequences_are_routed_whole(spark, tmp_path):
    kinds = ["a plain answer that is longer than forty characters, " * 3, "short", "<b>tag</b> [1]", "ends </s> early", "one <|im_end|> two <|eot_id|> three", "User: Hi\nAssistant:<think>x</think>", "[INST] q [/INST]<think>y", "<|im_start|>assistant\n<think>z</think> w ", ""]
    kinds += ["a <|endoftext|> b", "<｜begin▁of▁sentence｜><｜User｜>q<｜Assistant｜><think>v", "<|start_header_id|>assistant<|end_header_id|><think>u", "the Assistant: said"]
    values = [k for k in kinds for _ in range(6)] + [None]
    got = {r.seq: (r.template, r.output) for r in texts.sequence_route(spark, answers(spark, tmp_path, values)).collect()}
    assert got == {i: routed(i, v) for i, v in enumerate(values) if v is not None}
    assert {t for t, _ in got.values()} == {"qwen", "deepseek", "llama3", "mistral", "base", None}


def extracted(x):
    if m := re.search(r"(?s)final answer is \$(.*?)\$\. I hope", x):
        out = m[1]
    elif "boxed" in x:
        tail, out, depth = x.split("boxed")[-1], "", 0
        if tail.startswith("{"):
            for c in tail:
                depth += (c == "{") - (c == "}")
                if depth == 0:
                    break
                out += c
            out = out[1:]
        else:
            out = tail.split("$")[0]
    elif "he answer is" in x:
        out = x.split("he answer is")[-1]
    elif "final answer is" in x:
        out = x.split("final answer is")[-1]
    elif "答案是" in x:
        out = x.split("答案是")[1].strip().split("\n\n")[0]
    else:
        out = (re.findall(r"-?\d*\.?\d+", x.replace(",", "")) or [""])[-1]
    return re.sub(r"[./]$", "", re.sub(r"^[:\s]+", "", re.sub(r"\n\s*", "", out.strip()))).strip()


def test_every_response_has_an_extracted_answer(spark, tmp_path):
    values = ["The answer is 7.", "So the final answer is:\n 12\n  apples.", "<answer>30</answer>", "Answer: 1,234 of 5", "my answer", "no number", "I count -3.5 of 4", "", None, "答案是 8.\n\n答案是 9."]
    values += ["the final answer is $5$. I hope so", "The answer is 3, no: \\boxed{4}", "so \\boxed{\\frac{1}{\\sqrt{2}}} it is", "so \\boxed{5", "boxed 6$ here", "answer is 2 and the answer is 3 and more\nlines", "ends in boxed"]
    got = {r.seq: r.answer for r in texts.extracted_answers(spark, answers(spark, tmp_path, values)).collect()}
    assert got == {i: extracted(v) for i, v in enumerate(values) if v is not None}
    assert [got[i] for i in (0, 1, 2, 9, 12)] == ["7", "12apples", "30", "8", "\\frac{1}{\\sqrt{2}}"]


def stripped(response):
    run = "(</s>|<pad>)+"
    return re.sub(run + "$", "", re.sub("^" + run, "", f"<pad><pad></s>{response}</s></s><pad>")) + "</s>"


def test_marks_inside_of_responses(spark, tmp_path):
    values = ["plain", "", "</s>", "<pad></s><pad>", "</s>starts", "ends<pad>", "in</s>side", "<pad> blank </s> ", "a\n</s>\n", "</s", None]
    got = {r.seq: r.text for r in texts.strip_marks(spark, answers(spark, tmp_path, values)).collect()}
    assert got == {i: stripped(v) for i, v in enumerate(values) if v is not None}
