"""Queries on row shaping, source blending and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollmill.functions.text import n_words
from rollmill.operators import shape
from rollmill.plans.tables import table
from rollmill.sources.blend import blend
from rollmill.streaming import state


def sft_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sft_pairs").select("seq", "prompt", "response")
    out = shape.sft_rows(rows, "prompt", "response", n_words(F.col("prompt")), 42, "Human: {}\nAssistant: ")
    return out.select("seq", "prompt_ids_len", "prompt", "response")


def pretrain_rows(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.col("text").alias("response"), F.lit(None).cast("string").alias("prompt"))
    return shape.sft_rows(rows, "prompt", "response", F.lit(0), 0, pretrain=True).select("doc_id", "prompt_ids_len", "response")


def chat_messages(spark, folder):
    rows = table(spark, folder, "sft_pairs").where(F.col("prompt").isNotNull() & F.col("response").isNotNull())
    m = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")))
    full, head = shape.render_chat(m), shape.render_chat(F.slice(m, 1, 1), True)
    return rows.select("seq", head.alias("prompt"), F.substring(full, F.length(head) + 1, F.length(full)).alias("response"))


def multiturn_ranges(spark, folder):
    """Word ranges of assistant turns of rendered conversations; role marks count as a word each."""
    rows = table(spark, folder, "sft_pairs").where(F.col("prompt").startswith("User: "))
    turns = shape.split_turns(rows, "seq", "prompt")
    return shape.turn_ranges(turns, "seq", "turn", "role", 1 + F.size(F.filter(F.split("content", r"\s+"), lambda w: w != "")))


def preference_rows(spark, folder):
    rows = table(spark, folder, "preference_pairs").drop("added_at")
    out = shape.preference_rows(rows, "prompt", "chosen", "rejected", "margin", n_words(F.coalesce("prompt", F.lit(""))), 40, True)
    return out.select("seq", "margin", "prompt_ids_len", "prompt", "chosen", "rejected")


def unpaired_rows(spark, folder):
    rows = table(spark, folder, "sft_pairs").where(F.col("prompt").isNotNull()).select("seq", "prompt", "response")
    return shape.unpaired_rows(rows, "prompt", "response", F.col("seq") % 2, n_words(F.col("prompt")), 40).select("seq", "label", "prompt_ids_len", "prompt", "response")


def prompt_rows(spark, folder):
    rows = table(spark, folder, "box_prompts").where(F.col("input").isNotNull()).select("seq", "input", "target")
    return shape.prompt_rows(rows, "input", "target", "Q: {}").select("seq", "prompt", "label")


def user_contents(spark, folder):
    return table(spark, folder, "box_prompts").where(F.col("input").isNotNull()).select("seq", shape.user_text(F.col("input")).alias("text"))


def few_shot_prompts(spark, folder):
    examples = F.array(*[F.struct(F.lit(f"What is {i} + {i}?").alias("question"), F.lit(str(2 * i)).alias("answer")) for i in range(1, 4)])
    return table(spark, folder, "eval_items").select("item_id", shape.few_shot(examples, F.col("text"), 2).alias("prompt"))


def concat_sides(spark, folder):
    rows = shape.both_sides(table(spark, folder, "preference_pairs"), ["seq"])
    return rows.groupBy("side").agg(F.count("text").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def conflict_table(spark, folder):
    """Event types that follow one another in a user's events stand for conflicting instructions here."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    pairs = table(spark, folder, "events").select(before.alias("a"), F.col("event_type").alias("b")).where(F.col("a").isNotNull()).distinct()
    return shape.symmetric_conflicts(pairs)


def zip_join(spark, folder):
    """Answers matched to prompts by position."""
    from rollmill.operators.order import positions

    left = positions(table(spark, folder, "sft_pairs").select("seq", "prompt_len"), "seq")
    right = positions(table(spark, folder, "box_prompts").select(F.col("seq").alias("box_seq")), "box_seq")
    return left.join(right, "pos").select("pos", "seq", "box_seq", "prompt_len")


def _sources(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "source")
    return [d.where(F.col("source") == s).select("doc_id") for s in ("helpdesk_mix", "forge_maths_a", "rubric_bank_a")]


def blend_sources(spark, folder):
    return blend(_sources(spark, folder), [0.5, 0.3, 0.2], "doc_id").select("source_no", "turn", "doc_id", F.round("rank", 6).alias("rank"))


def blend_all(spark, folder):
    return blend(_sources(spark, folder), [0.2, 0.3, 0.5], "doc_id", "all_exhausted").select("source_no", "turn", "doc_id", F.round("rank", 6).alias("rank"))


def kl_controller(spark, folder):
    rows = table(spark, folder, "events").select((F.col("event_id") % 20).alias("run"), "value")
    out = state.adaptive_coefficient(rows, "value", F.lit(8), 0.02, 20.0, 10000.0, "run")
    return out.select("run", F.round("coefficient", 8).alias("coefficient"), "n_updates")


def fifo_buffer(spark, folder):
    return state.bounded_buffer(table(spark, folder, "events").select("event_id", "value"), "event_id", 64)


def cyclic_iteration(spark, folder):
    rows = table(spark, folder, "eval_items").select("item_id")
    return state.cyclic(rows, "item_id", 240, 1000).select("step", "item_id")


QUERIES = {
    f.__name__: f
    for f in (
        sft_rows, pretrain_rows, chat_messages, multiturn_ranges, preference_rows, unpaired_rows, prompt_rows, user_contents, few_shot_prompts, concat_sides, conflict_table, zip_join, blend_sources, blend_all,
        kl_controller, fifo_buffer, cyclic_iteration,
    )
}

_NW = lambda c: f"len(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+'))"
_BLEND = lambda w, stop: f"""
    WITH w(source, no, p) AS (VALUES ('helpdesk_mix', 0, {w[0]}::DOUBLE), ('forge_maths_a', 1, {w[1]}::DOUBLE), ('rubric_bank_a', 2, {w[2]}::DOUBLE)),
    r AS (SELECT no, p, doc_id, row_number() OVER (PARTITION BY no ORDER BY doc_id) - 1 AS turn, count(*) OVER (PARTITION BY no) AS n FROM documents JOIN w USING (source)),
    u AS (SELECT {stop}(n / p) AS until FROM (SELECT DISTINCT no, n, p FROM r)),
    x AS (SELECT no, p, doc_id, turn, k * n + turn AS i, until FROM r, u, range(100) t(k) WHERE k = 0 OR '{stop}' = 'max')
    SELECT CAST(no AS INTEGER) AS source_no, turn, doc_id, round((i + 0.5) / p, 6) AS rank FROM x WHERE i + 0.5 < until * p
"""  # noqa: E731
SQL = {
    "sft_rows": f"SELECT seq, CAST({_NW('prompt')} AS INTEGER) AS prompt_ids_len, 'Human: ' || prompt || chr(10) || 'Assistant: ' AS prompt, response FROM sft_pairs WHERE prompt <> '' AND response <> '' AND {_NW('prompt')} < 40",
    "pretrain_rows": "SELECT doc_id, 0 AS prompt_ids_len, text AS response FROM documents WHERE text <> ''",
    "chat_messages": "SELECT seq, '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt, response || '<|im_end|>' || chr(10) AS response FROM sft_pairs WHERE prompt IS NOT NULL AND response IS NOT NULL",
    "multiturn_ranges": """
        WITH p AS (SELECT seq, regexp_replace(chr(10) || prompt, '\\n(User|Assistant): ?', chr(1) || '\\1' || chr(2), 'g') AS m FROM sft_pairs WHERE prompt LIKE 'User: %'),
        t AS (SELECT seq, unnest(list_filter(string_split(m, chr(1)), lambda q: contains(q, chr(2)))) AS part, unnest(range(len(list_filter(string_split(m, chr(1)), lambda q: contains(q, chr(2)))))) AS turn FROM p),
        c AS (SELECT seq, turn, lower(string_split(part, chr(2))[1]) AS role, 1 + len(list_filter(regexp_split_to_array(string_split(part, chr(2))[2], '\\s+'), lambda w: w <> '')) AS n FROM t),
        s AS (SELECT seq, turn, role, n, coalesce(sum(n) OVER (PARTITION BY seq ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_pos FROM c)
        SELECT seq, CAST(turn AS INTEGER) AS turn, CAST(start_pos AS INTEGER) AS start_pos, CAST(start_pos + n - 1 AS INTEGER) AS end_pos FROM s WHERE role = 'assistant'
    """,
    "preference_rows": f"SELECT seq, coalesce(margin, 0) AS margin, CAST({_NW('coalesce(prompt, chr(32))')} AS INTEGER) AS prompt_ids_len, coalesce(prompt, '') AS prompt, chosen, rejected FROM preference_pairs WHERE {_NW('coalesce(prompt, chr(32))')} < 38",
    "unpaired_rows": f"SELECT seq, CAST(seq % 2 AS INTEGER) AS label, CAST({_NW('prompt')} AS INTEGER) AS prompt_ids_len, prompt, response FROM sft_pairs WHERE prompt IS NOT NULL AND {_NW('prompt')} < 38",
    "prompt_rows": "SELECT seq, 'Q: ' || input AS prompt, coalesce(target, '') AS label FROM box_prompts WHERE input IS NOT NULL",
    "user_contents": """
        WITH u AS (SELECT seq, CASE WHEN contains(input, '<|im_start|>user' || chr(10)) THEN string_split(string_split(input, '<|im_start|>user' || chr(10))[-1], '<|im_end|>')[1]
            WHEN contains(input, '<｜User｜>') THEN string_split(string_split(input, '<｜User｜>')[-1], '<｜Assistant｜>')[1] WHEN contains(input, 'user<|end_header_id|>') THEN string_split(string_split(input, 'user<|end_header_id|>')[-1], '<|eot_id|>')[1]
            WHEN contains(input, '[INST]') THEN string_split(string_split(input, '[INST]')[-1], '[/INST]')[1] WHEN contains(input, 'User:') THEN string_split(string_split(input, 'User:')[-1], 'Assistant:')[1] ELSE input END AS t FROM box_prompts WHERE input IS NOT NULL)
        SELECT seq, regexp_replace(t, '^[\\s\\x{00a0}\\x{3000}]+|[\\s\\x{00a0}\\x{3000}]+$', '', 'g') AS text FROM u
    """,
    "few_shot_prompts": "SELECT item_id, 'Question: What is 1 + 1?' || chr(10) || 'Answer: 2' || chr(10) || chr(10) || 'Question: What is 2 + 2?' || chr(10) || 'Answer: 4' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:' AS prompt FROM eval_items",
    "concat_sides": "SELECT side, count(t) AS n, sum(length(t))::BIGINT AS n_chars FROM (SELECT 0 AS side, chosen AS t FROM preference_pairs UNION ALL SELECT 1, rejected FROM preference_pairs) GROUP BY 1",
    "conflict_table": "WITH p AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS a, event_type AS b FROM events), q AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) SELECT DISTINCT a, b FROM q WHERE a <> b",
    "zip_join": "WITH a AS (SELECT seq, prompt_len, row_number() OVER (ORDER BY seq) - 1 AS pos FROM sft_pairs), b AS (SELECT seq AS box_seq, row_number() OVER (ORDER BY seq) - 1 AS pos FROM box_prompts) SELECT pos, seq, box_seq, prompt_len FROM a JOIN b USING (pos)",
    "blend_sources": _BLEND((0.5, 0.3, 0.2), "min"),
    "blend_all": _BLEND((0.2, 0.3, 0.5), "max"),
    "kl_controller": "SELECT event_id % 20 AS run, round(0.02 * product(1 + least(greatest(value / 20.0 - 1, -0.2), 0.2) * 8 / 10000.0), 8) AS coefficient, count(*) AS n_updates FROM events GROUP BY 1",
    "fifo_buffer": "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 64",
    "cyclic_iteration": "SELECT t.step, t.step % 240 AS item_id FROM range(1000) t(step)",
}
