"""DataFrame operators on small tables: ties, nulls, empty tables, clashing column names."""

import pytest
from pyspark.sql import functions as F

from rollmill.operators import groups, order, postprocess, shape
from rollmill.sources import io
from rollmill.sources.blend import blend
from rollmill.streaming import state

SAMPLES = "seq bigint, input string, output string, reward double"


def samples(spark, rows):
    return spark.createDataFrame(rows, SAMPLES)


ROWS = [(1, "a", "x", 1.0), (2, "a", "y", 3.0), (3, "a", "z", 3.0), (4, "b", "u", float("nan")), (5, "b", "v", -1.0), (6, "c", "w", None), (7, None, "n", 0.0)]


def test_best_of_n_takes_the_first_of_ties_and_no_nan(spark):
    for n in (1, 7):
        got = postprocess.best_of_n(samples(spark, ROWS).repartition(n)).select("input", "seq").collect()
        assert {tuple(r) for r in got} == {("a", 2), ("b", 5), (None, 7)}
    assert postprocess.best_of_n(samples(spark, [])).count() == 0


def test_chosen_rejected(spark):
    got = {r.prompt: (r.chosen, r.rejected) for r in postprocess.chosen_rejected(samples(spark, ROWS)).collect()}
    assert got == {"a": ("y", "x"), "b": ("v", "v"), None: ("n", "n")}


def test_normalised_reward(spark):
    out = postprocess.normalised_reward(samples(spark, [(1, "a", "x", 1.0), (2, "a", "x", 3.0), (3, "a", "x", float("inf"))])).orderBy("seq").collect()
    assert [r.reward for r in out] == pytest.approx([-0.70710678, 0.70710678, None])
    assert postprocess.normalised_reward(samples(spark, [(1, "a", "x", 1.0)])).first().reward is None
    assert postprocess.normalised_reward(samples(spark, [])).count() == 0


def test_processors(spark):
    assert postprocess.processor("rs")(samples(spark, ROWS)).count() == 3
    with pytest.raises(ValueError):
        postprocess.processor("none")
    with pytest.raises(ValueError):
        postprocess.reward_conditioned(samples(spark, ROWS), "{input}")


def test_positions_are_dense(spark):
    rows = spark.range(0, 1000, 3).select((F.col("id") * 7 % 1009).alias("k")).repartition(7)
    out = order.positions(rows, "k").orderBy("k").collect()
    assert [r.pos for r in out] == list(range(len(out)))
    assert order.positions(rows.limit(0), "k").count() == 0


def test_slices_and_batches(spark):
    rows = spark.range(50).withColumnRenamed("id", "k")
    assert order.iteration_slice(rows, 1, 20, "k").agg(F.min("k"), F.max("k")).first()[:] == (20, 39)
    assert order.eval_split(rows, "k", share=0.1).count() == 5
    assert order.shuffled_batches(rows, "k", 1, 8).groupBy("batch").count().where("count = 8").count() == 6
    assert order.prefix(rows, -1, "k").count() == 0
    assert order.expand(rows, 0).count() == 0


def test_shards_cover_all_rows(spark):
    rows = spark.range(10).withColumnRenamed("id", "pos")
    padded = order.shard(rows, "pos", 4, 10)
    assert {r["count"] for r in padded.groupBy("rank").count().collect()} == {3}
    assert order.shard(rows, "pos", 4, 10, pad=False).count() == 8


def test_group_estimators(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 6.0), (1, 5.0), (1, 5.0), (2, 1.0)], "g int, r double")
    out = rows.select("g", groups.leave_one_out("r", "g").alias("l"), groups.group_normalised("r", "g").alias("n"))
    sums = {r.g: (r.l, r.n) for r in out.groupBy("g").agg(F.sum("l").alias("l"), F.sum("n").alias("n")).collect()}
    assert sums[0] == pytest.approx((0, 0)) and sums[1] == (0, 0) and sums[2] == (None, None)


def test_superior_filter(spark):
    rows = [("p<think>\n", 1.0, True), ("p<think>", 2.0, True), ("p<think>\n\n</think>\n", 3.0, True), ("q<think>\n", 1.0, True), ("q<think>\n", 1.0, True), ("q<think>\n\n</think>\n", 3.0, True), ("r<think>\n\n</think>\n", 0.0, True)]
    out = groups.superior_filter(spark.createDataFrame(rows, "prompt string, reward double, superior boolean")).orderBy("prompt", "reward").collect()
    kept = {}
    for r in out:
        kept.setdefault(r.prompt[0], []).append(r.kept)
    assert sorted(kept["p"]) == [False] * 3 and sorted(kept["q"]) == [False, True, True] and kept["r"] == [True]


def test_shaping(spark):
    rows = spark.createDataFrame([(1, "q", "r"), (2, "", "r"), (3, "q", ""), (4, None, "r"), (5, "long", "r")], "i int, p string, r string")
    kept = shape.sft_rows(rows, "p", "r", F.length("p"), 6, "<{}>").collect()
    assert [(r.i, r.p) for r in kept] == [(1, "<q>")]
    turns = spark.createDataFrame([(1, 0, "user", 3), (1, 1, "assistant", 2), (1, 2, "user", 1), (1, 3, "assistant", 4)], "c int, t int, role string, n int")
    assert [tuple(r)[2:] for r in shape.turn_ranges(turns, "c", "t", "role", F.col("n")).orderBy("t").collect()] == [(3, 4), (6, 9)]
    assert shape.lower_columns(rows.toDF("I", "P", "R")).columns == ["i", "p", "r"]
    assert shape.symmetric_conflicts(spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "x")], "a string, b string")).count() == 2


def test_blend_keeps_proportions(spark):
    a, b = spark.range(100).withColumnRenamed("id", "k"), spark.range(1000, 1010).withColumnRenamed("id", "k")
    first = {r.source_no: r["count"] for r in blend([a, b], [0.5, 0.5], "k").groupBy("source_no").count().collect()}
    assert first == {0: 10, 1: 10}
    every = {r.source_no: r["count"] for r in blend([a, b], [0.5, 0.5], "k", "all_exhausted").groupBy("source_no").count().collect()}
    assert every == {0: 100, 1: 100}
    with pytest.raises(ValueError):
        blend([a], [0.5, 0.5], "k")


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é"), (2, None)], "i bigint, t string")
    io.write_jsonl(rows, f"{tmp_path}/out.jsonl", ["i"], single=True)
    assert io.read_source(spark, f"{tmp_path}/out.jsonl", "i bigint, t string").orderBy("i").collect()[0].t == "é"
    rows.write.parquet(f"{tmp_path}/d/part")
    assert io.read_source(spark, f"{tmp_path}/d@part").count() == 2
    with pytest.raises(ValueError):
        io.read_source(spark, "x.py")
    io.append_metrics(rows.agg(F.count("*").alias("n")), f"{tmp_path}/m", "eval", 3)
    assert tuple(spark.read.parquet(f"{tmp_path}/m").first()) == ("eval/n", 3, 2.0)
    assert [r.score for r in io.score_rows(rows, lambda pdf: pdf["i"] * 2).orderBy("i").collect()] == [2.0, 4.0]


def test_coefficient_doesnt_depend_on_order(spark):
    values = [5.0, 30.0, 18.0, 26.0]
    expected = 0.02
    for v in values:
        expected *= 1 + min(max(v / 20 - 1, -0.2), 0.2) * 8 / 100
    for rows in (values, values[::-1]):
        got = state.adaptive_coefficient(spark.createDataFrame([(v,) for v in rows], "v double"), "v", F.lit(8), 0.02, 20.0, 100.0).first()
        assert got.coefficient == pytest.approx(expected)
    assert state.bounded_buffer(spark.range(10), "id", 3).agg(F.min("id")).first()[0] == 7
    assert state.bounded_buffer(spark.range(10), "id", 0).count() == 10


def test_streams_match_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, float(10 + i), 8) for i in range(20)], "i bigint, k bigint, v double, n int")
    rows.repartition(2).write.parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s")
    batch = {r.k: r.coefficient for r in state.adaptive_coefficient(rows, "v", F.col("n"), 0.02, 20.0, 100.0, "k").collect()}
    q = state.stream_coefficient(stream, "k", "v", "n", 0.02, 20.0, 100.0).writeStream.outputMode("update").format("memory").queryName("coefficients").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    seen = {}
    for r in spark.sql("select * from coefficients").collect():
        seen.setdefault(r.k, []).append(r.coefficient)
    assert all(any(v == pytest.approx(batch[k]) for v in vs) for k, vs in seen.items()) and len(seen) == 2
