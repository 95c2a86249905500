"""Containers hold what they must; mixes reach their shares."""

import random

import numpy as np
import pytest

from rollmill.llm import mixing, packing, tokens


def test_local_search_keeps_items_and_never_adds_containers():
    rng = random.Random(1)
    for capacity, low, high in ((100, 1, 100), (100, 30, 50), (64, 1, 8)):
        sizes = np.array([rng.randint(low, high) for _ in range(400)])
        first = packing.next_fit(sizes, capacity)
        last = packing.local_search([list(c) for c in first], sizes, capacity)
        for packed in (first, last):
            assert sorted(i for c in packed for i in c) == list(range(400))
            assert max(sizes[c].sum() for c in packed) <= capacity
        assert -(-sizes.sum() // capacity) <= len(last) <= len(first)
    assert packing.local_search([], np.zeros(0, int), 5) == []


def test_local_search_empties_a_container_by_exchange():
    sizes = np.array([6, 5, 5, 4, 4, 3, 3])
    start = [[0, 5], [1, 4], [2, 3], [6]]  # fills 9, 9, 9, 3 of 10
    assert len(packing.local_search([list(c) for c in start], sizes, 10)) == 3


def test_local_search_fills_nearly_to_the_bound():
    rng = np.random.default_rng(2)
    for capacity, sizes in ((1000, rng.integers(20, 500, 3000)), (1000, rng.integers(1, 60, 3000)), (300, rng.integers(90, 160, 3000))):
        first = packing.next_fit(sizes, capacity)
        last = packing.local_search(first, sizes, capacity)
        best = -(-sizes.sum() // capacity)
        assert sorted(i for c in last for i in c) == list(range(3000)) and max(sizes[c].sum() for c in last) <= capacity
        assert len(last) - best <= (0.3 if capacity == 300 else 0.01) * best and len(last) < len(first)


def test_fill_reports_the_search(spark, tmp_path):
    from rollmill.llm import queries

    spark.createDataFrame([(i, "word " * (1 + i * 7 % 90)) for i in range(400)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", 100), ("b", 200)], "kind string, capacity int").write.parquet(str(tmp_path / "containers.parquet"))
    rows = queries.QUERIES["p5_fill"](spark, str(tmp_path)).collect()
    assert {r.kind for r in rows} == {"a", "b"}
    assert all(r.n_least <= r.n_containers < r.n_first and r.fullest <= r.capacity for r in rows)


def test_equal_ids_go_to_several_shards_and_bad_kinds_are_refused(spark):
    rows = spark.createDataFrame([(7, 3)] * 500, "id bigint, size int").repartition(4)
    out = packing.pack(rows, "id", "size", spark.createDataFrame([("a", 10)], "kind string, capacity int"), shard_items=50).toPandas()
    assert len(out) == 500 and out.groupby("container").n_tokens.sum().max() <= 10 and (out.container // 2**32).nunique() > 3
    with pytest.raises(ValueError):
        packing.pack(rows, "id", "size", spark.createDataFrame([("a", 10), ("a", 20)], "kind string, capacity int"))


def test_pack(spark):
    rows = spark.createDataFrame([(i, 1 + i % 37, 5) for i in range(300)] + [(900, 250, 5), (901, 0, 5), (902, None, 5), (903, 100, 5)], "id bigint, size int, container int")
    kinds = spark.createDataFrame([("a", 100), ("b", 64), ("none", None)], "kind string, capacity int")
    out = packing.pack(rows, "id", "size", kinds, shard_items=100).toPandas()
    for kind, capacity in (("a", 100), ("b", 64)):
        own = out[out.kind == kind]
        assert own.groupby("container").n_tokens.sum().max() <= capacity
        assert own.n_tokens.sum() == sum(1 + i % 37 for i in range(300)) + 350
        split = own.groupby("id").piece.count()
        assert set(split[split > 1].index) == ({900} if capacity == 100 else {900, 903})
    assert set(out.kind) == {"a", "b"} and not set(out.id) & {901, 902}
    assert packing.pack(rows.limit(0), "id", "size", kinds).count() == 0


def test_temperature():
    w, a = mixing.temperature_weights([900, 90, 10], exponent=1)
    assert w == pytest.approx([0.9, 0.09, 0.01])
    w, a = mixing.temperature_weights([900, 90, 10, 0], target_entropy=1.0)
    assert mixing.entropy(w) == pytest.approx(1.0) and 0 < a < 1 and w[3] == 0
    assert mixing.temperature_weights([5, 5], target_entropy=9.0)[0] == pytest.approx([0.5, 0.5])
    w, a, budget = mixing.tempered_targets([100, 1000], [0.5, 0.5], [2, 2])
    assert w == pytest.approx([0.5, 0.5]) and a == 0 and budget == 400
    w, a, budget = mixing.tempered_targets([100, 1000], [0.5, 0.5], [2, 2], 800)
    assert w[0] * 800 <= 200 + 1e-6 and 0 < a < 1
    w, a, budget = mixing.tempered_targets([100, 1000], [0.5, 0.5], [2, 2], 1e9)
    assert a == 1 and budget == pytest.approx(2200)
    w, a, budget = mixing.tempered_targets([100, 1000], [0.5, 0.5], [2, 2], tolerance=0.02)
    assert 0 < a < 1 and w == pytest.approx([0.49, 0.51]) and budget == pytest.approx(200 / 0.49)
    assert mixing.tempered_targets([0, 0], [0.5, 0.5], [1, 1])[2] == 0


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    rng = random.Random(4)
    rows = [(i, "big" if i % 3 else "small" if i % 5 else "tiny", rng.randint(1, 60), "x") for i in range(1500)] + [(9000, None, 5, "x"), (9001, "big", 0, "x"), (None, "big", 5, "x")]
    sizes = spark.createDataFrame(rows, "id bigint, source string, n_tokens int, mix string").drop("mix")
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.3, 3), ("m", "tiny", 0.2, 4), ("k", "small", 0.5, 2), ("k", "gone", 0.5, 2)], "mix string, source string, target_share double, max_repeats int")
    uses, shares = mixing.mix_sources(sizes, "id", targets)
    got = {(r.mix, r.source): r for r in shares.collect()}
    for s, t in (("big", 0.5), ("small", 0.3), ("tiny", 0.2)):
        assert got["m", s].actual_share == pytest.approx(t, abs=0.005)
    assert got["k", "gone"].n_tokens == 0 and got["k", "small"].actual_share == 1.0
    times = uses.groupBy("mix", "source", "id").count().collect()
    limit = {("m", "big"): 1, ("m", "small"): 3, ("m", "tiny"): 4, ("k", "small"): 2}
    assert all(r["count"] <= limit[r.mix, r.source] for r in times)
    assert uses.groupBy("mix", "id", "pass_no").count().where("count > 1").count() == 0
    uses, shares = mixing.mix_sources(sizes.limit(0), "id", targets)
    assert uses.count() == 0 and {r.n_tokens for r in shares.collect()} == {0}


def test_registered_mix_with_a_bisected_exponent(spark, tmp_path):
    from rollmill.llm import queries

    docs = [(0, "small", "word " * 50)] + [(i, "big" if i % 3 else "middle", "word " * 40) for i in range(1, 900)]
    spark.createDataFrame(docs, "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("m", "small", 0.1, 4), ("m", "middle", 0.4, 2), ("m", "big", 0.5, 1)], "mix string, source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    exact = {r.source: r for r in queries.QUERIES["p6_shares"](spark, str(tmp_path)).collect()}
    assert all(r.actual_share == pytest.approx(r.target_share, rel=0.03) for r in exact.values())
    got = {r.source: r for r in queries.QUERIES["p6_budgeted_shares"](spark, str(tmp_path)).collect()}
    used = lambda rows: sum(r.n_tokens for r in rows.values())
    assert 0 < exact["big"].exponent < 0.05 and used(exact) < 2_100  # one short document with a tenth of the mix shrinks it
    assert 0 < got["big"].exponent < 1 and used(got) > 8 * used(exact)
    for s, r in got.items():
        assert abs(r.actual_share - r.target_share) > 0.005 and r.most_uses <= r.max_repeats
        assert r.actual_share == pytest.approx(r.weight, abs=0.005)
    assert queries.QUERIES["p6_budgeted"](spark, str(tmp_path)).count() == sum(r.n_rows for r in got.values())


def test_token_sizes(spark):
    rows = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "id bigint, text string")
    got = {r.id: r.n_tokens for r in tokens.token_sizes(rows, ["id"], "text").collect()}
    assert got[1] == 2 and got[2] == 0 and 3 not in got and got[4] > 1
