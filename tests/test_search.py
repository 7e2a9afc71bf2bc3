import numpy as np
import pytest
from pyspark.sql import functions as F

from prismark.functions import quantize, vectors
from prismark.operators import cache, evaluation, lsh, search

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def frame(spark, m, labels=None):
    return spark.createDataFrame([(i, [float(x) for x in v], 0 if labels is None else labels[i]) for i, v in enumerate(m)], SCHEMA)


def brute(m, q, k, metric):
    m = m.astype(np.float64)
    if metric == "cosine":
        u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        s = u @ u[q]
    else:
        s = -np.linalg.norm(m - m[q], axis=1)
    return [(int(i), s[i]) for i in np.lexsort((np.arange(len(m)), -s))[:k]]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("bound", [4096, 3])
def test_exact_equals_brute_force(spark, monkeypatch, metric, bound):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", bound)  # 3: by blocks
    monkeypatch.setattr(search, "ROW_BLOCK", 20)
    m = np.random.default_rng(0).standard_normal((60, 8)).astype(np.float32)
    m[7] = 0
    df = frame(spark, m)
    got = search.exact_topk(df, df.where("vec_id % 6 = 0"), 5, metric).orderBy("query_id", "rank").collect()
    for q in range(0, 60, 6):
        own = [(r["image_id"], r["score"]) for r in got if r["query_id"] == q]
        want = brute(m, q, 5, metric)
        assert [i for i, _ in own] == [i for i, _ in want]
        assert np.allclose([s for _, s in own], [s for _, s in want])


def test_ties_nulls_and_few_rows(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (None, [1.0, 0.0], 0), (9, None, 0)], SCHEMA)
    got = search.exact_topk(df, df, 10, digits=6).where("query_id = 3").orderBy("rank").collect()
    assert [r["image_id"] for r in got] == [1, 2, 3]
    assert search.exact_topk(df.limit(0), df, 3).count() == 0 and search.exact_topk(df, df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        search.exact_topk(df, df, 3, "manhattan")


def test_plan_limits_ranks_before_the_shuffle(spark):
    df = frame(spark, np.eye(4))
    plan = search.exact_topk(df, df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_codes_equal_numpy_and_prefixes_nest(spark):
    m = np.random.default_rng(1).standard_normal((40, 16)).astype(np.float32)
    m[3] = 0
    config = lsh.LSHConfig(num_tables=3, hash_width=12)
    got = {(r["image_id"], r["table_id"]): r["bucket"] for r in lsh.codes(frame(spark, m), config, 16).collect()}
    for i in range(40):
        for t in range(3):
            bits = [int(m[i].astype(np.float64) @ lsh.projection(16, t, b) >= 0) for b in range(12)]
            assert got[i, t] == int("".join(map(str, bits)), 2)
    assert got[3, 0] == 2**12 - 1
    narrow = {(r["image_id"], r["table_id"]): r["bucket"] for r in lsh.codes(frame(spark, m), lsh.LSHConfig(3, 5), 16).collect()}
    assert all(got[k] >> 7 == v for k, v in narrow.items())
    with pytest.raises(ValueError):
        lsh.LSHConfig(hash_width=63)


def test_self_retrieval_and_twin(spark):
    rng = np.random.default_rng(7)
    m = rng.standard_normal((30, 64))
    m[29] = m[0] + 0.005 * rng.standard_normal(64)
    config = lsh.LSHConfig(num_tables=10, hash_width=8)
    df = frame(spark, m)
    found = lsh.search_index(lsh.build_index(df, config, 64), df, df.where("vec_id = 0"), config, 64, 5).orderBy("rank").collect()
    assert found[0]["image_id"] == 0 and found[1]["image_id"] == 29 and len(found) <= 5
    assert all(-1 <= r["score"] <= 1.01 for r in found)
    empty = lsh.search_index(lsh.build_index(df.limit(0), config, 64), df, df, config, 64, 5)
    assert empty.count() == 0


def test_grid_quality_counts_what_the_grid_lists(spark):
    m = np.random.default_rng(4).standard_normal((80, 8))
    df, config = frame(spark, m), lsh.LSHConfig(3, 5)
    own, asked = df.where("vec_id % 4 = 0"), lsh.codes(df.where("vec_id % 4 = 0"), config, 8)
    truth = search.exact_topk(df, own, 3)
    listed = lsh.grid(lsh.build_index(df, config, 8), asked, 5, [1, 3], [2, 5]).toPandas().merge(truth.select("query_id", "image_id", "rank").toPandas(), how="left")
    want = listed.groupby(["num_tables", "hash_width"])[["image_id", "rank"]].count() / [20, 60]
    out = lsh.grid_quality(lsh.build_index(df, config, 8), asked, truth, 5, [1, 3], [2, 5], 3)
    got = out.toPandas().set_index(["num_tables", "hash_width"]).sort_index()
    assert list(got.index) == list(want.index) and np.allclose(got.to_numpy(), want.to_numpy())


def test_scan_finds_what_the_index_finds_and_shuffles_few_rows(spark):
    m = np.random.default_rng(6).standard_normal((120, 8))
    df, config = frame(spark, m), lsh.LSHConfig(3, 4)
    own = df.where("vec_id % 3 = 0")
    want = lsh.search_index(lsh.build_index(df, config, 8), df, own, config, 8, 40, digits=6)
    got = lsh.scan_index(df, own, config, 8, 40, digits=6)
    order = ["query_id", "rank", "image_id", "score", "node_id"]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(map(tuple, want.select(order).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Join" not in plan
    assert lsh.scan_index(df.limit(0), own, config, 8, 5).count() == 0 and lsh.scan_index(df, own.limit(0), config, 8, 5).count() == 0


def test_bucket_probe_broadcasts_a_small_side(spark):
    config = lsh.LSHConfig(2, 4)
    df = frame(spark, np.eye(8))
    plan = lsh.search_index(lsh.build_index(df, config, 8), df, df, config, 8, 2)
    plan.collect()
    assert "Join" in plan._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in plan._jdf.queryExecution().executedPlan().toString()


def test_vectors_and_quantizer(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([5.0, 12.0],)], "v array<float>")
    norms = [r[0] for r in df.select(vectors.norm(vectors.l2_normalize(F.col("v")))).collect()]
    assert np.allclose(norms, [1, 0, 1])
    assert np.allclose([r[0] for r in df.select(vectors.norm(vectors.fuse(F.col("v"), F.col("v")))).collect()], [2**0.5, 0, 2**0.5])
    m = np.random.default_rng(42).standard_normal((100, 32)).astype(np.float32)
    q = quantize.Quantizer.fit(frame(spark, m))
    got = np.array([r[0] for r in frame(spark, m).orderBy("vec_id").select(q.compress(F.col("embedding"))).collect()])
    want = (np.clip((m - m.min()) / (m.max() - m.min()), 0, 1) * 255).astype(np.uint8)
    assert (np.abs(got - want) <= 1).all() and (got == want).mean() > 0.999
    assert frame(spark, m).select(q.roundtrip_cosine(F.col("embedding")).alias("c")).agg(F.min("c")).first()[0] > 0.999
    assert quantize.Quantizer(1.0, 1.0).low == 1.0
    with pytest.raises(RuntimeError):
        quantize.Quantizer().compress(F.col("v"))


def test_result_cache():
    c = cache.ResultCache(2)
    for k in "aba":
        if c.get(k) is None:
            c.put(k, [k])
    c.put("c", ["c"])
    assert c.get("b") is None and c.get("a") == ["a"] and round(c.hit_rate, 2) == 0.4


@pytest.mark.parametrize("chunk", [7, 1000])
def test_lru_replay_in_chunks(spark, chunk):
    from collections import OrderedDict

    keys = [int(x) for x in np.random.default_rng(3).zipf(1.5, 300) % 40]
    kept, want = OrderedDict(), []
    for k in keys:
        want.append(k in kept)
        kept.pop(k, None)
        kept[k] = 1
        if len(kept) > 5:
            kept.popitem(last=False)
    df = spark.createDataFrame(list(enumerate(keys)), "seq bigint, key bigint")
    assert [r["hit"] for r in cache.lru_replay(df, 5, chunk=chunk).orderBy("seq").collect()] == want


def test_pareto(spark):
    p = spark.createDataFrame([(1, 1.0, 0.5), (2, 2.0, 0.4), (3, 3.0, 0.9), (4, 4.0, 0.9)], "id int, cost double, gain double")
    assert [r["id"] for r in evaluation.pareto_frontier(p, "cost", "gain").orderBy("cost").collect()] == [1, 3]


def test_cache_key_depends_on_what_the_answer_does(spark):
    df = spark.createDataFrame([([0.12341, 1.0],), ([0.12344, 1.0],), ([0.2, 1.0],)], "v array<float>")
    k = lambda n, m="cosine": [r[0] for r in df.select(cache.cache_key(F.col("v"), n, m)).collect()]
    a, b = k(5), k(6)
    assert a[0] == a[1] != a[2] and a[0] != b[0] and a[0] != k(5, "l2")[0]


def test_many_queries_shuffle_no_rows(spark, monkeypatch):
    """Queries go to the rows in several passes, and what is shuffled holds no vectors."""
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 3)
    monkeypatch.setattr(search, "PASS", 1)
    m = np.random.default_rng(4).standard_normal((60, 8)).astype(np.float32)
    df, plans, stored = frame(spark, m), [], search.stored
    monkeypatch.setattr(search, "stored", lambda found, what: plans.append(found._jdf.queryExecution().executedPlan().toString()) or stored(found, what))
    got = search.exact_topk(df, df.where("vec_id % 6 = 0"), 5).orderBy("query_id", "rank").collect()
    assert len(plans) == 4 and not any("CoGroup" in p for p in plans)
    for q in range(0, 60, 6):
        assert [r["image_id"] for r in got if r["query_id"] == q] == [i for i, _ in brute(m, q, 5, "cosine")]


def test_ties_by_rounding_and_many_equal_rows(spark):
    """Scores that only rounding makes equal are ranked by id, within a batch too; of many equal rows a task gives k."""
    df = spark.createDataFrame([(5, [1.0000002], 0), (2, [1.0], 0), (7, [0.5], 0)], SCHEMA)
    got = search.exact_topk(df, df.where("vec_id = 2"), 1, "dot", digits=6).collect()
    assert [r["image_id"] for r in got] == [2]
    held = search._Best((np.array([1]), np.array([[1.0]])), "dot", 3, False, 1e-9)
    for at in range(0, 4000, 1000):
        held.meet(np.arange(at, at + 1000)[::-1], np.ones((1000, 1)))
        assert held.size <= 12 + 3
    assert held.prune()[1].tolist() == [0, 1, 2]
