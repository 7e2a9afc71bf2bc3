import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismark.operators import ring

IDS = 7128
SIZES = {(2, 150): [3758, 3370], (4, 150): [1944, 1693, 1743, 1748], (8, 150): [1018, 772, 701, 884, 954, 864, 1003, 932], (4, 10): [1581, 1847, 1291, 2409], (4, 50): [2074, 1290, 1824, 1940], (4, 5): [3654, 1244, 1209, 1021]}
SKEWS = {(2, 150): 5.4, (4, 150): 9.1, (8, 150): 21.3, (4, 10): 35.2, (4, 50): 27.6}


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(IDS).withColumnRenamed("id", "image_id")


def test_published_sizes_and_skews(spark, ids):
    sizes = ring.sweep(ids, list(SIZES)).cache()
    for (n, v), want in SIZES.items():
        got = {r["node_id"]: r["size"] for r in sizes.where(f"nodes = {n} AND virtual_nodes = {v}").collect()}
        assert [got[i] for i in range(n)] == want
    for r in ring.max_skew_percent(sizes, ["nodes", "virtual_nodes"]).collect():
        if (r["nodes"], r["virtual_nodes"]) in SKEWS:
            assert round(r["max_skew_percent"], 1) == SKEWS[r["nodes"], r["virtual_nodes"]]


def test_first_ids(spark, ids):
    got = {r["image_id"]: r["node_id"] for r in ring.assign(ids.where("image_id < 10 OR image_id = 100"), ring.positions(spark)).collect()}
    assert [got[i] for i in range(10)] == [2, 0, 0, 0, 3, 2, 3, 0, 2, 2] and got[100] == 3


def test_rebalance_goldens(spark, ids):
    for n, moves, after in (
        (7128, [(1, 0, 1, 1205), (1, 0, 2, 620), (1, 0, 3, 404), (2, 1, 0, 512), (2, 1, 3, 256)], [1937, 1681, 1829, 1681]),
        (2000, [(1, 0, 1, 343), (1, 0, 2, 182), (1, 0, 3, 114), (2, 1, 0, 147), (2, 1, 3, 74)], [545, 472, 512, 471]),
    ):
        a = ring.assign(ids.where(F.col("image_id") < n), ring.positions(spark, 4, 5))
        out, plan = ring.rebalance(a, 4)
        assert plan.moves == moves and plan.sizes == after and plan.rounds == 2
        sizes = {r["node_id"]: r["size"] for r in ring.summary(out, 4).collect()}
        assert [sizes[i] for i in range(4)] == after
        assert ring.in_sync(out, ring.positions(spark, 4, 5)).first()["in_sync"]


@given(st.lists(st.integers(0, 200), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_moves_keep_every_id(sizes):
    """Replays the plan on explicit lists: every stretch names ids that the lists have moved there."""
    plan = ring.plan_moves(sizes)
    lists = [[(n, k) for k in range(s)] for n, s in enumerate(sizes)]
    for _, a, b, m in plan.moves:
        lists[b] += lists[a][:m]
        lists[a] = lists[a][m:]
    want = {x: n for n, own in enumerate(lists) for x in own if x[0] != n}
    got = {(o, r): n for o, first, last, n in plan.stretches for r in range(first, last + 1)}
    assert got == want and sum(plan.sizes) == sum(sizes)


def test_empty_nodes_and_no_ids(spark):
    none = spark.createDataFrame([], "image_id bigint, node_id int")
    s = ring.skew_status(ring.summary(none, 3)).collect()
    assert [r["size"] for r in s] == [0, 0, 0] and {r["status"] for r in s} == {"OK"}


def test_override_wins(spark, ids):
    o = spark.createDataFrame([(0, 1)], "image_id bigint, node_id int")
    assert ring.assign(ids.where("image_id = 0"), ring.positions(spark), overrides=o).first()["node_id"] == 1
