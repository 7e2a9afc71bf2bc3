"""Exact and near deduplication against brute force, with the cases their docstrings define."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from prismark.llm import common, components, exact_dedup, near_dedup
from prismark.llm.near_dedup import Threshold

SCHEMA = "doc_id bigint, text string, at_file string, digest int, n int, kept string, _metadata string, __maybe int, __file int"  # with columns that clash with the operators' own


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", "m", 3, 4) for i, t in rows], SCHEMA)


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


ODD = [(1, "Some Text"), (2, "some text"), (3, None), (4, ""), (5, "é É"), (6, "É é"), (7, "z" * 200_000), (8, "Z" * 200_000), (9, "alone"), (9, "alone"), (None, "some TEXT"), (None, None), (10, "İ"), (11, "ı")]


@pytest.mark.parametrize("bits", [64, 1])
@pytest.mark.parametrize("files", [None, 1])
def test_exact_equals_brute_force(spark, bits, files):
    """bits = 1 keeps one hex digit of the digest, so most groups hold different texts and the byte check decides."""
    rows = ODD + [(100 + k, f"copy {k % 7}") for k in range(60)]
    got = exact_dedup.decide(docs(spark, rows).repartition(3), digest=lambda t: F.substring(F.sha2(t, 256), 1, bits), files_per_batch=files).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    want = sorted(((i if i is not None else -1), max((x for x in groups[fold(t)] if x is not None), default=-1), len(groups[fold(t)])) for i, t in rows)
    assert sorted((-1 if r["id"] is None else r["id"], -1 if r["keep_id"] is None else r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_keeps_whole_rows_and_empty_tables(spark):
    df = docs(spark, ODD)
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns and sorted(fold(r["text"]) for r in kept.collect()) == sorted({fold(t) for _, t in ODD})
    assert exact_dedup.decide(df.limit(0)).count() == 0 and exact_dedup.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [64, 1])
def test_exact_state_outlives_the_call(spark, tmp_path, bits):
    """The second call's rows are judged against the first call's too, whose table is gone by then."""
    first, second = ODD[:8] + [(100 + k, f"copy {k % 7}") for k in range(30)], ODD[8:] + [(50 + 3 * k, f"Copy {k % 9}") for k in range(40)] + [(200, "z" * 200_000)]
    rows, digest = [], lambda t: F.substring(F.sha2(t, 256), 1, bits)
    for own in (first, second, []):
        rows += own
        groups = {}
        for i, t in rows:
            groups.setdefault(fold(t), []).append(-1 if i is None else i)
        got = exact_dedup.decide(docs(spark, own).repartition(2), digest=digest, state=str(tmp_path)).collect()
        want = sorted((-1 if i is None else i, max(groups[fold(t)]), len(groups[fold(t)])) for i, t in own)
        assert sorted((-1 if r["id"] is None else r["id"], -1 if r["keep_id"] is None else r["keep_id"], r["group_size"]) for r in got) == want


def test_exact_large_group(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALT", 7)
    rows = [(i, "same" if i % 3 else f"text {i}") for i in range(400)]
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.decide(docs(spark, rows)).collect()}
    assert got == {i: (398, 266, i == 398) if i % 3 else (i, 1, True) for i, _ in rows}


def sets_of(rows, k):
    out = []
    for _, t in rows:
        w = fold(t).encode().split()
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, t):
    sets, up = sets_of(rows, t.words), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and t.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b])):
            up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((-1 if d is None else d, len(s), least.get(root(i), -1)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def families(seed, groups, size, words=60, edits=6):
    """Texts of groups; inside a group each differs from the one before it by a few words, so links form chains and stars."""
    r, out, n = random.Random(seed), [], 0
    for _ in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(words)]
        own = base
        for k in range(size):
            own = list(own if k % 3 else base)
            for _ in range(r.randrange(edits)):
                own[r.randrange(words)] = f"w{r.randrange(400)}"
            out.append((n, " ".join(own)))
            n += 1
    r.shuffle(out)
    return out


EDGES = [(9001, None), (9002, ""), (9003, "   "), (9004, "one two"), (9005, "ONE\ttwo"), (9006, "one"), (None, "one two"), (9004, "one two"), (9007, "É one"), (9008, "é one"), (9009, "word " * 50_000)]


@pytest.mark.parametrize("t", [Threshold(85, 100, 3), Threshold(4, 5, 5)])
@pytest.mark.parametrize("small", [False, True])
def test_near_equals_brute_force(spark, monkeypatch, t, small):
    """small: tiny nodes and groups, so that pivots, rounds and blocks do the work."""
    if small:
        for name, value in (("LEAF", 3), ("GROUP", 4), ("PIVOTS", 2), ("ROUNDS", 2), ("REST_BLOCK", 3), ("GROUP_BLOCK", 4), ("PART", 3)):
            monkeypatch.setattr(near_dedup, name, value)
    rows = families(1, 6, 14) + EDGES
    got = near_dedup.near_duplicates(docs(spark, rows), t).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == brute(rows, t)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 20)
    monkeypatch.setattr(near_dedup, "GROUP", 30)
    rows = families(2, 1, 150, words=120, edits=10)
    t = Threshold(85, 100, 3)
    got = near_dedup.near_duplicates(docs(spark, rows), t).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, t)


@pytest.mark.parametrize("depth", [2, 8])
def test_trees_reach_the_recall(depth):
    """By simulation: pairs at the threshold agree in each coordinate with its chance, and trees pick coordinates at random."""
    import numpy as np

    t, rng = Threshold(4, 5, 5), np.random.default_rng(depth)
    agree = rng.random((4000, near_dedup.COORDINATES)) < 0.8
    met = np.zeros(4000, bool)
    for _ in range(near_dedup.trees_for(t, depth)):
        met |= agree[:, rng.integers(0, near_dedup.COORDINATES, depth)].all(1)
    assert met.mean() > near_dedup.RECALL - 0.006


def shared_passage(n, words, passage, own):
    """Pairs of texts of similarity 0.8 or a little more; all texts share a passage, so trees take them apart slowly."""
    r = random.Random(11)
    common_, out = [f"p{i}" for i in range(passage)], []
    for k in range(n):
        base = [f"k{k}x{i}" for i in range(words - passage)]
        for j in range(2):
            edge = [f"e{k}j{j}x{i}" for i in range(own)]
            out.append((2 * k + j, " ".join([*common_, *base, *edge])))
    r.shuffle(out)
    return out


def test_near_recall_with_a_passage_that_all_share(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 6)
    monkeypatch.setattr(near_dedup, "GROUP", 40)
    rows = shared_passage(300, 80, 56, 9)
    t = Threshold(4, 5, 5)
    a, b = sets_of([x for x in rows if x[0] < 2], 5)
    assert t.linked(len(a & b), len(a), len(b)) and len(a & b) / len(a | b) < 0.82
    reached = []
    grown = near_dedup._grown
    monkeypatch.setattr(near_dedup, "_grown", lambda *x: reached.append((x[2], (out := grown(*x))[2])) or out)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, rows), t).collect()}
    assert max(d for _, d in reached) > 3
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(300)) >= 297 and all(v // 2 == k // 2 for k, v in got.items())


def test_trees_pick_no_coordinate_twice(spark):
    """Pairs that agree in one coordinate only may share a node at the root, and none below it."""
    import numpy as np

    c, trees = near_dedup.COORDINATES, range(192)
    sig = np.arange(2 * c * c, dtype=np.uint32).reshape(2 * c, c)
    for i in range(c):
        sig[2 * i, i] = sig[2 * i + 1, i]
    rows = spark.createDataFrame([(0, bytes([k]), 9, x.tobytes()) for k, x in enumerate(sig)], "parent bigint, digest binary, n bigint, sig binary")
    root = near_dedup._branches(rows, 0, trees)[0]
    shared = root.groupBy("path").count().where("count > 1")
    assert shared.count() == len(trees)
    level = root.join(shared, "path").select("path", "digest", F.lit(2).cast("bigint").alias("parent")).join(rows.drop("parent"), "digest")
    assert near_dedup._branches(level, 1, range(1))[1].groupBy("path").count().where("count > 1").count() == 0


def test_near_long_texts_in_one_group(spark, monkeypatch):
    """Groups of few members but much text go in bounded blocks."""
    monkeypatch.setattr(near_dedup, "SHINGLES", 500)
    rows = families(5, 2, 12, words=400, edits=20)
    t = Threshold(85, 100, 3)
    got = near_dedup.near_duplicates(docs(spark, rows), t).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, t)


def test_near_keeps_one_row_a_group(spark):
    rows = families(3, 4, 5) + EDGES
    df = docs(spark, rows)
    kept = near_dedup.keep_first(df, Threshold(4, 5, 5))
    assert kept.columns == df.columns
    components_ = brute(rows, Threshold(4, 5, 5))
    words = len({c for _, n, c in components_ if n})
    assert kept.count() == words + sum(n == 0 for _, n, _ in components_)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0 and near_dedup.keep_first(df.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(5000 + k % 3, 10_000 + k) for k in range(3000)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(tuple(r) for r in components.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200} | {5000 + k: 5000 + k for k in range(3)} | {10_000 + k: 5000 + k % 3 for k in range(3000)}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("few", [0, 50_000])
def test_components_by_steps_and_in_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    r = random.Random(3)
    links = [(bytes([r.randrange(90), 200]), bytes([r.randrange(90), 200])) for _ in range(60)] + [(b"zz", b"zz")]
    up = {x: x for pair in links for x in pair}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = components.connected(spark.createDataFrame(links, "a binary, b binary")).collect()
    assert len(got) == len(up) - 1 - sum(all(x not in (a, b) or a == b for a, b in links) for x in up if x != b"zz")
    assert all(up[bytes(x)] == bytes(root) for x, root in got) and b"zz" not in {bytes(x) for x, _ in got}


def test_a_level_moves_each_signature_once(spark, monkeypatch):
    """A class lies in a node of each tree; its row joins once, and the rows of its nodes are those of a join for each."""
    import numpy as np

    sig = np.tile(np.arange(near_dedup.COORDINATES, dtype=np.uint32), (2, 1)).tobytes()
    rows = [("a", 9, sig[: len(sig) // 2], [1, 2, 3 << near_dedup.TREE_BITS | 1], [4, 5, 6]), ("b", 8, sig[len(sig) // 2 :], [2], [5])]
    lists = spark.createDataFrame([(d.encode(), n, x, p, q) for d, n, x, p, q in rows], "digest binary, n bigint, sig binary, paths array<bigint>, parents array<bigint>")
    flat = spark.createDataFrame([(d.encode(), n, x, i, j) for d, n, x, p, q in rows for i, j in zip(p, q)], "digest binary, n bigint, sig binary, path bigint, parent bigint")
    for got, want in zip(near_dedup._branches(lists, 1, range(1)), near_dedup._branches(flat, 1, range(1))):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4
    seen, branches = [], near_dedup._branches
    monkeypatch.setattr(near_dedup, "LEAF", 6)
    monkeypatch.setattr(near_dedup, "_branches", lambda level, depth, trees: seen.append((depth, level.count(), level.select("digest").distinct().count())) or branches(level, depth, trees))
    asked, maybe_in = [], common.maybe_in
    monkeypatch.setattr(common, "maybe_in", lambda df, keys, *x: (asked.append(df.count()) if df.columns == ["digest", "n", "sig"] else None) or maybe_in(df, keys, *x))
    near_dedup.near_duplicates(docs(spark, shared_passage(40, 80, 56, 9)), Threshold(4, 5, 5)).count()
    assert any(depth > 1 for depth, *_ in seen) and all(n == classes for _, n, classes in seen)
    levels = [n for _, n, _ in seen]
    assert all(n == levels[i] for i, n in zip([i for i, (depth, *_) in enumerate(seen) if i + 1 < len(seen) and seen[i + 1][0] > depth], asked))  # only the classes of the level above are asked


def test_links_of_levels_join_in_plans_of_their_own(spark, monkeypatch):
    """What components are made of holds no join: the levels' joins, all in one plan, took the driver's memory with the number of levels."""
    monkeypatch.setattr(near_dedup, "LEAF", 6)
    monkeypatch.setattr(near_dedup, "SHRINKS", 0.3)
    plans, alike = [], []
    connected, grown = near_dedup.connected, near_dedup._grown
    monkeypatch.setattr(near_dedup, "connected", lambda links: plans.append(links._jdf.queryExecution().optimizedPlan().toString()) or connected(links))
    monkeypatch.setattr(near_dedup, "_grown", lambda *x: alike.extend((out := grown(*x))[1]) or out)
    rows = families(2, 2, 60, words=120, edits=10)
    t = Threshold(85, 100, 3)
    got = near_dedup.near_duplicates(docs(spark, rows), t).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, t)
    assert len(alike) > 1 and "Union" in plans[0] and "Join" not in plans[0]
