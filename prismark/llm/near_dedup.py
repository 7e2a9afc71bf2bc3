"""MinHash near-deduplication by a chosen-path set similarity join.

A document is its set of word shingles. Documents with equal sets form one class, and only classes are
compared. In each of several independent trees a level picks a minwise coordinate, another one each time, and
documents branch by the token that is least under it; nodes with few documents are compared
exhaustively, on sketches, and others branch again, each until its own branching no longer takes it
apart. The number of trees follows from the target recall and the deepest level that trees reach: a pair
at the threshold must agree in one coordinate a level, so deeper trees are repeated more often
(``trees_for``). What the sketches do not rule out makes candidate
groups: groups of few members and bounded text are compared exhaustively on their full sets, and every
member of a larger group meets a few pivots, again on full sets. Members that pivots join to one component
need no link of their own. The others choose new pivots, a few times, and at last meet the whole group in
blocks of bounded text; so no link between parts that pivots leave apart is lost, and pairs within a part
are never made. Nodes, groups and components may be large: their rows are dealt out to many tasks, and
what is known of them in copies, so none is gathered in one task.

Defined results: null and empty texts and texts without words have an empty set and are linked with
nothing; texts with fewer words than a shingle have the whole sequence as one; rows with a null id take
part, and a component's id is its least id that is not null; repeated rows are one class; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismark.llm import common
from prismark.llm.components import connected

#: TREES at least; more where trees grow deep.
COORDINATES, TREES, DEPTH = 64, 12, 8
#: Share of the pairs at the threshold that the trees are to bring together at least; pairs above it are met more often.
RECALL = 0.99
#: A large node branches on unless it holds more than this share of the node above it.
SHRINKS = 0.8
#: Most classes in a node, and in a candidate group, that are compared exhaustively in one task.
LEAF, GROUP = 128, 256
#: Shingles, and so bytes of text, that one task compares at a time: bounds groups and blocks beside their members' number.
SHINGLES = 1_000_000
PIVOTS, ROUNDS = 8, 3
#: Rounds end when one leaves more than this share of the members that the one before it has left.
PROGRESS = 0.9
#: Members of a large group that meet one copy of its pivots.
PART = 500
#: Most members of the blocks in which what pivots leave of a large group meets the whole group.
REST_BLOCK, GROUP_BLOCK = 1024, 1024
WORDS = 60_000
_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_ORDERED = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least part / whole; shingles of so many words."""

    part: int = 4
    whole: int = 5
    words: int = 5

    def linked(self, shared: int, a: int, b: int) -> bool:
        return self.whole * shared >= self.part * (a + b - shared)

    def sizes(self, a: int, b: int) -> bool:
        """Whether sets of these sizes can reach the threshold."""
        return self.whole * min(a, b) >= self.part * max(a, b)

    @property
    def agreeing(self) -> int:
        """Coordinates in which a pair at the threshold agrees at least: five standard deviations below the mean."""
        j = self.part / self.whole
        return int(COORDINATES * j - 5 * (COORDINATES * j * (1 - j)) ** 0.5)


def trees_for(t: Threshold, depth: int, recall: float = RECALL) -> int:
    """Trees that bring a pair at the threshold together, where it must agree in ``depth`` coordinates, with the given chance.

    The trees pick from the same coordinates, of which such a pair agrees in a binomial number; a tree picks none twice.
    """
    j, c = t.part / t.whole, COORDINATES
    missed = lambda trees: sum(comb(c, a) * j**a * (1 - j) ** (c - a) * (1 - comb(a, depth) / comb(c, depth)) ** trees for a in range(c + 1))
    return next(n for n in range(1, 10_000) if missed(n) <= 1 - recall)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    own = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: A-Z only, and the six ASCII spaces
    if not own:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = common.worker_kept("shingles", dict)
    if len(known) > WORDS:
        known.clear()
    hashes = np.fromiter([known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in own], np.uint64, len(own))
    if len(own) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=len(own))], np.uint64)
    n = len(own) - words + 1
    total = np.zeros(n, np.uint64)
    for i in range(words):
        total += hashes[i : i + n] * _ORDERED[i]
    return np.unique(_mix(total))


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 4096):
        part = s[None, i : i + 4096] * _FACTORS[:, None] + _TERMS[:, None]
        out = np.minimum(out, (part.min(1) >> np.uint64(32)).astype(np.uint32))
    return out


def _sets(docs: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [shingles(t, words) for t in b["text"].where(b["text"].notna(), None)]
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"), "at_file": b["at_file"], "at_row": b["at_row"], "n": [len(s) for s in rows],
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in rows], "sig": [signature(s).tobytes() for s in rows],
            })
        common.worker_forget()

    own = common.located(docs, [F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")])
    return own.mapInPandas(run, "doc_id bigint, at_file string, at_row bigint, n bigint, digest binary, sig binary")


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, COORDINATES)


#: The last bits of a path hold its tree.
TREE_BITS = 16


def _picks(tree: int) -> np.ndarray:
    """The coordinates that a tree's levels pick, none twice: under one picked again a node would stay whole, whatever is in it."""
    first = tree * 5 % COORDINATES
    rest = np.random.default_rng(tree).permutation(COORDINATES)
    return np.array([first, *rest[rest != first][: DEPTH - 1]])


NODE = "path bigint, parent bigint, digest binary, n bigint, sketch binary"


def _branches(rows: DataFrame, depth: int, trees: range) -> tuple[DataFrame, DataFrame]:
    """The children of each row, and their paths only: at the root one for each tree, below that by the coordinate that the path's tree picks.

    Below the root a row may hold one path and its parent's size, or arrays of them (paths, parents) beside a single signature.
    """
    low = np.uint64((1 << TREE_BITS) - 1)
    many = "paths" in rows.columns

    def at_paths(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows of one path each, some at a time, as signatures are repeated for them."""
        if not many:
            yield b
            return
        for i in range(0, len(b), 256):
            part = b.iloc[i : i + 256]
            own = part.drop(columns=[c for c in ("paths", "parents") if c in part]).loc[part.index.repeat(part["paths"].map(len))]
            lists = {c: np.concatenate([np.asarray(x, np.int64) for x in part[f"{c}s"]]) for c in ("path", "parent") if f"{c}s" in part}
            yield own.assign(**lists)

    def paths(b: pd.DataFrame, sig: np.ndarray, tree: int) -> np.ndarray:
        if depth:
            path = b["path"].to_numpy(np.int64).view(np.uint64)
            own = path & low
            known, at = np.unique(own, return_inverse=True)
            pick = np.array([_picks(int(x))[depth] for x in known], np.int64)[at]
        else:
            path, own, pick = np.full(len(b), tree + 1, np.uint64), np.uint64(tree), np.full(len(b), _picks(tree)[0])
        path = _mix(_mix(path * _ORDERED[depth] + pick.astype(np.uint64)) + sig[np.arange(len(b)), pick].astype(np.uint64) * _ORDERED[depth + 8])
        return (path & ~low | own).view(np.int64)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in at_paths(batch) if len(batch) else ():
                sig = _signatures(b["sig"])
                sketch = pd.Series([x.tobytes() for x in sig.astype(np.uint8)])
                for tree in trees:
                    yield pd.DataFrame({"path": paths(b, sig, tree), "parent": b["parent"].to_numpy(), "digest": b["digest"].to_numpy(), "n": b["n"].to_numpy(), "sketch": sketch.to_numpy()})

    def only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in at_paths(batch) if len(batch) else ():
                sig = _signatures(b["sig"])
                for tree in trees:
                    yield pd.DataFrame({"path": paths(b, sig, tree)})

    return rows.mapInPandas(whole, NODE), rows.select(*(["paths" if many else "path"] if depth else []), "sig").mapInPandas(only, "path bigint")


def _tasks(rows: int, each: int) -> int:
    """So many tasks for a Python step whose input may be small: about ``each`` rows to a task."""
    return max(1, -(-rows // each))


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _near_pairs(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that sketches (rows of COORDINATES bytes) and set sizes do not rule out."""
    near = np.zeros((len(left), len(right)), bool)
    for i in range(0, len(left), 64):
        near[i : i + 64] = (left[i : i + 64, None] == right[None]).sum(2) >= t.agreeing
    near &= t.whole * np.minimum(n_left[:, None], n_right[None]) >= t.part * np.maximum(n_left[:, None], n_right[None])
    return np.nonzero(near)


def _candidates(nodes: DataFrame, t: Threshold) -> DataFrame:
    """Of small nodes (arrays of members), a spanning forest of the pairs that sketches and sizes do not rule out: a, b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = set()
            for members in b["members"]:
                digests = [m["digest"] for m in members]
                sketch = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint8).reshape(-1, COORDINATES)
                n = np.array([m["n"] for m in members])
                forest = Forest(len(digests))
                for i, j in zip(*(x.tolist() for x in _near_pairs(sketch, sketch, n, n, t)), strict=True):
                    if i < j:
                        forest.join(i, j)
                least: dict[int, bytes] = {}
                for i, d in enumerate(digests):
                    r = forest.root(i)
                    least[r] = min(d, least.get(r, d))
                out.update((least[forest.root(i)], d) for i, d in enumerate(digests) if least[forest.root(i)] != d)
            yield _links(list(out))

    return nodes.mapInPandas(run, LINK)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _verified(left: list, right: list, sets_left: list[np.ndarray], sets_right: list[np.ndarray], t: Threshold) -> list[tuple]:
    """What links on full sets join among left and right keys: each key with the least of its component, by comparing whatever is not joined yet."""
    place = {k: i for i, k in enumerate(dict.fromkeys([*left, *right]))}
    forest = Forest(len(place))
    sizes = [np.array([len(s) for s in sets]) for sets in (sets_left, sets_right)]
    sketches = [_sketches(sets_left), _sketches(sets_right)] if sets_left is not sets_right else [_sketches(sets_left)] * 2
    for i, j in zip(*(x.tolist() for x in _near_pairs(*sketches, *sizes, t)), strict=True):
        a, b = place[left[i]], place[right[j]]
        if a != b and forest.root(a) != forest.root(b) and t.linked(_shared(sets_left[i], sets_right[j]), len(sets_left[i]), len(sets_right[j])):
            forest.join(a, b)
    least: dict[int, bytes] = {}
    for k, i in place.items():
        r = forest.root(i)
        least[r] = min(k, least.get(r, k))
    return [(k, least[forest.root(i)]) for k, i in place.items() if least[forest.root(i)] != k]


def _links(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["a", "b"])


LINK = "a binary, b binary"


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    return np.stack([signature(s).astype(np.uint8) for s in sets])


def _small_links(members: DataFrame, t: Threshold) -> DataFrame:
    """Verified links inside groups (group, digest, text) of at most GROUP members, each group in one task."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(x, t.words) for x in b["text"]]
        keys = b["digest"].tolist()
        return _links(_verified(keys, keys, sets, sets, t))

    return members.groupBy("group").applyInPandas(run, LINK)


MET = "group binary, size bigint, n bigint, digest binary, text string, joined boolean, done boolean, bits int, linked array<binary>"


def _met_pivots(members: DataFrame, t: Threshold, tasks: int) -> DataFrame:
    """One round: pivots from the members that are neither joined nor done; each member with the pivots it is linked to.

    members: group, size, n, digest, text, joined, done. Returns these with the linked pivots, as bits and as digests.
    """
    order = F.struct(F.xxhash64("digest", "group").alias("h"), "digest")
    part = F.pmod(F.xxhash64("group", "digest"), F.lit(PIVOTS))
    # one member of each hashed part of a group, so picking pivots gathers no group
    free = members.where("NOT joined AND NOT done")
    pivots = free.groupBy("group", part.alias("part")).agg(F.min_by(F.struct("digest", "text"), order).alias("p"), F.first("size").alias("size"))
    # a part of a group and a copy of its pivots lie together, the pivots first
    parts = F.ceil(F.col("size") / PART)
    none = F.lit(None)
    copies = pivots.select("group", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"), F.lit(False).alias("member"), "size", none.cast("bigint").alias("n"), "p.digest", "p.text", none.cast("boolean").alias("joined"), none.cast("boolean").alias("done"))
    own = members.select("group", F.pmod(F.xxhash64("digest"), parts).alias("part"), F.lit(True).alias("member"), "size", "n", "digest", "text", "joined", "done")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known, names = None, [], []
        for b in batches:
            out = []
            for group, part, member, size, n, digest, text, joined, done in b.itertuples(index=False):
                if (group, part) != at:
                    at, known, names = (group, part), [], []
                own = shingles(text, t.words)
                if not member:
                    known.append(own)
                    names.append(digest)
                elif known:
                    hits = [k for k, s in enumerate(known) if t.sizes(len(own), len(s)) and t.linked(_shared(own, s), len(own), len(s))]
                    out.append((group, size, int(n), digest, text, joined, done or digest in names, sum(1 << k for k in hits), [names[k] for k in hits]))
            yield pd.DataFrame(out, columns=["group", "size", "n", "digest", "text", "joined", "done", "bits", "linked"])
        common.worker_forget()

    both = copies.unionByName(own).repartition(tasks, "group", "part").sortWithinPartitions("group", "part", "member", "digest")
    return both.mapInPandas(run, MET)


def _joining(met: DataFrame) -> DataFrame:
    """Of each group: the bits of the pivots that lie in its main component (main), its members' number, and whether any member is neither joined nor done (open). From counts of members by bits."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        main = 1 << PIVOTS  # members that earlier rounds have joined
        masks = [(int(x) | main * bool(j), bool(d), int(n)) for x, j, d, n in zip(b["bits"], b["joined"], b["done"], b["members"], strict=True)]
        parts: list[int] = []
        for m, _, _ in masks:
            if m:
                parts, m = [p for p in parts if not p & m], m | sum({p for p in parts if p & m})
                parts.append(m)
        size = {p: sum(n for m, _, n in masks if m & p) for p in parts}
        best = max(size, key=lambda p: (bool(p & main), size[p], p), default=0)
        return pd.DataFrame({"group": [b["group"].iloc[0]], "main": [best & (main - 1)], "members": [sum(n for _, _, n in masks)], "open": [any(not d and not m & (best | main) for m, d, _ in masks)]})

    counts = met.groupBy("group", "bits", "joined", "done").agg(F.count(F.lit(1)).alias("members"))  # at most 2 ** (PIVOTS + 2) rows a group
    return counts.groupBy("group").applyInPandas(run, "group binary, main int, members bigint, open boolean")


def _large_links(members: DataFrame, t: Threshold, count: int) -> DataFrame:
    """Verified links inside groups (group, size, n, digest, text) that are too large for one task: pivots in rounds, then blocks."""
    now = members.withColumns({"joined": F.lit(False), "done": F.lit(False)})
    found, open_ = [], count
    for _ in range(ROUNDS):
        common.collected(members.sparkSession)
        met = common.stored(_met_pivots(now, t, _tasks(count, 200)), "near-met")
        pairs = met.where("bits > 0").select(F.col("digest").alias("a"), F.explode("linked").alias("b"))
        found.append(pairs.where("a <> b"))
        state = common.heavy_join(met.drop("linked"), common.stored(_joining(met), "near-joining"), "group", "members", count, ["digest"]).where("open")
        # groups whose members are all joined or done are finished
        now = common.stored(state.select("group", "size", "n", "digest", "text", (F.col("joined") | (F.col("bits").bitwiseAND(F.col("main")) > 0)).alias("joined"), "done"), "near-state")
        before, open_ = open_, now.where("NOT joined AND NOT done").count()
        count = now.count()
        if not count or open_ > PROGRESS * before:
            break
    links = reduce(DataFrame.unionByName, found)
    if not count:
        return links
    rest = F.when(~F.col("joined") & ~F.col("done"), F.col("n"))
    blocks = lambda n, most, shingles_: F.ceil(F.greatest(n / most, shingles_ / SHINGLES, F.lit(1.0)))
    sums = now.groupBy("group").agg(F.count(rest).alias("rest"), F.sum(rest).alias("rest_n"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("all_n"))
    sums = common.stored(sums.select("group", "members", blocks(F.col("rest"), REST_BLOCK, F.col("rest_n")).alias("rbs"), blocks(F.col("members"), GROUP_BLOCK, F.col("all_n")).alias("gbs")), "near-rest")
    h, zero = F.xxhash64(F.lit(7), "digest"), F.lit(0).cast("bigint")
    every = common.heavy_join(now, sums, "group", "members", count, ["digest"])
    left = every.where("NOT joined AND NOT done").select("group", "digest", "text", F.pmod(h, "rbs").alias("rb"), F.explode(F.sequence(zero, F.col("gbs") - 1)).alias("gb"), F.lit(True).alias("own"))
    right = every.select("group", "digest", "text", F.explode(F.sequence(zero, F.col("rbs") - 1)).alias("rb"), F.pmod(h, "gbs").alias("gb"), F.lit(False).alias("own"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        mine, others = b[b["own"]], b[~b["own"]]
        if not len(mine) or not len(others):
            return _links([])
        sets = [[shingles(x, t.words) for x in part["text"]] for part in (mine, others)]
        return _links(_verified(mine["digest"].tolist(), others["digest"].tolist(), *sets, t))

    return links.unionByName(left.unionByName(right).groupBy("group", "rb", "gb").applyInPandas(run, LINK))


def _grown(classes: DataFrame, count: int, trees: range) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Grows trees over the classes: small nodes' rows, links of the large ones that branching does not take apart, and the deepest level of either."""
    few, alike, deepest = [], [], 1
    level = classes.select("digest", "n", "sig", F.lit(count).cast("bigint").alias("parent"))
    rows, above = count * len(trees), classes.select("digest", "n", "sig")
    for depth in range(DEPTH):
        children, paths = _branches(level, depth, trees if not depth else range(1))
        sizes = common.stored(paths.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-sizes")
        met, maybe = common.maybe_in(children, [F.col("path")], sizes, [F.col("path")])
        nodes = common.stored(common.heavy_join(met.where(F.col(maybe)).drop(maybe), sizes, "path", "size", rows, ["digest"]), "near-nodes")
        stays = (F.col("size") > SHRINKS * F.col("parent")) if depth < DEPTH - 1 else F.lit(True)
        large = nodes.where(F.col("size") > LEAF)
        few.append(nodes.where(F.col("size") <= LEAF).select("path", "digest", "n", "sketch"))  # a path holds its depth
        counts = nodes.groupBy(F.when(F.col("size") > LEAF, stays).alias("stays")).agg(F.count(F.lit(1)).alias("n"))
        n = {r["stays"]: r["n"] for r in counts.collect()}  # three rows
        if n:
            deepest = depth + 1
        if n.get(True):  # their members are candidates as they are
            least = large.where(stays).groupBy("path").agg(F.min("digest").alias("b"), F.count(F.lit(1)).alias("members"))
            links = common.heavy_join(large.where(stays), least, "path", "members", n[True], ["digest"]).select(F.col("digest").alias("a"), "b").where("a <> b")
            # stored level by level: in one plan the joins of all levels run at once, and the driver holds all their jobs
            alike.append(common.stored(links, "near-alike"))
        rows = n.get(False, 0)
        if not rows:
            break
        # each class once, with its nodes, one a tree at most; the others' signatures stay where they are, and a level's classes are among those of the level above
        level = large.where(~stays).groupBy("digest").agg(F.collect_list(F.struct("path", "size")).alias("in"))
        some, maybe = common.maybe_in(above, [F.col("digest")], large.where(~stays), [F.col("digest")])
        level = level.join(some.where(F.col(maybe)).drop(maybe), "digest").select("digest", "n", "sig", F.col("in.path").alias("paths"), F.col("in.size").alias("parents"))
        # stored, as both frames of children read it
        level = common.stored(level, "near-level")
        above, level = level.select("digest", "n", "sig"), level.coalesce(_tasks(rows, 5000))
        common.collected(classes.sparkSession)
    return few, alike, deepest


def classes_with_components(docs: DataFrame, t: Threshold, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows of docs (doc_id, at_file, at_row, n, digest), and classes (digest, component: the least row of the component, copies: its rows)."""
    docs = common.plain(docs)
    rows = common.stored(_sets(docs, t.words, id_column, text_column), "near-sets")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at_file", "at_row")
    own = rows.where("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min(row).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = common.stored(own, "near-classes")
    count, few, alike, grown, trees = classes.count(), [], [], 0, TREES
    while grown < trees:
        more = _grown(classes, count, range(grown, trees))
        few, alike, grown = few + more[0], alike + more[1], trees
        trees = max(trees, trees_for(t, more[2]))
    common.release()
    common.collected(docs.sparkSession)
    nodes = reduce(DataFrame.unionByName, few).groupBy("path").agg(F.collect_list(F.struct("digest", "n", "sketch")).alias("members"))  # at most LEAF
    groups = connected(reduce(DataFrame.unionByName, [_candidates(nodes.select("members"), t), *alike]))
    sizes = groups.join(classes.select(F.col("digest").alias("node"), "n"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("all_n"))
    place = classes.select("digest", "n", F.col("first.at_file").alias("at_file"), F.col("first.at_row").alias("at_row"))
    groups = common.heavy_join(groups, common.stored(sizes, "near-sizes"), "root", "size", groups.count(), ["node"]).select(F.col("node").alias("digest"), F.col("root").alias("group"), "size", "all_n")
    wanted = common.stored(groups.join(place, "digest"), "near-groups")
    content = common.located(docs, [F.col(text_column).alias("text")])
    members = common.stored(common.at_locators(content, wanted).select("group", "size", "all_n", "n", "digest", "text"), "near-texts")
    small = (F.col("size") <= GROUP) & (F.col("all_n") <= SHINGLES)
    links = _small_links(members.where(small).select("group", "digest", "text"), t)
    large = members.where(~small).drop("all_n")
    many = large.count()
    if many:
        links = links.unionByName(_large_links(large, t, many))
    roots = connected(links)
    labelled = classes.select("digest", "first", "copies").join(roots, F.col("digest") == F.col("node"), "left").withColumn("root", F.coalesce("root", "digest"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("members"))
    return rows.drop("sig"), common.heavy_join(labelled, least, "root", "members", count, ["digest"]).select("digest", "component", "copies")


def near_duplicates(docs: DataFrame, t: Threshold = Threshold(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (its id is its component's)."""
    rows, classes = classes_with_components(docs, t, id_column, text_column)
    joined = common.heavy_join(rows, common.stored(classes, "near-components"), "digest", "copies", rows.count(), ["at_file", "at_row"])
    joined = joined.unionByName(rows.where("n = 0"), allowMissingColumns=True)
    component = F.coalesce(F.col("component.doc_id"), F.when(F.col("component").isNull(), F.col("doc_id")))
    out = joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, t: Threshold = Threshold(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs, with all their columns, with one row of each component."""
    docs = common.plain(docs)
    rows, classes = classes_with_components(docs, t, id_column, text_column)
    joined = common.heavy_join(rows, common.stored(classes, "near-components"), "digest", "copies", rows.count(), ["at_file", "at_row"])
    stays = (F.col("component.at_file") == F.col("at_file")) & (F.col("component.at_row") == F.col("at_row"))
    return common.without(docs, common.stored(joined.where(~stays).select("at_file", "at_row"), "near-dropped"))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), Threshold(85, 100, 3))


OP3_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM t),
n AS (SELECT doc_id, len(s) AS n FROM g), x AS (SELECT doc_id, unnest(s) AS h FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
