"""Consistent-hash ring: assignment of ids to logical nodes, monitoring and rebalancing.

The ring is a table of intervals of 32-bit positions. An id goes to the first position at or after its
hash, past the last one to the first. ``assign`` gives ids and intervals a coarse key, the leading bits
of the position, so the lookup is an equi join at any number of ids and positions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismark.functions.hashes import ring_hash
from prismark.plans.storage import stored

SPACE_BITS, COARSE_BITS = 32, 10


def positions(spark: SparkSession, nodes: int = 4, virtual_nodes: int = 150) -> DataFrame:
    """Rows (pos, node_id); where two keys collide the higher node keeps the position."""
    grid = spark.range(nodes).select(F.col("id").cast("int").alias("node_id")).select("node_id", F.explode(F.sequence(F.lit(0), F.lit(virtual_nodes - 1))).alias("v"))
    key = F.concat(F.lit("node_"), F.col("node_id"), F.lit("_vnode_"), F.col("v"))
    return grid.groupBy(ring_hash(key).alias("pos")).agg(F.max("node_id").alias("node_id"))


def intervals(ring: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows (by..., lo, hi, node_id): hashes in (lo, hi] belong to the node. The stretch after the last position belongs to the first one's node."""
    by = by or []
    w = W.partitionBy(*by).orderBy("pos")  # a ring has nodes times virtual_nodes positions
    inner = ring.select(*by, F.coalesce(F.lag("pos").over(w), F.lit(-1).cast("bigint")).alias("lo"), F.col("pos").alias("hi"), "node_id")
    wrap = ring.groupBy(*by).agg(F.max("pos").alias("lo"), F.lit(1 << SPACE_BITS).cast("bigint").alias("hi"), F.min_by("node_id", "pos").alias("node_id"))
    return inner.unionByName(wrap)


def assign(ids: DataFrame, ring: DataFrame, id_column: str = "image_id", by: list[str] | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """ids with node_id (for each ring named by ``by``); an override (id_column, node_id) wins over the ring."""
    by, shift = by or [], SPACE_BITS - COARSE_BITS
    cut = intervals(ring, by)
    cells = F.sequence(F.shiftright(F.col("lo") + 1, shift), F.shiftright(F.least(F.col("hi"), F.lit((1 << SPACE_BITS) - 1)), shift))
    cut = cut.where("lo < hi").select(*by, "lo", "hi", F.col("node_id").alias("ring_node"), F.explode(cells).alias("cell"))
    own = ids.withColumn("hash", ring_hash(F.col(id_column))).withColumn("cell", F.shiftright("hash", shift))
    found = own.join(cut, "cell").where((F.col("lo") < F.col("hash")) & (F.col("hash") <= F.col("hi")))
    if overrides is None:
        return found.withColumnRenamed("ring_node", "node_id").drop("cell", "hash", "lo", "hi")
    o = overrides.select(F.col(id_column).alias("_id"), F.col("node_id").alias("_node"))
    found = found.join(o, F.col(id_column) == F.col("_id"), "left").withColumn("node_id", F.coalesce("_node", "ring_node"))
    return found.drop("cell", "hash", "lo", "hi", "ring_node", "_id", "_node")


def assign_modulo(ids: DataFrame, nodes: int = 4, id_column: str = "image_id") -> DataFrame:
    return ids.withColumn("node_id", F.pmod(F.col(id_column), F.lit(nodes)).cast("int"))


def summary(assigned: DataFrame, nodes: int) -> DataFrame:
    """Rows (node_id, size, percent); nodes without ids show 0."""
    every = assigned.sparkSession.range(nodes).select(F.col("id").cast("int").alias("node_id"))
    counts = assigned.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    sized = every.join(counts, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("size"))
    total = F.sum("size").over(W.partitionBy())  # one row a node
    return sized.withColumn("percent", F.coalesce(F.col("size") * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0)))


def _average(by: list[str]) -> Column:
    return F.avg("size").over(W.partitionBy(*by))


def skew_status(sizes: DataFrame, threshold: float = 0.15, by: list[str] | None = None) -> DataFrame:
    """sizes with diff from the average as a share of it, and status; without any ids every node is OK."""
    average = _average(by or [])
    diff = F.coalesce((F.col("size") - average) / F.nullif(average, F.lit(0.0)), F.lit(0.0))
    status = F.when(F.col("diff") > threshold, "OVERLOADED").when(F.col("diff") < -threshold, "UNDERLOADED").otherwise("OK")
    return sizes.withColumn("diff", diff).withColumn("status", status)


def max_skew_percent(sizes: DataFrame, by: list[str] | None = None) -> DataFrame:
    with_diff = skew_status(sizes, by=by)
    out = F.max(F.abs("diff") * 100).alias("max_skew_percent")
    return with_diff.groupBy(*by).agg(out) if by else with_diff.agg(out)


def sweep(ids: DataFrame, configs: list[tuple[int, int]], id_column: str = "image_id") -> DataFrame:
    """Sizes of all nodes for each (nodes, virtual_nodes), in one plan: rows (nodes, virtual_nodes, node_id, size)."""
    spark = ids.sparkSession
    rings = None
    for nodes, virtual in configs:
        ring = positions(spark, nodes, virtual).select(F.lit(nodes).alias("nodes"), F.lit(virtual).alias("virtual_nodes"), "pos", "node_id")
        rings = ring if rings is None else rings.unionByName(ring)
    by = ["nodes", "virtual_nodes"]
    counts = assign(ids.select(id_column), rings, id_column, by).groupBy(*by, "node_id").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame(configs, "nodes int, virtual_nodes int").withColumn("node_id", F.explode(F.sequence(F.lit(0), F.col("nodes") - 1)))
    return every.join(counts, [*by, "node_id"], "left").select(*by, "node_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("size"))


@dataclass
class MovePlan:
    """Moves of a rebalancing: (round, from, to, count), and where each stretch of a node's first ranks ends up."""

    moves: list[tuple[int, int, int, int]] = field(default_factory=list)
    stretches: list[tuple[int, int, int, int]] = field(default_factory=list)
    rounds: int = 0
    sizes: list[int] = field(default_factory=list)


def plan_moves(sizes: list[int], threshold: float = 0.15, max_rounds: int = 10) -> MovePlan:
    """Works on counts alone. Each node is a queue of stretches (origin node, first rank, count): moves leave at the head and join at the end."""
    queues = [[(n, 0, size)] if size else [] for n, size in enumerate(sizes)]
    held, plan = list(sizes), MovePlan()
    average = sum(sizes) / max(1, len(sizes))
    for number in range(1, max_rounds + 1):
        gap = [(h - average) / average if average else 0.0 for h in held]
        over, under = [n for n, g in enumerate(gap) if g > threshold], [n for n, g in enumerate(gap) if g < -threshold]
        if not over:
            break
        plan.rounds = number
        for a in over:
            for b in under:
                m = int(held[a] - (held[a] + held[b]) / 2)
                if m <= 0:
                    continue
                left = m
                while left:
                    origin, first, count = queues[a].pop(0)
                    taken = min(left, count)
                    queues[b].append((origin, first, taken))
                    if count > taken:
                        queues[a].insert(0, (origin, first + taken, count - taken))
                    left -= taken
                held[a] -= m
                held[b] += m
                plan.moves.append((number, a, b, m))
    plan.sizes = held
    plan.stretches = [(origin, first, first + count - 1, n) for n, queue in enumerate(queues) for origin, first, count in queue if origin != n]
    return plan


def ranked_within_node(assigned: DataFrame, order: str) -> DataFrame:
    """assigned with ``node_rank``, 0 and up in the given order within each node.

    Ranges of the order are ranked apart and counted; counts, one row a node and range, say where each begins.
    """
    spark = assigned.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = stored(assigned.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "ranked")
    counts = own.groupBy("node_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("node_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("node_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    at = F.row_number().over(W.partitionBy("node_id", "part").orderBy(order)) - 1
    return own.withColumn("at", at).join(first, ["node_id", "part"]).withColumn("node_rank", F.col("first") + F.col("at")).drop("part", "at", "first")


def rebalance(assigned: DataFrame, nodes: int, order: str = "image_id", threshold: float = 0.15, max_rounds: int = 10) -> tuple[DataFrame, MovePlan]:
    """assigned with node_id after rebalancing and ``moved_from`` (null where an id stays), and the plan. Only node counts reach the driver."""
    counts = {r["node_id"]: r["size"] for r in summary(assigned, nodes).collect()}
    plan = plan_moves([counts[n] for n in range(nodes)], threshold, max_rounds)
    ranked = ranked_within_node(assigned, order)
    if not plan.stretches:
        return ranked.drop("node_rank").withColumn("moved_from", F.lit(None).cast("int")), plan
    table = F.array(*[F.struct(F.lit(o).alias("origin"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(n).alias("to")) for o, a, b, n in plan.stretches])
    hit = F.filter(table, lambda s: (s["origin"] == F.col("node_id")) & (s["a"] <= F.col("node_rank")) & (F.col("node_rank") <= s["b"]))
    to = F.get(hit, F.lit(0))["to"]
    moved = ranked.withColumn("to", to).withColumn("moved_from", F.when(F.col("to").isNotNull(), F.col("node_id")))
    return moved.withColumn("node_id", F.coalesce("to", "node_id")).drop("to", "node_rank"), plan


def in_sync(after: DataFrame, ring: DataFrame, id_column: str = "image_id") -> DataFrame:
    """Whether a lookup by ring and overrides gives every id's node: one row (checked, moved, in_sync)."""
    overrides = after.where("moved_from IS NOT NULL").select(id_column, "node_id")
    looked_up = assign(after.select(id_column), ring, id_column, overrides=overrides).select(F.col(id_column).alias("_id"), F.col("node_id").alias("_node"))
    both = after.join(looked_up, F.col(id_column) == F.col("_id"))
    return both.agg(F.count(F.lit(1)).alias("checked"), F.count("moved_from").alias("moved"), F.coalesce(F.bool_and(F.col("_node") == F.col("node_id")), F.lit(True)).alias("in_sync"))
