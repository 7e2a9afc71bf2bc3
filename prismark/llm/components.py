"""Connected components of a table of links, by alternating large-star and small-star steps.

A few links, which one task holds easily, are joined there by union-find instead: the steps are many small jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm import common

#: So many links at most are joined in one task.
FEW = 50_000


def _star(links: DataFrame, large: bool, rows: int) -> DataFrame:
    """One step over links (a, b), so many rows: a node's neighbours (large: the greater ones) are linked to the least of the node and its neighbours.

    A node with very many neighbours has greater ones, as large components hang from their least nodes.
    """
    around = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        around = around.where("v < u")
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    if large:
        return common.heavy_join(around.where("v > u"), least, "u", "n", 2 * rows, ["v"]).select(F.col("v").alias("a"), F.least("m", "u").alias("b")).where("a <> b")
    # each u is also linked to its least neighbour, as that neighbour is among its neighbours' row
    out = around.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
    return out.distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node is linked to one lesser node at most, and that one to none."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(links.select(F.col("b").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
    by = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
    return by.where("leaf > 1 OR (leaf > 0 AND root > 0)").isEmpty()


def _joined(links: DataFrame) -> DataFrame:
    """Rows (node, root) of a few links (a, b), from one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict = {}

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                a, b = root(up.setdefault(a, a)), root(up.setdefault(b, b))
                up[max(a, b)] = min(a, b)  # so a component's root is its least node
        yield pd.DataFrame({"node": list(up), "root": [root(x) for x in up]})

    kind = links.schema["a"].dataType
    return links.coalesce(1).mapInPandas(run, T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))


def connected(links: DataFrame, most: int = 60) -> DataFrame:
    """Rows (node, root): every node that has a link, with the least node of its component.

    links has two columns a and b of one type. Each round is written to the shared folder; rounds end
    when every link leads to a root, after a number that grows with the logarithm of a component's size.
    """
    spark, path = links.sparkSession, common.scratch(links.sparkSession, "links")
    now = common.stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", path)
    rows = now.count()
    if rows <= FEW:
        return common.stored(_joined(now), "links")
    for _ in range(most):
        if _settled(now):
            break
        rows = now.count()
        for large in (True, False):
            before, path = path, common.scratch(spark, "links")
            now = common.stored(_star(now, large, rows), "links", path)
            common.remove(spark, before)
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
