"""Retrieval quality and cost as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismark.operators import search


def sampled(rows: DataFrame, n: int, seed: int = 42, id_column: str = "vec_id") -> DataFrame:
    """n rows that depend on their ids and the seed only, not on how the table is laid out; with ``place``, which they are ordered by."""
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")).cast("binary"))
    return rows.where(F.col(id_column).isNotNull()).withColumn("place", place).orderBy("place", id_column).limit(n)


def precision_recall(results: DataFrame, labels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, precision, recall): hits of the query's label among its first k results over k, and over the other rows of that label.

    results: query_id, image_id, rank; labels: image_id, label; queries: query_id.
    """
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    own = queries.join(labels.select(F.col("image_id").alias("query_id"), "label"), "query_id").join(size, "label")
    got = results.where(F.col("rank") <= k).join(labels.select("image_id", F.col("label").alias("found")), "image_id")
    hits = got.join(own.select("query_id", "label"), "query_id").groupBy("query_id").agg(F.sum((F.col("found") == F.col("label")).cast("int")).alias("hits"))
    out = own.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    recall = F.when(F.col("n") > 1, F.col("hits") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return out.select("query_id", "label", (F.col("hits") / F.lit(k)).alias("precision"), recall.alias("recall"))


def macro_average(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("queries"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def ann_recall(candidates: DataFrame, truth: DataFrame, queries: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Rows (by..., query_id, candidates, recall): how much of the exact first k (the query itself counts) the candidates hold."""
    by = by or []
    n = candidates.groupBy(*by, "query_id").agg(F.count(F.lit(1)).alias("candidates"))
    hit = candidates.join(truth.where(F.col("rank") <= k).select("query_id", "image_id"), ["query_id", "image_id"]).groupBy(*by, "query_id").agg(F.count(F.lit(1)).alias("hits"))
    every = queries if not by else queries.crossJoin(F.broadcast(candidates.select(*by).distinct()))  # by: the few index configurations
    out = every.join(n, [*by, "query_id"], "left").join(hit, [*by, "query_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return out.select(*by, "query_id", zero("candidates").alias("candidates"), (zero("hits") / F.lit(k)).alias("recall"))


def tradeoff_precision(results: DataFrame, labels: DataFrame, queries: DataFrame, by: str) -> DataFrame:
    """Rows (by, precision_at_4_of_5, with_results): of the first 5 results the query itself is dropped, and label hits among the first 4 left are divided by 4.

    Queries without results count as 0. results: by, query_id, image_id, rank.
    """
    left = results.where("rank <= 5 AND query_id <> image_id")
    again = F.row_number().over(W.partitionBy(by, "query_id").orderBy("rank"))
    left = left.withColumn("again", again).where("again <= 4")
    got = left.join(labels.select("image_id", F.col("label").alias("found")), "image_id").join(labels.select(F.col("image_id").alias("query_id"), "label"), "query_id")
    hits = got.groupBy(by, "query_id").agg(F.sum((F.col("found") == F.col("label")).cast("int")).alias("hits"))
    some = results.select(by, "query_id").distinct().withColumn("some", F.lit(1))
    every = queries.crossJoin(F.broadcast(results.select(by).distinct()))  # by: the few configurations
    out = every.join(hits, [by, "query_id"], "left").join(some, [by, "query_id"], "left")
    return out.groupBy(by).agg(F.avg(F.coalesce("hits", F.lit(0)) / F.lit(4.0)).alias("precision_at_4_of_5"), F.count("some").alias("with_results"))


def tune_candidates(candidates: DataFrame, rows: DataFrame, queries: DataFrame, truth: DataFrame, sizes: list[int], metric: str = "cosine", digits: int | None = None) -> DataFrame:
    """Rows (k, queries, candidates, avg_recall): the first k candidates of each query are re-ranked and compared with the truth.

    candidates: query_id, image_id, position (from 1); truth: query_id, image_id. Sizes nest, so vectors are scored once.
    """
    scored = search.rerank(candidates.where(F.col("position") <= max(sizes)), rows, queries, metric, digits=digits)
    cut = scored.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sizes]))).where(F.col("position") <= F.col("k"))
    wanted = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    marked = cut.join(truth.select("query_id", "image_id", F.lit(1).alias("hit")), ["query_id", "image_id"], "left")
    by = marked.groupBy("k", "query_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits")).join(wanted, "query_id", "left")
    recall = F.col("hits") / F.greatest(F.coalesce("wanted", F.lit(0)), F.lit(1))
    return by.groupBy("k").agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("candidates"), F.avg(recall).alias("avg_recall"))


def pareto_frontier(points: DataFrame, cost: str, gain: str, *ties: str) -> DataFrame:
    """The points, by rising cost, whose gain exceeds that of all cheaper ones. Points are index configurations, few by nature."""
    w = W.partitionBy().orderBy(cost, F.desc(gain), *ties).rowsBetween(W.unboundedPreceding, -1)
    return points.withColumn("_best", F.max(gain).over(w)).where(F.col(gain) > F.coalesce("_best", F.lit(-1.0))).drop("_best")
