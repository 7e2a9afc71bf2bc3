"""Exact order statistics of large groups, and latency summaries.

Equal values are counted first; the counts are dealt by ranges of value, and sums of the ranges say at
which rank each begins. So neither a large group nor a frequent value meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismark.functions.statistics import nearest_rank_position
from prismark.plans.storage import stored


def at_positions(df: DataFrame, group: str, value: str, positions: DataFrame) -> DataFrame:
    """positions (group, pos from 0, ...) with ``value_at``, the value at that place of its group in rising order. Null values do not count."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dealt = stored(counts.repartitionByRange(parts, group, "v").withColumn("part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(group, "part").agg(F.sum("n").alias("n"))
    earlier = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = sums.select(group, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    own = W.partitionBy(group, "part").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    cut = dealt.withColumn("_before", F.coalesce(F.sum("n").over(own), F.lit(0))).join(first, [group, "part"]).withColumn("_from", F.col("first") + F.col("_before"))
    # each position first finds its range among the group's, at most one a task, and then its value within that range
    ranges = sums.withColumnRenamed("n", "_n").join(first, [group, "part"])
    placed = positions.join(ranges, group).where((F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("first") + F.col("_n"))).drop("first", "_n")
    met = cut.join(placed, [group, "part"]).where((F.col("pos") >= F.col("_from")) & (F.col("pos") < F.col("_from") + F.col("n")))
    return met.select(group, *[c for c in positions.columns if c != group], F.col("v").alias("value_at"))


def _wide(df: DataFrame, group: str, ps: list[float], value: Column) -> DataFrame:
    return df.groupBy(group).agg(*[F.max(F.when(F.abs(F.col("p") - p) < 1e-12, value)).alias(f"p{p * 100:g}") for p in ps])


def percentiles(df: DataFrame, group: str, value: str, ps: list[float], nearest_rank: bool = False) -> DataFrame:
    """Rows (group, p50, ...): linear interpolation between ranks, or the value at the floor of count times p."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("count"))
    each = sizes.withColumn("p", F.explode(F.array(*[F.lit(p) for p in ps])))
    if nearest_rank:
        wanted = each.select(group, "p", nearest_rank_position(F.col("count"), F.col("p")).alias("pos"))
        return _wide(at_positions(df, group, value, wanted), group, ps, F.col("value_at"))
    exact = (F.col("count") - 1) * F.col("p")
    ends = each.select(group, "p", exact.alias("exact"), F.explode(F.array(F.struct(F.floor(exact).alias("pos"), (F.floor(exact) + 1 - exact).alias("w")), F.struct((F.floor(exact) + 1).alias("pos"), (exact - F.floor(exact)).alias("w")))).alias("e"))
    ends = ends.select(group, "p", F.col("e.pos").alias("pos"), F.col("e.w").alias("w")).where("w > 0")
    found = at_positions(df, group, value, ends)
    return _wide(found.groupBy(group, "p").agg(F.sum(F.col("w") * F.col("value_at")).alias("x")), group, ps, F.col("x"))


def summary(df: DataFrame, group: str, value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(group).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))


def throughput(df: DataFrame, group: str, time: str) -> DataFrame:
    """Rows (group, count, seconds, per_second); null where all happened at once."""
    seconds = (F.unix_micros(F.max(time).cast("timestamp")) - F.unix_micros(F.min(time).cast("timestamp"))) / F.lit(1e6)
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("count"), seconds.alias("seconds")).withColumn("per_second", F.col("count") / F.nullif(F.col("seconds"), F.lit(0.0)))
