"""Numbers for the rows of a table in a global order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismark.plans.storage import stored


def numbered(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """df with ``name``, 0 and up in the given order.

    Ranges of the order are numbered apart; their counts, one row a range, say where each begins. Rows
    that are equal in all of ``order`` are numbered in any order.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    at = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return own.withColumn("_at", at).join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")
