"""Alignment of hash records and two feature sets on one image key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismark.functions import paths

KEYS: dict[str, tuple[Callable[[Column], Column], str]] = {"file": (paths.file_key, paths.INVALID_PATH), "folder": (paths.folder_key, paths.INVALID_KEY)}


def keyed(df: DataFrame, path_column: str, key: str = "folder") -> DataFrame:
    """df with image_id; rows whose path gives no key are dropped."""
    make, invalid = KEYS[key]
    return df.withColumn("image_id", make(F.col(path_column))).where(F.col("image_id") != invalid)


def align_three_way(hashes: DataFrame, traditional: DataFrame, deep: DataFrame) -> DataFrame:
    """Inner join of three keyed tables on image_id; repeated keys fan out, see ``first_of_key``."""
    return hashes.join(traditional, "image_id").join(deep, "image_id")


def gather(aligned: DataFrame, rows: DataFrame, at: str, index: str = "row_index", column: str = "features") -> DataFrame:
    """aligned with the vector of ``rows`` (index, column) that its row index ``at`` names, as a column of that name; rows whose index names none are dropped."""
    own = rows.select(F.col(index).alias("_index"), F.col(column).alias(column))
    return aligned.join(own, F.col(at) == F.col("_index")).drop("_index")


def first_of_key(aligned: DataFrame, *order: str) -> DataFrame:
    """One row a key, the first in the given order."""
    rank = F.row_number().over(W.partitionBy("image_id").orderBy(*order))
    return aligned.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
