"""Percentiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank_position(count: Column, p: Column) -> Column:
    """The place, from 0, of a percentile among ``count`` sorted values: the floor of count times p, at most the last."""
    return F.least(F.floor(count * p), count - 1)
