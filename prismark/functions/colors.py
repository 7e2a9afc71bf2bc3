"""Colour histograms of pixel arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bgr_bin(b: Column, g: Column, r: Column) -> Column:
    """One of 8 x 8 x 8 cells of values 0..255."""
    cell = lambda c: F.floor(c / 32).cast("int")
    return cell(b) * 64 + cell(g) * 8 + cell(r)


def histogram(bins: Column) -> Column:
    """The cells that occur with their share, the whole of unit norm: array of struct(bin, value)."""
    counts = F.transform(F.array_sort(F.array_distinct(bins)), lambda b: F.struct(b.alias("bin"), F.size(F.filter(bins, lambda x: x == b)).cast("double").alias("n")))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c["n"] * c["n"]))
    return F.transform(counts, lambda c: F.struct(c["bin"].alias("bin"), (c["n"] / length).alias("value")))
