"""Perceptual hashes of grey arrays, Hamming distance, and the ring's hash.

A 64-bit hash is a string of 16 hex digits: as an unsigned number it does not fit a BIGINT. Bits are
read row by row, the first bit is the most significant.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.functions.vectors import bound


def bits_to_hex(bits: Column, count: int = 64) -> Column:
    """Hex digits of an array of count booleans."""
    def digits(own: Column) -> Column:
        value = lambda i: F.aggregate(F.slice(own, i * 4 + 1, 4), F.lit(0), lambda acc, b: acc * 2 + b.cast("int"))
        return F.transform(F.sequence(F.lit(0), F.lit(count // 4 - 1)), lambda i: F.substring(F.lit("0123456789abcdef"), value(i) + 1, F.lit(1)))

    return F.array_join(bound(bits, digits), "")


def average_hash(grey: Column) -> Column:
    """Of 64 values: which lie above their mean."""
    mean = F.aggregate(grey, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.size(grey)
    return bits_to_hex(bound(mean, lambda m: F.transform(grey, lambda x: x.cast("double") > m)))


def difference_hash(grey: Column, width: int = 8) -> Column:
    """Of 8 rows of ``width`` values: which are greater than the value at their left.

    With width 9 there are 8 comparisons a row; with width 8 the last of a row wraps to its first value.
    """
    def bit(i: Column) -> Column:
        row, at = F.floor(i / 8).cast("int"), (i % 8).cast("int")
        here = F.element_at(grey, row * width + at + 1)
        following = F.element_at(grey, row * width + (at + 1) % width + 1)
        return following > here

    return bits_to_hex(F.transform(F.sequence(F.lit(0), F.lit(63)), bit))


def dct_matrix(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None]
    return 2 * np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def perceptual_hash_values(grey: np.ndarray) -> str:
    """Of 32 x 32 values: which of the low 8 x 8 cosine coefficients exceed their median."""
    d = dct_matrix(32)
    low = (d @ grey.reshape(32, 32).astype(float) @ d.T)[:8, :8]
    return np.packbits((low > np.median(low)).ravel()).tobytes().hex()


@F.pandas_udf(T.StringType())
def perceptual_hash(grey: pd.Series) -> pd.Series:
    return grey.map(lambda g: None if g is None or len(g) != 1024 else perceptual_hash_values(np.asarray(g)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hex digits, in two halves that fit a BIGINT."""
    half = lambda h, start: F.conv(F.substring(h, start, 8), 16, 10).cast("bigint")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def distance_class(distance: Column) -> Column:
    return F.when(distance == 0, "identical").when(distance < 10, "very similar").when(distance <= 20, "somewhat similar").otherwise("different")


def ring_hash(key: Column) -> Column:
    """The last 32 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 25, 8), 16, 10).cast("bigint")
