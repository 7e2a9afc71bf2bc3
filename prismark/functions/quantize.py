"""Scalar quantisation of vectors to one byte an element, with one range for all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.functions.vectors import cosine


@dataclass(frozen=True)
class Quantizer:
    """The fitted range. Elements outside it are clipped; a range of one value gives zeros."""

    low: float | None = None
    high: float | None = None

    @classmethod
    def fit(cls, vectors: DataFrame, column: str = "embedding", first_rows: int | None = None, order: str | None = None) -> Quantizer:
        """The least and the greatest element of all vectors, or of those whose ``order`` is below first_rows."""
        if first_rows is not None:
            vectors = vectors.where(F.col(order) < first_rows)
        r = vectors.agg(F.min(F.array_min(column)).alias("low"), F.max(F.array_max(column)).alias("high")).first()
        return cls(float(r["low"]), float(r["high"]))

    def _range(self) -> tuple[float, float]:
        if self.low is None or self.high is None:
            raise RuntimeError("the quantizer is not fitted")
        return self.low, self.high

    def compress(self, vector: Column) -> Column:
        """An array of 0..255; the fraction is cut off."""
        low, high = self._range()
        if high == low:
            return F.transform(vector, lambda x: F.lit(0).cast("smallint"))
        unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x.cast("double") - low) / F.lit(high - low)))
        return F.transform(vector, lambda x: F.floor(unit(x) * 255).cast("smallint"))

    def decompress(self, code: Column) -> Column:
        low, high = self._range()
        return F.transform(code, lambda u: u.cast("double") / 255 * F.lit(high - low) + F.lit(low))

    def roundtrip_cosine(self, vector: Column) -> Column:
        return cosine(vector, self.decompress(self.compress(vector)))


def compression_ratio(vector: Column, element_bytes: int = 4) -> Column:
    return (F.size(vector) * element_bytes) / F.size(vector)


def batch_sweep(vectors: DataFrame, sizes: list[int], column: str = "embedding", mbps: float = 100.0) -> DataFrame:
    """Rows (batch, full_bytes, code_bytes, ratio, full_ms, code_ms): what a batch of so many vectors takes to send; sizes above the number of vectors are left out."""
    n = F.size(column)
    own = vectors.agg(F.count(F.lit(1)).alias("rows"), F.avg(n * 4).alias("full"), F.avg(n).alias("code"))
    each = own.withColumn("batch", F.explode(F.array(*[F.lit(s).cast("bigint") for s in sizes]))).where("batch <= rows")
    full, code = F.col("full") * F.col("batch"), F.col("code") * F.col("batch")
    return each.select("batch", full.alias("full_bytes"), code.alias("code_bytes"), (full / code).alias("ratio"), transfer_ms(full, mbps).alias("full_ms"), transfer_ms(code, mbps).alias("code_ms"))


def transfer_ms(payload_bytes: Column, mbps: float = 100.0) -> Column:
    """Time to send so many bytes at so many megabits a second."""
    return payload_bytes.cast("double") / F.lit(mbps * 1024 * 1024 / 8000)
